"""Two tokenizers' views of one text, aligned by divide and conquer at shared cuts.

The tokens of a text end at byte offsets. To align an interval, take the token end of A nearest to the
middle that bisecting the ends of B finds there too, cut both there, and go on with the two halves; an
interval without a common end inside is a leaf: one group of tokens of A and B. All pairs of a
group are links; a pair of ids counts in every document that holds it linked.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .segment_bpe import byte_letters
from .text_units import Memory, no_collector, portions

SPACE = "\u2581"
#: Pairs of the most documents whose counts every task holds; all others are joined.
FREQUENT = 1 << 18
#: Tokens of A of a unit that is aligned together with others; longer ones are taken one by one.
MANY = 512
#: Units remembered.
MAX_UNITS = 200_000
#: Links of a text held one by one before they are counted.
HELD = 1 << 20


def groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Leaf groups ``(from, to)`` of A and ``(from, to)`` of B, in order, from the token ends of one
    text; both lists ascend and end alike. No end is tried twice: those tried in an
    interval lie together, next to the cut that was found, so that one range is left on each side.
    """
    found: list[tuple[int, int, int, int]] = []
    # an interval of A and of B, and the part of A's ends in it not tried yet
    open_ = [(0, len(a), 0, len(b), 0, len(a) - 1)] if a else []
    while open_:
        a0, a1, b0, b1, low, high = open_.pop()
        left = (low + high) // 2
        right = left + 1
        at = -1
        while low <= left or right < high:
            if low <= left:
                j = bisect_left(b, a[left], b0, b1)
                if j < b1 - 1 and b[j] == a[left]:
                    at = left
                    break
                left -= 1
            if right < high:
                j = bisect_left(b, a[right], b0, b1)
                if j < b1 - 1 and b[j] == a[right]:
                    at = right
                    break
                right += 1
        if at < 0:
            found.append((a0, a1, b0, b1))
        elif at == left:
            open_.append((at + 1, a1, j + 1, b1, right, max(right, high)))
            open_.append((a0, at + 1, b0, j + 1, low, at))
        else:
            open_.append((at + 1, a1, j + 1, b1, at + 1, high))
            open_.append((a0, at + 1, b0, j + 1, low, max(low, left + 1)))
    return found


def groups_many(
    a: np.ndarray, b: np.ndarray, units_a: np.ndarray, units_b: np.ndarray
) -> np.ndarray:
    """The same for many texts at once: rows ``(from, to, from, to)`` in order, from the running token
    ends of all texts and where the tokens of each text begin (with the total at the end). Every round
    tries two ends in each open interval and halves those where one is common."""
    a0, a1, b0, b1 = units_a[:-1], units_a[1:], units_b[:-1], units_b[1:]
    low, high = a0, a1 - 1
    left = (low + high) // 2
    right = left + 1
    leaves = []
    while len(a0):
        common = np.full(len(a0), -1)
        for side in (left, right):
            tried = (common < 0) & (side >= low) & (side < high)
            ends = a[side[tried]]
            same = b[np.searchsorted(b, ends)] == ends
            common[np.flatnonzero(tried)[same]] = side[tried][same]
        at_left = common == left
        left, right = np.where(at_left, left, left - 1), np.where(common >= 0, right, right + 1)
        done = (common < 0) & (left < low) & (right >= high)
        leaves.append(np.stack([a0, a1, b0, b1], axis=1)[done])
        cut = common >= 0
        at, by_left = common[cut], at_left[cut]
        j = np.searchsorted(b, a[at])
        # untried ends: of the first half below the cut, of the second half beyond what was tried
        near, far = low[cut], high[cut]
        first = (a0[cut], at + 1, b0[cut], j + 1, near, np.where(by_left, at, np.maximum(near, left[cut] + 1)))
        second = (at + 1, a1[cut], j + 1, b1[cut], np.where(by_left, right[cut], at + 1), np.maximum(far, at))
        rest = ~done & ~cut
        halves = [np.concatenate(x) for x in zip(first, second)]
        middle = (halves[4] + halves[5]) // 2
        a0, a1, b0, b1, low, high, left, right = (
            np.concatenate([x[rest], y])
            for x, y in zip((a0, a1, b0, b1, low, high, left, right), (*halves, middle, middle + 1))
        )
    found = np.concatenate(leaves) if leaves else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")]


class Pair:
    """Both tokenizers; aligned units seen lately are remembered.

    A is a byte-level file of the tokenizers library, B a sentencepiece model that puts a space ahead
    of a text. ``B`` must hold no piece with white space behind other characters, so that the
    tokens of a text are those of its units; other models raise ``ValueError``.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        # a task has one core: threads of the library's own only wait for each other there
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] for p in pieces):
            raise ValueError(f"{path_b} has pieces over white space")
        if self.b.encode("a") != self.b.encode("a", add_bos=False, add_eos=False):
            raise ValueError(f"{path_b} puts marks around a text")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        ids = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            known = all(c in byte for c in token)
            self.bytes_a[i] = bytes(byte[c] for c in token) if known else token.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        numbers = range(max(len(self.bytes_a), len(self.bytes_b)))
        #: decimal ids with what may follow them in a list of groups: at 3 * id + place of the mark
        self.shown = np.array([f"{i}{mark}" for i in numbers for mark in ",|;"], object)
        self.space = self.b.piece_to_id(SPACE)
        self.width = len(pieces)
        self.told = Memory(self._align, MAX_UNITS)

    def _ids_b(self, fresh: list[str]) -> list[list[int]]:
        """The model puts a space ahead: of a unit with one, its own is left out; before other
        units the space stands alone, as no piece has their first character behind it."""
        texts = [u[1:] if u[:1] == " " else u for u in fresh]
        found = self.b.encode(texts, num_threads=1) if texts else []
        return [
            ([self.space] if u == " " else ids) if u[:1] == " " else ids[1:]
            for u, ids in zip(fresh, found)
        ]

    def _align(self, fresh: list[str]) -> list[tuple | None]:
        """Per unit its groups as text and, as the bytes of 64-bit numbers, the number of tokens of A
        (times 2 ** 32) and B, negative, and the key ``a * width + b`` of every link; None where the
        bytes of a side are not the unit's."""
        if not fresh:
            return []
        ids_a = [e.ids for e in self.a.encode_batch_fast(fresh, add_special_tokens=False)]
        ids_b = self._ids_b(fresh)
        data = [unit.encode() for unit in fresh]
        spelled = self._spells(ids_a, self.bytes_a, data) & self._spells(ids_b, self.bytes_b, data)
        told: list[tuple | None] = [None] * len(fresh)
        short = []
        for i in np.flatnonzero(spelled).tolist():
            if len(ids_a[i]) <= MANY:
                short.append(i)
            else:
                told[i] = self._tell([ids_a[i]], [ids_b[i]], groups)[0]
        for i, found in zip(short, self._tell([ids_a[i] for i in short], [ids_b[i] for i in short])):
            told[i] = found
        return told

    @staticmethod
    def _spells(lists: list[list[int]], table: list[bytes], data: list[bytes]) -> np.ndarray:
        """Whether the tokens of each list are the bytes of its unit."""
        tokens = [table[i] for i in chain.from_iterable(lists)]
        at = np.cumsum([0, *map(len, tokens)])[np.cumsum([0, *map(len, lists)])]
        whole = b"".join(tokens)
        if whole == b"".join(data) and (np.diff(at) == np.fromiter(map(len, data), np.int64, len(data))).all():
            return np.ones(len(data), bool)
        ends = at.tolist()
        return np.array([whole[x:y] == z for x, y, z in zip(ends, ends[1:], data)])

    def _tell(self, lists_a: list[list[int]], lists_b: list[list[int]], one=None) -> list[tuple]:
        flat_a, flat_b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (lists_a, lists_b))
        units_a, units_b = (np.cumsum([0, *map(len, x)]) for x in (lists_a, lists_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        if one:
            found = np.array(one(ends_a.tolist(), ends_b.tolist()), np.int64)
        else:
            found = groups_many(ends_a, ends_b, units_a, units_b)
        a0, a1, b0, b1 = found.T
        # the text of the groups: every id with the mark that follows it, in the order of the groups
        of_a, of_b = np.repeat(b0, a1 - a0), np.repeat(a1, b1 - b0)  # ids of the other side ahead
        named = np.empty(len(flat_a) + len(flat_b), np.int64)
        marked_a, marked_b = 3 * flat_a, 3 * flat_b
        marked_a[a1 - 1] += 1
        marked_b[b1 - 1] += 2
        named[np.arange(len(flat_a)) + of_a] = marked_a
        named[np.arange(len(flat_b)) + of_b] = marked_b
        shown = self.shown[named].tolist()
        # links: every id of A of a group with every id of B
        wide = b1 - b0
        rows = np.repeat(np.arange(len(flat_a)), np.repeat(wide, a1 - a0))
        first = np.cumsum(np.repeat(wide, a1 - a0)) - np.repeat(wide, a1 - a0)
        within = np.arange(len(rows)) - np.repeat(first, np.repeat(wide, a1 - a0))
        keys = flat_a[rows] * self.width + flat_b[np.repeat(np.repeat(b0, a1 - a0), np.repeat(wide, a1 - a0)) + within]
        links = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(flat_a)))])[units_a]
        # the numbers of tokens of each unit ahead of its keys
        sizes = (np.diff(units_a) << 32) + np.diff(units_b)
        data = np.insert(keys.astype(np.int64), links[:-1], -sizes).tobytes()
        links = (8 * (links + np.arange(len(links)))).tolist()
        at = (units_a + units_b).tolist()
        return [
            ("".join(shown[x:y])[:-1], data[i:j]) for x, y, i, j in zip(at, at[1:], links, links[1:])
        ]

    @no_collector()
    def align(self, texts: list[str | None]) -> list[_Aligned]:
        done = [_Aligned() for _ in texts]
        # an empty text has no tokens, any other is read with a space ahead
        for portion in portions(f" {text}" if text else "" for text in texts):
            self.told.learn(found for _, found in portion)
            for place, found in portion:
                done[place].add(found, self.told)
        return done


class _Aligned:
    """What the windows of one text amount to."""

    def __init__(self) -> None:
        self.whole, self.sizes, self.n_groups, self.shown = True, 0, 0, None
        self.held: list[bytes] = []
        self.n_held = 0
        self.keys = self.times = np.zeros(0, np.int64)

    def add(self, found: list[str], told: Memory) -> None:
        if not self.whole:
            return
        values = list(map(told.get, found))
        if None in values:
            self.__init__()
            self.whole = False
            return
        texts, data = zip(*values)
        shown = ";".join(texts)
        self.n_groups += shown.count(";") + 1
        if self.shown is None:
            self.shown = hashlib.sha256(shown.encode())
        else:
            self.shown.update(b";" + shown.encode())
        self.held.append(b"".join(data))
        self.n_held += len(self.held[-1]) >> 3
        if self.n_held > HELD:
            self._count()

    def _count(self) -> None:
        """Numbers held become sizes and the distinct links with their numbers."""
        numbers = np.sort(np.frombuffer(b"".join(self.held), np.int64))
        self.held, self.n_held = [], 0
        first = int(np.searchsorted(numbers, 0))
        self.sizes -= sum(numbers[:first].tolist())
        keys, times = np.unique(numbers[first:], return_counts=True)
        if len(self.keys):
            both = np.concatenate([self.keys, keys])
            keys, each = np.unique(both, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, each, np.concatenate([self.times, times]))
            times = sums
        self.keys, self.times = keys, times

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct links and how often each is there."""
        if self.held:
            self._count()
        return self.keys, self.times

    def numbers(self) -> tuple[int, int, int, int]:
        """Tokens of A and of B, groups, links."""
        _, times = self.links()
        return self.sizes >> 32, self.sizes & 0xFFFFFFFF, self.n_groups, int(times.sum())

    def digest(self) -> str:
        return self.shown.hexdigest() if self.shown else ""


_OPEN: dict[tuple[str, str], Pair] = {}  # per worker: tables by files


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _OPEN:
        _OPEN[path_a, path_b] = Pair(path_a, path_b)
    return _OPEN[path_a, path_b]


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and, as arrays, the distinct linked
    pairs ``keys`` (``a * width_b + b``) of every row with their numbers of links ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = pair_of(path_a, path_b).align
        for batch in batches:
            texts = batch.column("text")
            for start in range(0, len(texts), 256):
                done = align(texts.slice(start, 256).to_pylist())
                offsets = np.zeros(len(done) + 1, np.int32)
                found, counted = zip(*(d.links() for d in done))
                offsets[1:] = np.cumsum([len(keys) for keys in found])
                keys, times = np.concatenate(found), np.concatenate(counted)
                numbers = np.array([d.numbers() for d in done], np.int64).reshape(-1, 4)
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, 256),
                        *(pa.array(column) for column in numbers.T.copy()),
                        pa.array([d.digest() for d in done], pa.string()),
                        pa.ListArray.from_arrays(at, pa.array(keys)),
                        pa.ListArray.from_arrays(at, pa.array(times)),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "keys array<long>, times array<long>",
    )


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """``key, count, best``: documents that hold each pair, and whether no pair of its A id has more."""
    counts = linked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("count"))
    counts = counts.withColumn("a", F.floor(F.col("key") / width))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Null and empty texts, and texts whose tokens of A or B do not spell a space and the text, have
    zeros and ''. Every row is a document: repeated rows count each and stay, null ids stay.
    Other columns are left out whatever their names; an empty table gives no rows.

    Texts are read once; the links of each document are written with it. The counts of the
    ``frequent`` pairs of the most documents go to every task (16 bytes a pair, so their size is
    bounded by that number); links of all other pairs are joined with the table of counts.
    """
    spark = docs.sparkSession
    width = pair_of(path_a, path_b).width
    linked = cut(
        links(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned"
    )
    counts = cut(pair_counts(linked, width), "pairs")
    top = counts.orderBy(F.col("count").desc(), "key").limit(frequent).toPandas().sort_values("key")
    known = spark.sparkContext.broadcast(
        (top["key"].to_numpy(np.int64), top["count"].to_numpy(np.int64), top["best"].to_numpy(bool))
    )

    plain = [c for c in linked.columns if c not in ("keys", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_keys, all_counts, all_best = known.value
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            if len(all_keys):
                at = np.minimum(np.searchsorted(all_keys, keys), len(all_keys) - 1)
                hit = all_keys[at] == keys
                shares = [np.where(hit, times * values[at], 0) for values in (all_best, all_counts)]
            else:
                hit = np.zeros(len(keys), bool)
                shares = [np.zeros(len(keys), np.int64)] * 2
            totals = [_sums(share, ends, sizes) for share in shares]
            left = _sums((~hit).astype(np.int64), ends, sizes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            rest = pa.StructArray.from_arrays(
                [pa.array(keys[~hit]), pa.array(times[~hit])], names=["key", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in plain), *map(pa.array, totals),
                    pa.ListArray.from_arrays(offsets, rest),
                ],
                names=[*plain, "n_best", "count_sum", "rest"],
            )

    kinds = ", ".join(f"{c} {linked.schema[c].dataType.simpleString()}" for c in plain)
    scored = cut(
        linked.mapInArrow(
            run, f"{kinds}, n_best long, count_sum long, rest array<struct<key: long, times: long>>"
        ),
        "scored",
    )
    rest = scored.select("row", F.inline("rest")).join(counts, "key")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("count")).alias("more_sum"),
    )
    more = lambda name, extra: (F.col(name) + F.coalesce(extra, F.lit(0))).alias(name)
    return scored.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        more("n_best", F.col("more_best")), more("count_sum", F.col("more_sum")), "groups_sha256",
    )


def _sums(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each list in a flat array of all their values."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[ends] - running[ends - sizes]
