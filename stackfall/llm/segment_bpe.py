"""BPE by a segment tree over the ranks of adjacent pairs.

The leaf of position ``i`` holds the rank of the pair that starts there (and ``i``, so that the
leftmost of equal ranks is least), every inner node the least of its two children. The root is the next
merge; a merge changes three leaves, each mended on its way up. A piece of ``n`` bytes takes ``n log n``
steps however long it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .bpe import Digest
from .text_units import Memory, is_word, no_collector, portions

_NONE = 1 << 62  # a leaf without a merge
#: Leaves of the trees that are worked on together.
FOREST = 1 << 16
#: Bytes of a piece that is worked on so; longer ones are taken one by one.
SMALL = 256
#: Matches of the pattern remembered beside the units, and units of text remembered.
MAX_PIECES, MAX_UNITS = 50_000, 400_000
#: The library's pattern on printable ASCII, where classes of characters leave no doubt.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+| +(?![^ ])| +").findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for
    itself, the others from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merges:
    """The merges of a vocabulary: what two neighbours give, and at which rank."""

    def __init__(self, pairs: list[tuple[int, int, int]], width: int) -> None:
        self.width = width
        keys = np.array([a * width + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([c for *_, c in pairs] or [0], np.int64)
        self._by_pair: dict[int, int] = {}

    def by_pair(self) -> dict[int, int]:
        if not self._by_pair:
            self._by_pair.update(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._by_pair

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where it has none or a side is -1."""
        if not len(self.keys):
            return np.full(left.shape, _NONE)
        asked = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.ranks[at], _NONE)


def merge(symbols: np.ndarray, merges: Merges) -> None:
    """Merge every row of ``symbols`` in place, the leftmost pair of lowest rank first.

    A row is one piece: symbols, then -1 up to a power of two and one more. A symbol merged away
    becomes -1. Rows are independent; each step takes the root of every row that still has a merge.
    """
    rows, size = len(symbols), symbols.shape[1] - 1
    bits = size.bit_length()  # of a position
    places = np.arange(size)

    def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(rank == _NONE, _NONE, rank << bits | place)

    tree = np.full((rows, 2 * size), _NONE)
    tree[:, size:] = leaf(merges.rank(symbols[:, :-1], symbols[:, 1:]), places)
    node = size
    while node > 1:
        node //= 2
        tree[:, node : 2 * node] = tree[:, 2 * node : 4 * node].reshape(rows, node, 2).min(axis=2)
    # neighbours; column ``size + 1`` stands for the end and, as index -1, for the beginning
    after = np.tile(np.minimum(np.arange(1, size + 3), size + 1), (rows, 1))
    before = np.tile(np.arange(-1, size + 1), (rows, 1))
    ends = (symbols >= 0).sum(axis=1)
    wide = np.full((rows, size + 2), -1, np.int64)
    wide[:, :-1] = symbols
    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        root = tree[live, 1]
        at = root & ((1 << bits) - 1)
        gone = after[live, at]
        wide[live, at] = merges.made[root >> bits]
        wide[live, gone] = -1
        following = after[live, gone]
        after[live, at] = following
        before[live, following] = at
        ahead = before[live, at]
        last = following >= ends[live]
        new = wide[live, at]
        tree[live, size + at] = np.where(
            last, _NONE, leaf(merges.rank(new, np.where(last, -1, wide[live, following])), at)
        )
        first = ahead < 0
        kept = np.where(first, at, ahead)  # without a symbol ahead its leaf is the one just set
        tree[live, size + kept] = np.where(
            first, tree[live, size + at], leaf(merges.rank(np.where(first, -1, wide[live, ahead]), new), kept)
        )
        inside = gone < size
        tree[live[inside], size + gone[inside]] = _NONE
        rows_up = np.concatenate([live, live, live[inside]])
        up = (size + np.concatenate([at, kept, gone[inside]])) >> 1
        while len(up) and up[0]:
            tree[rows_up, up] = np.minimum(tree[rows_up, 2 * up], tree[rows_up, 2 * up + 1])
            up >>= 1
        live = live[tree[live, 1] < _NONE]
    symbols[:] = wide[:, :-1]


def merge_long(symbols: list[int], merges: Merges) -> list[int]:
    """The same merges on one long piece, its tree in a list."""
    n, size = len(symbols), 1 << (len(symbols) - 2).bit_length()
    bits, known = size.bit_length(), merges.by_pair()
    symbols, made, width = list(symbols), merges.made.tolist(), merges.width
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(place: int, right: int) -> int:
        rank = known.get(symbols[place] * width + symbols[right])
        return _NONE if rank is None else rank << bits | place

    tree = [_NONE] * size + [pair(i, i + 1) for i in range(n - 1)] + [_NONE] * (size - n + 1)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(place: int, value: int) -> None:
        node = size + place
        while tree[node] != value:
            tree[node] = value
            if node == 1:
                return
            value = min(value, tree[node ^ 1])
            node >>= 1

    while (root := tree[1]) != _NONE:
        at = root & ((1 << bits) - 1)
        gone = after[at]
        symbols[at], symbols[gone] = made[root >> bits], -1
        following = after[at] = after[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if following < n:
            before[following] = at
        put(at, pair(at, following) if following < n else _NONE)
        if before[at] >= 0:
            put(before[at], pair(before[at], at))
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """A byte-level BPE file of the tokenizers format: ids, merges, added tokens.

    Files that ask for anything else (a normalizer, dropout, marks of word parts, trimming added
    tokens) raise ``ValueError``: their results would differ.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
               "fuse_unk", "byte_fallback", "ignore_merges")
        if (
            model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel"
            or spec.get("normalizer") or any(model.get(k) for k in odd)
        ):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take more than their own text")
        ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        self.letters = byte_letters()
        self.of_byte = np.array([ids.get(letter, -1) for letter in self.letters], np.int64)
        if (self.of_byte < 0).any():
            raise ValueError(f"{path} has no token for some byte")
        self.width = max(ids.values()) + 1
        both = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in both], self.width)
        byte = {letter: b for b, letter in enumerate(self.letters)}
        self.bytes_of = [b""] * (max([self.width - 1, *self.added.values()]) + 1)
        for token, number in ids.items():
            self.bytes_of[number] = bytes(byte[c] for c in token)
        for token, number in self.added.items():
            known = all(c in byte for c in token)
            self.bytes_of[number] = bytes(byte[c] for c in token) if known else token.encode()
        longest = sorted(self.added, key=len, reverse=True)
        self.split_added = (
            regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None
        )
        self.split = pre_tokenizers.ByteLevel(
            add_prefix_space=split.get("add_prefix_space", False),
            use_regex=split.get("use_regex", True),
        ).pre_tokenize_str
        # units are cut where the pattern ends a match; without pattern or with a space put before,
        # a text is one unit
        self.by_units = split.get("use_regex", True) and not split.get("add_prefix_space", False)


class Tokenizer:
    """Texts to ids and back, many at a time, with units seen lately remembered."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.names = [str(i) for i in range(len(self.vocabulary.bytes_of))]
        #: decimal ids with a comma between and the bytes these ids stand for: by match of the
        #: pattern that is no unit, and by unit
        self.pieces = Memory(self._code, MAX_PIECES)
        self.told = Memory(self._tell, MAX_UNITS)

    def _code(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        names, table = self.names, self.vocabulary.bytes_of
        return [
            (",".join([names[i] for i in ids]), b"".join([table[i] for i in ids]))
            for ids in self._merge([piece.encode() for piece in pieces])
        ]

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of matches of the pattern; pieces of like length share the arrays of one forest."""
        v, found = self.vocabulary, [[]] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > SMALL:
                found[i] = merge_long(v.of_byte[np.frombuffer(piece, np.uint8)].tolist(), v.merges)
            else:
                classes.setdefault(1 << max(0, len(piece) - 2).bit_length(), []).append(i)
        for size, members in classes.items():
            step = max(1, FOREST // size)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                lengths = np.array([len(pieces[i]) for i in part])
                symbols = np.full((len(part), size + 1), -1, np.int64)
                inside = np.arange(size + 1) < lengths[:, None]
                data = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)
                symbols[inside] = v.of_byte[data]
                merge(symbols, v.merges)
                kept = symbols >= 0
                ids = symbols[kept].tolist()
                at = 0
                for i, n in zip(part, kept.sum(axis=1).tolist()):
                    found[i] = ids[at : at + n]
                    at += n
        return found

    def _tell(self, fresh: list[str]) -> list[tuple[str, bytes]]:
        split, plain, parts, words = self.vocabulary.split, self.vocabulary.by_units, {}, []
        for unit in fresh:
            if is_word(unit):
                words.append(unit)
            elif plain and unit.isascii() and unit.isprintable():
                parts[unit] = _ASCII(unit)
            else:
                parts[unit] = [unit[a:b] for _, (a, b) in split(unit)]
        self.pieces.learn(parts.values())
        known, get = dict(zip(words, self._code(words))), self.pieces.get
        for unit, pieces in parts.items():
            told = list(map(get, pieces))
            known[unit] = ",".join([x[0] for x in told]), b"".join([x[1] for x in told])
        return [known[unit] for unit in fresh]

    def _portions(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, list[str]]]]:
        """``(place, added id or -1, units)`` in the order of the texts; the units of a portion
        are known when it is given out."""
        v = self.vocabulary
        parts: list[tuple[int, int, str]] = []
        for place, text in enumerate(texts):
            for k, part in enumerate(v.split_added(text or "") if v.split_added else [text or ""]):
                if k % 2:
                    parts.append((place, v.added[part], ""))
                elif part:
                    parts.append((place, -1, part))
        if v.by_units:
            last = 0  # added tokens have no units: give them out with the part that follows
            for portion in portions(part for *_, part in parts):
                self.told.learn(found for _, found in portion)
                out = []
                for i, found in portion:
                    out += [(*parts[j][:2], []) for j in range(last, i) if parts[j][1] >= 0]
                    out.append((parts[i][0], -1, found))
                    last = i + 1
                yield out
            yield [(*parts[j][:2], []) for j in range(last, len(parts))]
        else:
            for place, added, part in parts:
                self.told.learn([[part]] if part else [])
                yield [(place, added, [part] if part else [])]

    @no_collector()
    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids: list[list[int]] = [[] for _ in texts]
        for portion in self._portions(texts):
            for place, added, found in portion:
                if added >= 0:
                    ids[place].append(added)
                for unit in found:
                    ids[place] += map(int, self.told.get(unit)[0].split(","))
        return ids

    def decode(self, ids) -> str:
        """Text of the ids; broken UTF-8 gives U+FFFD."""
        table = self.vocabulary.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    @no_collector()
    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of their decimal list and of the decoded text, of each text; the
        ids and bytes of each window go into the digests at once."""
        done = [Digest(",") for _ in texts]
        for portion in self._portions(texts):
            for place, added, found in portion:
                if added >= 0:
                    done[place].add([(self.names[added], self.vocabulary.bytes_of[added])])
                if found:
                    done[place].add(list(map(self.told.get, found)))
        return [d.end() for d in done]


_OPEN: dict[str, Tokenizer] = {}  # per worker: tables by file


def tokenizer(path: str) -> Tokenizer:
    if path not in _OPEN:
        _OPEN[path] = Tokenizer(path)
    return _OPEN[path]


def encode(text: Column, path: str) -> Column:
    """Token ids of a text column as ``array<int>``; null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(path).encode(list(texts)), dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an ``array<int>`` column; null gives an empty text, broken UTF-8 gives U+FFFD."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        run = tokenizer(path).decode
        return pd.Series(["" if x is None else run(x) for x in lists], dtype=object)

    return text(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, texts encoded and decoded.

    One row per row, no shuffle: repeated rows and null ids stay, null texts count as empty, other columns
    are left out whatever their names. An empty table gives no rows. Text of an added token
    becomes that token, as in the library. A worker holds one window of a text besides the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = tokenizer(path).digests
        for batch in batches:
            found = digests(batch.column("text").to_pylist())
            counts, listed, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(listed, pa.string()), pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
