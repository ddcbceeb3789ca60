"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

A tokenisation is the right one exactly when every token encodes to itself and every two
neighbours encode to themselves. So each prefix of a piece has one last token, which follows from the
last tokens of shorter prefixes, and reading left to right needs no merge loop. The
transducer's state is the longest end of what it read that a token may begin with, so there are no more
states than beginnings of tokens; it gives the tokens that end at a byte, of which one fits behind the last
token of the prefix before it. The last tokens, read from the end, are the tokenisation. Transitions, and
which tokens fit together, are found when first met; many pieces are read together, byte by byte.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_units import Memory, is_word, no_collector, portions

#: States that a worker keeps before it starts afresh.
MAX_STATES = 1 << 15
#: Pairs of neighbours remembered, a power of two; a pair takes the place of another one.
PAIRS = 1 << 20
#: Bytes of a piece that is read together with others, and how many pieces are.
SMALL, ROWS = 64, 1 << 14
#: Matches of the pattern remembered beside the units.
MAX_PIECES = 50_000
#: Units of text remembered.
MAX_UNITS = 400_000
#: Tokens given to the UTF-8 machine at a time.
STEP = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        #: bit 1: a token that encodes to itself, bit 2: a proper beginning of a token
        self.kind = dict.fromkeys((t[:i] for t in ranks for i in range(1, len(t))), 2)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.width = max(ranks.values(), default=0) + 1
        #: the two tokens whose merge makes a token; bytes have none
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for token in ranks:
            if len(self.merge(token)) == 1:
                self.kind[token] = self.kind.get(token, 0) | 1
        self._lengths = np.zeros(self.width, np.int64)
        self._lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        #: by a hash of left rank * width + right rank: that number, and whether the two may be neighbours
        self._pairs = np.full(PAIRS, -1, np.int64)
        self._fit = np.zeros(PAIRS, bool)
        self._forget()

    def _forget(self) -> None:
        #: a state: the longest end of what was read that is a token or a beginning of one
        self._states = [b""]
        self._ids = {b"": 0}
        #: by state * 256 + byte: the next state, -1 where it was never asked for
        self._next = np.full(256, -1, np.int32)
        #: by state: place in ``_ends`` of the tokens that end here, the longest first, rank -1 after them
        self._first = np.zeros(1, np.int64)
        self._ends = np.full(1, -1, np.int64)
        self._filled = 1

    @staticmethod
    def _room(held: np.ndarray, size: int) -> np.ndarray:
        """The array, twice as long as often as ``size`` asks for."""
        while len(held) < size:
            held = np.concatenate([held, np.full(len(held), -1, held.dtype)])
        return held

    def merge(self, data: bytes) -> list[bytes]:
        """The merges on a few bytes, lowest rank first; remembers the last merge of a token."""
        none, rank = 1 << 60, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        cost = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while cost and (least := min(cost)) < none:
            i = cost.index(least)
            if len(parts) == 2:
                self.halves[data] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(cost):
                cost[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Whether no merge ever reaches over the place between two tokens.

        The merges of both are undone from the last to the first. Between two of them, the pieces
        that touch there must not make a token of a rank that would have come before the merge
        undone last; of equal ranks the one further left comes first.
        """
        rank, halves = self.ranks, self.halves
        limit = 1 << 60  # a token over the place wins if its rank is below this
        while True:
            over = rank.get(left + right)
            if over is not None and over < limit:
                return False
            at_left, at_right = halves.get(left), halves.get(right)
            if at_left is None and at_right is None:
                return True
            # the later merge of the two is undone; on the left an equal rank came first
            if at_right is None or at_left is not None and rank[left] > rank[right]:
                limit, left = rank[left], at_left[1]
            else:
                limit, right = rank[right] + 1, at_right[0]

    def _step(self, key: int) -> int:
        """Build the transition of state ``key >> 8`` on byte ``key & 255``."""
        read, name, ends = self._states[key >> 8] + bytes((key & 255,)), b"", []
        for at in range(len(read)):
            token = read[at:]
            kind = self.kind.get(token, 0)
            if kind:
                name = name or token
                if kind & 1:
                    ends.append(self.ranks[token])
        state = self._ids.get(name)
        if state is None:
            state = self._ids[name] = len(self._states)
            self._states.append(name)
            self._next = self._room(self._next, len(self._states) * 256)
            self._first = self._room(self._first, len(self._states))
            self._ends = self._room(self._ends, self._filled + len(ends) + 1)
            self._first[state] = self._filled
            self._ends[self._filled : self._filled + len(ends)] = ends
            self._filled += len(ends) + 1
        self._next[key] = state
        return state

    def _may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """Whether left and right rank of each pair (left * width + right) may be neighbours."""
        slots = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIRS.bit_length() + 1)
        fit, fresh = self._fit[slots], self._pairs[slots] != pairs
        if fresh.any():
            asked, first, each = np.unique(pairs[fresh], return_index=True, return_inverse=True)
            tokens, width = self.tokens, self.width
            told = np.array([self._stays(tokens[p // width], tokens[p % width]) for p in asked.tolist()])
            fit[fresh] = told[each]
            at = slots[fresh][first]
            self._pairs[at], self._fit[at] = asked, told
        return fit

    def _last_tokens(self, pieces: list[bytes]) -> np.ndarray:
        """Rank of the last token of every prefix; the pieces come longest first."""
        lengths = np.array([len(piece) for piece in pieces])
        inside = np.arange(lengths[0]) < lengths[:, None]
        data = np.zeros(inside.shape, np.int64)
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full(inside.shape, -1, np.int64)
        states = np.zeros(len(pieces), np.int64)
        for place, rows in enumerate(inside.sum(axis=0).tolist()):
            keys = states[:rows] * 256 + data[:rows, place]
            to = self._next[keys]
            if (to < 0).any():
                for key in np.unique(keys[to < 0]).tolist():
                    self._step(key)
                to = self._next[keys]
            states[:rows] = to
            todo, at = np.arange(rows), self._first[to]
            while len(todo):
                ranks = self._ends[at]
                if (ranks < 0).any():
                    raise ValueError("no token ends at some byte")
                before = place - self._lengths[ranks]
                fit = before < 0  # the whole prefix
                asked = np.flatnonzero(~fit)
                left = last[todo[asked], before[asked]]
                fit[asked] = self._may_follow(left * self.width + ranks[asked])
                last[todo[fit], place] = ranks[fit]
                todo, at = todo[~fit], at[~fit] + 1
        return last

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of many pieces, read byte by byte together; longer ones are taken one by one."""
        if len(self._states) > MAX_STATES:
            self._forget()
        found, short = [[]] * len(pieces), []
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                found[i] = [self.ranks[piece]]  # a piece that is a token of its own is never merged
            elif len(piece) > SMALL:
                found[i] = self._encode_long(piece)
            elif piece:
                short.append(i)
        short.sort(key=lambda i: -len(pieces[i]))
        for start in range(0, len(short), ROWS):
            part = short[start : start + ROWS]
            last = self._last_tokens([pieces[i] for i in part])
            on_way = np.zeros(last.shape, bool)
            rows, place = np.arange(len(part)), (last >= 0).sum(axis=1) - 1
            while len(rows):
                on_way[rows, place] = True
                place = place - self._lengths[last[rows, place]]
                rows, place = rows[place >= 0], place[place >= 0]
            ids, end = last[on_way].tolist(), 0
            for i, n in zip(part, on_way.sum(axis=1).tolist()):
                found[i] = ids[end : end + n]
                end += n
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        return tuple(self.encode_all([piece])[0])

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same on one long piece."""
        steps: dict[int, int] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        fits: dict[tuple[int, int], bool] = {}
        state, last, tokens = 0, [], self.tokens
        for place, byte in enumerate(piece):
            key = state << 8 | byte
            state = steps.get(key)
            if state is None:
                state = int(self._next[key])
                state = steps[key] = self._step(key) if state < 0 else state
                if state not in ends:
                    first = int(self._first[state])
                    ranks = self._ends[first : first + len(self._states[state])].tolist()
                    ranks = ranks[: ranks.index(-1)] if -1 in ranks else ranks
                    ends[state] = [(len(tokens[r]), r) for r in ranks]
            for size, rank in ends[state]:
                if size > place:
                    break  # the whole prefix
                pair = last[place - size], rank
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self._stays(tokens[pair[0]], tokens[rank])
                if fit:
                    break
            else:
                raise ValueError("no token ends at some byte")
            last.append(rank)
        out, place = [], len(piece)
        while place:
            out.append(last[place - 1])
            place -= len(tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts to token ids; each match of the pattern goes through the transducer alone.

    Texts are taken in units that begin with white space after a visible character, where a match
    of the pattern ends; units and matches seen lately need no second look.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.names = {rank: str(rank) for rank in ranks.values()}
        #: decimal ids with a space between and the bytes these ids stand for: by match of the pattern
        #: that is no unit, and by unit
        self.pieces = Memory(self._tell_pieces, MAX_PIECES)
        self.told = Memory(self._tell, MAX_UNITS)

    def _coded(self, pieces: list[str]) -> Iterator[tuple[str, tuple[str, bytes]]]:
        names, table = self.names, self.machine.tokens
        for piece, ids in zip(pieces, self.machine.encode_all([piece.encode() for piece in pieces])):
            yield piece, (" ".join([names[i] for i in ids]), b"".join([table[i] for i in ids]))

    def _tell_pieces(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        lately, before, known = self.told.known.get, self.told.older.get, {}
        for piece in pieces:
            if is_word(piece) and (found := lately(piece) or before(piece)):
                known[piece] = found
        known.update(self._coded([piece for piece in pieces if piece not in known]))
        return [known[piece] for piece in pieces]

    def _tell(self, fresh: list[str]) -> list[tuple[str, bytes]]:
        findall, parts, words = self.pattern.findall, {}, []
        for unit in fresh:
            if is_word(unit):
                words.append(unit)
            else:
                parts[unit] = findall(unit)
        self.pieces.learn(parts.values())
        known, get = dict(self._coded(words)), self.pieces.get
        for unit, pieces in parts.items():
            told = list(map(get, pieces))
            known[unit] = " ".join([x[0] for x in told]), b"".join([x[1] for x in told])
        return [known[unit] for unit in fresh]

    def _portions(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        for portion in portions(texts):
            self.told.learn(found for _, found in portion)
            yield portion

    @no_collector()
    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids: list[list[int]] = [[] for _ in texts]
        for portion in self._portions(texts):
            for place, found in portion:
                for unit in found:
                    ids[place] += map(int, self.told.get(unit)[0].split())
        return ids

    @no_collector()
    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of their decimal list and of the decoded text, of each text; the
        ids and bytes of each window go into the digests at once."""
        done = [Digest(" ") for _ in texts]
        for portion in self._portions(texts):
            for place, found in portion:
                done[place].add(list(map(self.told.get, found)))
        return [d.end() for d in done]


class Digest:
    """Running digests of one text: of its decimal ids, and of what they decode to; decoding keeps
    the bytes of an open character."""

    def __init__(self, between: str) -> None:
        self.between = between
        self.count, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.stream = Utf8Stream()

    def add(self, told: list[tuple[str, bytes]]) -> None:
        """What follows: decimal ids and the bytes these stand for."""
        ids = self.between.join([x[0] for x in told])
        self.ids.update((self.between + ids if self.count else ids).encode())
        self.count += ids.count(self.between) + 1
        self.text.update(self.stream.push(b"".join([x[1] for x in told])).encode())

    def end(self) -> tuple[int, str, str]:
        self.text.update(self.stream.close().encode())
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


class Utf8Stream:
    """Incremental UTF-8: bytes in any portions in, text out; holds 3 bytes at most."""

    #: Bytes of a character by the upper 5 bits of its first byte; 0: no first byte.
    LENGTHS = tuple([1] * 16 + [0] * 8 + [2] * 4 + [3] * 2 + [4] + [0])

    def __init__(self) -> None:
        self.open = b""

    def push(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            need = self.LENGTHS[data[-back] >> 3]
            if need:
                if need > back:
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_ids(ids, vocabulary: list[bytes]) -> str:
    stream = Utf8Stream()
    parts = [
        stream.push(b"".join([vocabulary[i] for i in ids[at : at + STEP]]))
        for at in range(0, len(ids), STEP)
    ]
    return "".join(parts) + stream.close()


_OPEN: dict = {}  # per worker: compiled tables by file and pattern


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = Encoder(read_ranks(path), pattern)
    return _OPEN[path, pattern]


def forget() -> None:
    """Give back the tables of this worker; an encoder and its memories refer to each other, so only
    the collector frees them."""
    _OPEN.clear()
    gc.collect()


def _vocabulary(path: str) -> list[bytes]:
    if path not in _OPEN:
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _OPEN[path] = table
    return _OPEN[path]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text column as ``array<int>``; null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(_encoder(path, pattern).encode(list(texts)), dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an ``array<int>`` column; null gives an empty text, broken UTF-8 gives U+FFFD."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        table = _vocabulary(path)
        return pd.Series([decode_ids([] if x is None else x, table) for x in lists], dtype=object)

    return text(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, *, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, texts encoded and decoded.

    One row per row: repeated rows and null ids stay, null texts count as empty, no shuffle. An empty
    table gives no rows. One window of a text is held besides the text, and only the digests leave the
    worker. With ``keep`` a worker remembers units and transitions for its next task; without, an
    idle worker holds none of them beside the stages that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _encoder(path, pattern).digests
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
        if not keep:
            del digests
            forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
