"""Ranked lexical search by the Best Position Algorithm over impact lists.

Every term of a query has a list of documents by falling impact. The lists are read side by side; a
document met for the first time is looked up in all other lists at once, which marks its places there as
seen too. A list's best position ends its unbroken run of seen places, so no unseen document has more in
that list than the place behind it. Reading stops when these impacts add up to less than the k-th
best score: strictly less, as an equal score may still win by its id.

Documents are searched where they lie: each task builds the lists of one shard after the other and
carries the k-th best scores on, so that later shards stop sooner; only every task's best rows are
shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: What terms consist of, in SQL; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of a text cut into terms together.
WINDOW = 1 << 20
#: Documents, and postings, of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: Places that are first read in each list; every round reads twice as many.
FIRST_READ = 32
#: Places looked at together for the end of a run.
AHEAD = 64
#: Queries, and characters of their texts, that are searched together.
BLOCK_ITEMS, BLOCK_CHARS = 1024, 1 << 22
TOP = 50

#: Per byte of UTF-8: lower case of A-Z, a space for ASCII that is no letter or digit.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_CUT = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Parts of a text that end at a separator."""
    start = 0
    while start < len(text):
        found = _CUT.search(text, start + size)
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end


def terms(text: str | None, size: int = WINDOW) -> Counter:
    """Occurrences of every term of a text, as UTF-8."""
    found: Counter = Counter()
    for window in windows(text or "", size):
        found.update(window.encode().translate(_FOLD).split())
    return found


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every row with a term: ``n`` counts all its terms, the arrays hold
    places in ``vocabulary`` and occurrences of those it has."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            kept, sizes, places, tfs, counts = [], [0], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = terms(text.as_py())
                if not found:
                    continue
                kept.append(i)
                counts.append(found.total())
                both = place.keys() & found.keys()
                places += [place[t] for t in both]
                tfs += [found[t] for t in both]
                sizes.append(len(places))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(kept, pa.int64())),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>"
    )


class Shard:
    """Impact lists of some documents, and every document's places in them."""

    def __init__(self, weights: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        tfs = tfs.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner]))
        kept = impact > 0  # what adds nothing has no place in a list
        owner, term, impact = owner[kept], terms[kept], impact[kept]
        order = np.lexsort((owner, -impact, term))
        self.impact, self.doc = impact[order], owner[order]
        #: list of a term: places ``starts[term]`` to ``starts[term + 1]``
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        # direct access: the postings of a document, with their terms and places
        self.term = term
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.at = np.searchsorted(owner, np.arange(len(sizes) + 1))

    def best(self, query: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All documents that may be among the ``k`` best, with their scores; some may score less.

        ``query`` holds distinct terms; documents below ``least`` are of no interest.
        """
        query = query[self.starts[query + 1] > self.starts[query]]
        begin, end = self.starts[query], self.starts[query + 1]
        within = np.zeros(len(self.starts), bool)
        within[query] = True
        base = np.concatenate([[0], np.cumsum(end - begin)])  # the lists, one after the other
        # a place of the shard as one of these lists: minus the list's shift
        shift = np.zeros(len(self.starts), np.int64)
        shift[query] = begin - base[:-1]
        seen = np.zeros(base[-1] + 1, bool)  # the last place never is
        met = np.zeros(len(self.at) - 1, bool)
        position = base[:-1].copy()  # the first unseen place of each list
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_READ
        while len(query):
            # sorted access: the next places of every list
            low, high = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            if not (high > low).any():
                break
            new = np.unique(self.doc[_ranges(low, high)])
            new = new[~met[new]]
            met[new] = True
            # direct access: all postings of the new documents
            rows = _ranges(self.at[new], self.at[new + 1])
            of = np.repeat(np.arange(len(new)), self.at[new + 1] - self.at[new])
            asked = within[self.term[rows]]
            rows, of = rows[asked], of[asked]
            places = self.place[rows]
            seen[places - shift[self.term[rows]]] = True
            running = np.concatenate([[0], np.cumsum(self.impact[places])])
            cuts = np.searchsorted(of, np.arange(len(new) + 1))
            docs = np.concatenate([docs, new])
            scores = np.concatenate([scores, running[cuts[1:]] - running[cuts[:-1]]])
            # best positions: over the places that are seen without a break
            depth += step
            step *= 2
            position = np.maximum(position, np.minimum(base[:-1] + depth, base[1:]))
            moving = np.flatnonzero(position < base[1:])
            while len(moving):
                ahead = position[moving, None] + np.arange(AHEAD)
                ahead = seen[np.where(ahead < base[1:][moving, None], ahead, -1)]
                run = np.where(ahead.all(axis=1), AHEAD, ahead.argmin(axis=1))
                position[moving] += run
                moving = moving[run == AHEAD]
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            open_ = position < base[1:]
            bound = int(self.impact[(position - base[:-1] + begin)[open_]].sum())
            if bound < least:
                break
        kept = scores >= least
        return docs[kept], scores[kept]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = high - low
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(low - (ends - sizes), sizes)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n_rows, n_postings = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            held.append(part)
            n_rows += part.num_rows
            n_postings += len(part.column("terms").flatten())
            if n_rows >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n_rows, n_postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _order(row: tuple) -> tuple:
    """Highest score first, then smaller ids, null ids last."""
    doc, score = row
    return (-score, doc is None, 0 if doc is None else doc)


def _best_rows(found: DataFrame, stats: tuple[int, int], weights: np.ndarray, queries: list, k: int) -> DataFrame:
    """``query, doc_id, score``: of every task the ``k`` best rows of each query."""
    shared = found.sparkSession.sparkContext.broadcast((weights, queries))
    n_docs, length = stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        best: list[list] = [[] for _ in queries]
        least = [1] * len(queries)
        kind = None
        for table in _shards(batches):
            column = lambda name: table.column(name).chunk(0)
            kind, ids, lists = column("doc_id").type, column("doc_id").to_pylist(), column("terms")
            shard = Shard(
                weights,
                np.array([50 + 50 * n * n_docs // length for n in column("n").to_pylist()], np.int64),
                lists.value_lengths().to_numpy(zero_copy_only=False),
                lists.flatten().to_numpy(zero_copy_only=False),
                column("tfs").flatten().to_numpy(zero_copy_only=False),
            )
            for q, query in enumerate(queries):
                docs, scores = shard.best(query, k, least[q])
                rows = best[q] + [(ids[d], s) for d, s in zip(docs.tolist(), scores.tolist())]
                best[q] = sorted(rows, key=_order)[:k]
                if len(best[q]) == k:
                    least[q] = best[q][-1][1]
        if kind is not None:
            rows = [(q, doc, score) for q, found in enumerate(best) for doc, score in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, *_ in rows], pa.int32()),
                    pa.array([doc for _, doc, _ in rows], kind),
                    pa.array([score for *_, score in rows], pa.int64()),
                ],
                names=["query", "doc_id", "score"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"query int, doc_id {kind}, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """``(item_id, terms)`` of the queries, so many at a time as one search takes."""
    held, size = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        held.append((item_id, sorted(terms(text))))
        size += len(text or "")
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: of every item the ``k`` best documents with a score above 0.

    Every row of either table is a document or an item of its own, repeated rows too; equal scores
    go by ascending ``doc_id``, null ids last. Null texts and texts without terms neither match
    nor count. Other columns are left out whatever their names; an empty table gives no rows.

    The queries are taken in blocks of ``BLOCK_ITEMS``; a block's terms and their numbers of
    documents are all that passes through the driver. For each block the documents are read once into
    postings of its terms, and these are searched where they were written.
    """
    spark = docs.sparkSession
    item_kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    for block in _blocks(items):
        vocabulary = sorted({term for _, found in block for term in found})
        place = {term: i for i, term in enumerate(vocabulary)}
        found = cut(postings(docs, vocabulary), "postings")
        n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
        if not vocabulary or not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, count in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = count
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()])
        queries = [np.array([place[t] for t in found_terms], np.int64) for _, found_terms in block]
        rows = _best_rows(found, (n_docs, length), weights, queries, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ids = spark.createDataFrame(
            [(q, item_id) for q, (item_id, _) in enumerate(block)], f"query int, item_id {item_kind}"
        )
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        result = result.unionByName(
            ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
        )
    return result


def oracle_sql() -> str:
    fold = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({fold}, '{TERM}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ts
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS length FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
o AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // length))))::BIGINT AS score
  FROM q JOIN o USING (term) JOIN f USING (term) CROSS JOIN k GROUP BY item_id, r, doc_id),
x AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
    doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM x WHERE rank <= {TOP}"""
