"""State by key that micro-batches write: deltas, and tables that sum them up from time to time.

Every batch writes one delta; every ``every`` batches the deltas since the last table, and that
table's rows that may still change, become a new table. Rows that no later batch changes are written
into it once and stay where they are. So a batch costs its own rows, a table those of the keys still
open, and a reader merges open keys and a few deltas only. A batch that runs again replaces its own
delta and never sees itself or later ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import folders, remove

_DONE = "_done"


class BatchStore:
    """``merge`` reduces rows to one a key and may be applied to its own results; ``final`` tells,
    over its columns, the rows that no later batch changes."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        merge: Callable[[DataFrame], DataFrame],
        schema: T.StructType,
        *,
        final: Column | None = None,
        every: int = 16,
    ):
        self._spark, self._path, self._merge, self._schema = spark, path, merge, schema
        self._final = F.lit(False) if final is None else F.coalesce(final, F.lit(False))
        self._every = every

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Store what one batch adds; the same batch again replaces it."""
        self._merge(batch).write.mode("overwrite").parquet(f"{self._path}/delta/{batch_id:012d}")
        if batch_id % self._every == self._every - 1:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Sum up the batches to ``batch_id`` in a table; what the table before the last one stood
        for is deleted."""
        tables = [t for t in self._tables() if t < batch_id]
        rows = self._merge(self._open(tables, batch_id + 1)).withColumn(_DONE, self._final)
        rows.write.mode("overwrite").partitionBy(_DONE).parquet(f"{self._path}/table/{batch_id:012d}")
        if tables:
            for delta in self._deltas():
                if delta <= tables[-1]:
                    remove(self._spark, f"{self._path}/delta/{delta:012d}")
            for table in tables[:-1]:
                remove(self._spark, f"{self._path}/table/{table:012d}/{_DONE}=false")

    def read(self, before: int | None = None) -> DataFrame:
        """One row a key, as the batches before ``before`` (all, if it is None) left it."""
        end = 1 << 62 if before is None else before
        tables = [t for t in self._tables() if t < end]
        settled = self._rows([f"table/{t:012d}/{_DONE}=true" for t in tables])
        return settled.unionByName(self._merge(self._open(tables, end)))

    def _open(self, tables: list[int], end: int) -> DataFrame:
        since = tables[-1] if tables else -1
        parts = [f"delta/{d:012d}" for d in self._deltas() if since < d < end]
        if tables:
            parts.append(f"table/{since:012d}/{_DONE}=false")
        return self._rows(parts)

    def _rows(self, parts: list[str]) -> DataFrame:
        there = [f"{self._path}/{p}" for p in parts if not p.startswith("table") or self._has(p)]
        if not there:
            # known to be empty when a plan is made, so that nothing is shuffled to join it
            return self._spark.createDataFrame([], self._schema).where(F.lit(False))
        return self._spark.read.schema(self._schema).parquet(*there)

    def _has(self, part: str) -> bool:
        folder, name = part.rsplit("/", 1)
        return name in folders(self._spark, f"{self._path}/{folder}")

    def _tables(self) -> list[int]:
        return [int(t) for t in folders(self._spark, f"{self._path}/table", written=True)]

    def _deltas(self) -> list[int]:
        return [int(d) for d in folders(self._spark, f"{self._path}/delta", written=True)]
