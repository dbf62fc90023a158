"""A table that grows batch by batch, kept in few segments.

After batch b the batches 0..b lie in as many segments as b + 1 has ones in binary: batch 6 leaves [0, 4), [4, 6) and
[6, 7). A batch writes one segment, its own rows merged with the neighbours that segment takes in, so it reads at most
log2(b) segments and every row is rewritten log2(b) times at most. Segments are named by their batches: a batch that is
run again writes the same one again, and what it was merged from stays until the next batch begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def covering(batches: int) -> list[tuple[int, int]]:
    """The segments [start, end) that hold the first ``batches`` batches."""
    out, start = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            out.append((start, start + (1 << bit)))
            start += 1 << bit
    return out


class Segments:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, segment: tuple[int, int]) -> str:
        return f"{self.folder}/batches={segment[0]}-{segment[1]}"

    def read(self, schema, batches: int) -> DataFrame | None:
        """All rows of the first ``batches`` batches; None if there is no batch."""
        paths = [self._path(s) for s in covering(batches)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def add(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Write the segment that ends with ``batch``: ``merge`` of its rows and those of the segments it takes in."""
        new, known = covering(batch + 1)[-1], covering(batch)
        inner = [s for s in known if s[0] >= new[0]]
        if inner:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*[self._path(s) for s in inner]))
        merge(rows).write.mode("overwrite").parquet(self._path(new))

    def clean(self, batch: int) -> None:
        """At the beginning of ``batch``: delete what the batches before it have merged into other segments."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return
        keep = {self._path(s).rpartition("/")[2] for s in covering(batch)}
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("batches=") and name not in keep:
                files.delete(status.getPath(), True)
