"""Tables in the shared folder, packed texts and connected classes, used by several operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armscope.session import new_folder


Batch = TypeVar("Batch")
#: The most bits of a ``Sieve``: 32 MB.
SIEVE_BITS = 1 << 28
#: For files of few large rows that are compressed already. A page ends with the row that fills it, not after 100 rows at
#: least, and is not compressed again: the codec would hold whole pages in direct memory.
COMPACT = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Tables that a stage of a pipeline has left for its result to read; None outside of stages.
_LEFT: list[DataFrame] = []
_IN_STAGE = False


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives executors.

    ``compact``: its rows are large and compressed already.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**COMPACT if compact else {}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _IN_STAGE:
        _LEFT.append(out)
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing that is still to run reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _LEFT[:] = [t for t in _LEFT if t.written_to != table.written_to]


@contextmanager
def stage(docs: DataFrame) -> Iterator[None]:
    """Around one stage of a pipeline, whose input ``docs`` is a written table.

    A stage's result reads tables that the stage wrote, so they stay until it has been written itself: the next
    stage deletes them, unless its own input reads them.
    """
    global _IN_STAGE
    read = docs.inputFiles()
    for table in list(_LEFT):
        if not any(table.written_to.rpartition("/")[2] in file for file in read):
            discard(table)
    release(docs.sparkSession)
    _IN_STAGE = True
    try:
        yield
    finally:
        _IN_STAGE = False


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, packed): the text's bytes, compressed, so that a shuffle of whole texts stays small. Null: empty."""
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in lean(batches):
            bodies = [press.compress(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["key", "packed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        pack, f"key {kind}, packed binary"
    ).withColumnRenamed("key", key)


def unpacked(bodies: list[bytes]) -> list[bytes]:
    loosen = zstandard.ZstdDecompressor()
    return [loosen.decompress(b) for b in bodies]


def lean(batches: Iterator[Batch]) -> Iterator[Batch]:
    """The batches, of Arrow or pandas; after each one the worker gives back to the system what its allocators hold free.

    Spark keeps Python workers from task to task: else each holds the most that any step before has taken.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


class Sieve:
    """Bits of a set of 64-bit hashes: never misses a member, lets some others through."""

    def __init__(self, spark: SparkSession, hashes: DataFrame) -> None:
        """hashes: (h long), counted and combined in Spark; at most ``SIEVE_BITS`` bits come to the driver."""
        size = max(1 << 16, min(SIEVE_BITS, 1 << (16 * hashes.count()).bit_length()))
        places = F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1))
        fields = (
            hashes.select(F.explode(places).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("at"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))).alias("bits"))
        )
        found, bits = fields.toArrow(), np.zeros(size // 64, np.int64)
        bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
        self.sent, self.mask = spark.sparkContext.broadcast(bits.view(np.uint64)), np.uint64(size - 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bits, out = self.sent.value, np.ones(len(hashes), bool)
        for place in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            out &= ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def sifted(rows: DataFrame, sieve: Sieve) -> DataFrame:
    """The rows whose last column, a hash, passes; without that column."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            passes = sieve.passes(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(passes))

    return rows.mapInArrow(sift, rows.schema).drop(rows.columns[-1])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b), written: the smallest node that can be reached.

    Large-star and small-star by turns: each round is two grouped joins over the links, and the number of
    rounds grows with the logarithm of the longest chain. A node with very many links is never gathered:
    minima are combined before the shuffle. No links: no rows. Raises if ``max_rounds`` do not suffice.
    A round's table is deleted when the next one is written.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # both directions; each node sends its neighbours to the smallest of itself and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = both.join(least, "a")
        if large:
            return to.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = to.select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        return moved.unionByName(own).where("a <> b").distinct()

    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    count = lambda df: tuple(
        df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    )
    before = count(edges)
    for _ in range(max_rounds):
        old, edges = edges, written(star(star(edges, True), False), "links")
        discard(old)
        after = count(edges)
        if after == before:
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
            out = written(found, "components")
            discard(edges)
            return out
        before = after
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tagged(docs: DataFrame, in_order: bool = False) -> DataFrame:
    """(row, doc_id, packed), written: row is a unique number; ``in_order``: ascending with doc_id, nulls first.

    Rows of one id follow each other by the hash of their text.
    """
    body = packed(docs.select("doc_id", "text"))
    if in_order:
        body = body.withColumn("h", F.xxhash64("packed")).repartitionByRange("doc_id", "h")
        body = body.sortWithinPartitions("doc_id", "h").drop("h")
    out = written(body.select(F.monotonically_increasing_id().alias("row"), "doc_id", "packed"), "tagged")
    release(docs.sparkSession)
    return out
