"""Vectors in blocks: every query row meets every block that it asks for, in bounded memory.

Rows of one key (a label, a partition of an index) are laid down in blocks of ``BLOCK_BYTES``; up to
``GROUP_BLOCKS`` blocks make a group, the unit that a task holds. Query rows are sent to the groups they
visit and stream through them. A group that very many queries visit is dealt to several tasks, each with a
copy of the group and a share of the queries, so neither a hot key nor a hot group meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm import shared

BLOCK_BYTES = 1 << 16
GROUP_BLOCKS = 128
VISITS = 1 << 16
QUERIES = 128

#: What a task does with the blocks of a group and some queries: rows of result columns.
Work = Callable[[list[dict], list[dict]], list[tuple]]


def finite(vector: str) -> Column:
    """Is the vector there, with every component there and finite? ``NaN`` is above all numbers in Spark's order."""
    bound = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < bound)), F.lit(False)
    )


def as_bytes(*numbers: Column) -> Column:
    """Whole numbers as bytes, least first, as numpy reads them."""
    digits = [F.lpad(F.hex(n.cast("long")), 16, "0") for n in numbers]
    return F.unhex(F.concat(*[F.substring(d, k, 2) for d in digits for k in range(15, 0, -2)]))


def shaped(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` vectors of a block."""
    return np.frombuffer(raw, np.float64).reshape(n, len(raw) // 8 // n)


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array<double> column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), offsets


def blocks(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], note: Callable[[np.ndarray], bytes] | None = None,
    few: bool = False,
) -> DataFrame:
    """(grp, *keys, n, ids, vecs, note) of rows (*keys, *order, id, vec): whole numbers as keys, vec as float64 bytes.

    A block and a group have rows of one key only; rows lie in ``order``. ``note`` describes a block's vectors.
    ``few``: the rows are of a bounded number and are laid down by one task, in as few groups as can be.
    """
    kinds = [f"{k} long" for k in keys]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, laid, key, ids, vecs = (TaskContext.get().partitionId() << 32) - 1, GROUP_BLOCKS, None, [], []

        def block() -> tuple:
            raw = b"".join(vecs)
            told = note(shaped(raw, len(ids))) if note else b""
            return (counter, *key, len(ids), np.array(ids, np.int64).tobytes(), raw, told)

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for *own, i, v in zip(*columns):
                own = tuple(own)
                if ids and (own != key or len(v) != len(vecs[0]) or (len(ids) + 1) * (len(v) + 8) > BLOCK_BYTES):
                    out.append(block())
                    laid, ids, vecs = laid + 1, [], []
                if not ids and (own != key or laid >= GROUP_BLOCKS):
                    counter, laid = counter + 1, 0
                key = own
                ids.append(i)
                vecs.append(v)
            if out:
                yield _batch(out, names)
        if ids:
            yield _batch([block()], names)

    names = ["grp", *keys, "n", "ids", "vecs", "note"]
    dealt = rows.repartition(1) if few else rows.repartitionByRange(*keys, *order)
    ordered = dealt.sortWithinPartitions(*keys, *order)
    schema = f"grp long, {', '.join(kinds)}, n int, ids binary, vecs binary, note binary"
    return ordered.select(*keys, "id", "vec").mapInArrow(pack, schema)


def _batch(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    kinds = {int: pa.int64(), float: pa.float64(), bytes: pa.binary()}
    columns = [pa.array([r[c] for r in rows], kinds[type(rows[0][c])]) for c in range(len(names))]
    if "n" in names:
        columns[names.index("n")] = columns[names.index("n")].cast(pa.int32())
    return pa.RecordBatch.from_arrays(columns, list(names))


def met(laid: DataFrame, visits: DataFrame, work: Work, schema: str, visits_a_task: int | None = None) -> DataFrame:
    """Run ``work`` on each group of ``laid`` with the queries that visit it; ``schema`` (long, double) is its results'.

    visits: (grp, query long, vec binary, state binary), one row for each query and group.
    """
    columns = [c.split()[0] for c in schema.split(",")]
    visits = shared.written(visits.select("grp", "query", "vec", "state"), "visits")
    asked = visits.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / (visits_a_task or VISITS)).cast("int").alias("turns"))
    of_group = laid.join(asked, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("query"), F.col("ids").alias("a"), F.col("vecs").alias("b"), F.col("note").alias("c"),
    )
    of_query = visits.join(asked, "grp").select(
        "grp", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int").alias("turn"), F.lit(1).alias("kind"),
        "query", F.col("vec").alias("a"), F.col("state").alias("b"), F.lit(None).cast("binary").alias("c"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting = None, [], []

        def answer() -> pa.RecordBatch | None:
            found = work(held, waiting) if waiting and held else []
            return _batch(found, columns) if found else None

        for batch in batches:
            grp, turn, kind, query, a, b, c = (batch.column(k).to_pylist() for k in range(7))
            for row in range(batch.num_rows):
                if (grp[row], turn[row]) != at or len(waiting) >= QUERIES:
                    if (out := answer()) is not None:
                        yield out
                    waiting = []
                if (grp[row], turn[row]) != at:
                    at, held = (grp[row], turn[row]), []
                if kind[row] == 0:
                    ids = np.frombuffer(a[row], np.int64)
                    held.append({"ids": ids, "vecs": shaped(b[row], len(ids)), "note": c[row]})
                else:
                    waiting.append({"query": query[row], "vec": np.frombuffer(a[row], np.float64), "state": b[row]})
        if (out := answer()) is not None:
            yield out

    dealt = of_group.unionByName(of_query).repartition("grp", "turn").sortWithinPartitions("grp", "turn", "kind", "query")
    return dealt.mapInArrow(run, schema)
