"""Mixing sources to target weights, by blocks.

1. The words of a source form one line, document after document, cut into blocks of ``block`` words.
2. The mix is a row of slots, cut into output shards. How many slots of a shard each source gets is drawn
   from the multinomial law, conditioned on the totals that the targets fix (a multivariate hypergeometric
   law). The draws form a binary tree seeded by its nodes, so a shard computes its own counts and where they
   begin, without the other shards.
3. Slot k of a source takes block p(k mod n), p being a keyed permutation of the source's n blocks for each
   round k div n. No block is taken more than once a round.
4. Slots and documents are joined by source and block index.

Every step is a function of the seed and the data: reruns agree. A hot source is no hot task: positions are
prefix sums over bins of a source, and joins are by block.

The list of sources, one short row each, goes to the driver (at most ``max_sources``, else an error).
Defined cases: null or empty text has size 0 and takes 0. A null source is a source, the last one. Repeated
rows are separate rows. Null ids are kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armscope.llm import shared, words


@dataclass(frozen=True)
class MixSpec:
    """``share``: words of the mix over words there are; ``most``: times a source's size a target may reach."""

    weights: Sequence[float] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block: int = 128
    shard_slots: int = 4096
    seed: int = 41
    max_sources: int = 100_000
    bin_rows: int = 5000


def targets(sizes: list[int], spec: MixSpec) -> list[float]:
    """Words of each source: by weight, at most ``most`` times its size, the excess reshared by weight."""
    weight = [spec.weights[i % len(spec.weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), spec.share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        above = [i for i in sorted(open_) if left * weight[i] / total > spec.most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weight[i] / total
            return out
        for i in above:
            out[i] = spec.most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``index`` in the keyed permutation of 0..n-1: a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (words.mixed(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        out[todo] = (left << shift) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw beyond numpy's sampler: by inversion of the law within 12 deviations of its mean.

    What lies outside has a chance below 1e-30. Probabilities are taken relative to the mode's, by their ratios.
    """
    low, high = max(0, n - bad), min(good, n)
    share = good / (good + bad)
    spread = int(12 * np.sqrt(n * share * (1 - share) * ((good + bad - n) / max(1, good + bad - 1)))) + 60
    mean = int(n * share)
    low, high = max(low, mean - spread), min(high, mean + spread)
    x = np.arange(low, high, dtype=np.float64)  # from x to x + 1
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    law = np.concatenate([[0.0], np.cumsum(steps)])
    law = np.cumsum(np.exp(law - law.max()))
    return low + int(np.searchsorted(law, rng.random() * law[-1], "right"))


def _halve(quota: np.ndarray, slots: int, node: tuple[int, int], seed: int) -> np.ndarray:
    """How many of each source fall into the first ``slots`` of sum(quota) slots."""
    total = int(quota.sum())
    rng = np.random.default_rng([seed, *node])
    if total < 10**9:
        return rng.multivariate_hypergeometric(quota, slots, method="marginals")
    # numpy's sampler ends here: the same marginals one after the other
    out, left = np.zeros_like(quota), slots
    for i, own in enumerate(quota.tolist()):
        total -= own
        out[i] = _large_hypergeometric(rng, own, total, left) if own and left else 0
        left -= int(out[i])
    return out


def shard_counts(quota: np.ndarray, shard: int, spec: MixSpec, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it). ``known`` keeps the tree's nodes."""
    total = int(quota.sum())
    low, high, before, here = 0, -(-total // spec.shard_slots), np.zeros_like(quota), quota
    while high - low > 1:
        middle = (low + high) // 2
        if (low, high) not in known:
            known[low, high] = _halve(here, (middle - low) * spec.shard_slots, (low, high), spec.seed)
        first = known[low, high]
        if shard < middle:
            high, here = middle, first
        else:
            low, before, here = middle, before + first, here - first
    return before, here


def slots(spark: SparkSession, quota: np.ndarray, n_blocks: np.ndarray, spec: MixSpec) -> DataFrame:
    """(shard, source_no, block): a row for each slot of the mix."""
    shards = -(-int(quota.sum()) // spec.shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in shared.lean(batches):
            for shard in batch["id"]:
                before, here = shard_counts(quota, int(shard), spec, known)
                source = np.repeat(np.arange(len(quota)), here)
                block = np.zeros(len(source), np.int64)
                at = 0
                for s in np.flatnonzero(here):
                    k, n = before[s] + np.arange(here[s]), int(n_blocks[s])
                    for turn in np.unique(k // n):
                        own = k // n == turn
                        key = spec.seed * 1_000_003 + int(s) * 7919 + int(turn)
                        block[at : at + here[s]][own] = permuted(k[own] % n, n, key)
                    at += here[s]
                yield pd.DataFrame({"shard": shard, "source_no": source.astype(np.int32), "block": block})

    return spark.range(shards).mapInPandas(draw, "shard long, source_no int, block long")


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` without text and with size, its words."""
    names = [c for c in docs.columns if c != "text"]
    fields = docs.select(*names).schema.add("size", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            size = [np.diff(p.first_word) for p in words.parts(batch.column(0))]
            column = pa.array(np.concatenate(size) if size else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], [*names, "size"])

    return docs.select("text", *names).mapInArrow(count, fields)


@dataclass
class Mix:
    """placed: row, doc_id, source_no, source, size, source_size, target, start. taken: row, first, last, uses."""

    placed: DataFrame
    taken: DataFrame


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> Mix:
    """Lays out and draws the mix of ``docs`` (row, doc_id, text, source); row is unique."""
    spark = docs.sparkSession
    sized = shared.written(word_counts(docs.select("row", "doc_id", "source", "text")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    sources = sums.orderBy(F.col("source").asc_nulls_last()).limit(spec.max_sources + 1).collect()
    if len(sources) > spec.max_sources:
        raise ValueError(f"more than {spec.max_sources} sources")
    goal = targets([r.n for r in sources], spec)
    n_blocks = np.array([-(-r.n // spec.block) for r in sources], np.int64)
    quota = np.array(
        [min(int(spec.most * n), round(t * n / r.n)) if r.n else 0 for r, t, n in zip(sources, goal, n_blocks)], np.int64
    )
    listed = spark.createDataFrame(
        [(i, r.source, r.n, t) for i, (r, t) in enumerate(zip(sources, goal))],
        "source_no int, known string, source_size long, target double",
    )
    bins = max(1, sum(r.rows for r in sources) // spec.bin_rows)
    rows = (
        sized.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("known")))  # bounded by max_sources
        .drop("known")
        .withColumn("bin", F.pmod(F.xxhash64("doc_id"), F.lit(bins)))
    )
    own = Window.partitionBy("source_no", "bin")
    line = own.orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("source_no", "bin").agg(F.sum("size").alias("n")).select(
        "source_no", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    placed = shared.written(
        rows.withColumn("inside", F.coalesce(F.sum("size").over(line), F.lit(0)))
        .join(first, ["source_no", "bin"])
        .withColumn("start", F.col("first") + F.col("inside"))
        .drop("first", "inside", "bin"),
        "placed",
    )
    shared.discard(sized)
    uses = slots(spark, quota, n_blocks, spec).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
    b, end = F.lit(spec.block), F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select(
        "row",
        "source_no",
        "start",
        end.alias("end"),
        F.explode(F.sequence(F.expr(f"start div {spec.block}"), F.expr(f"(start + size - 1) div {spec.block}"))).alias("block"),
    )
    # the slots come from a short range, from which the optimizer would guess a small table and broadcast it
    taken = pieces.join(uses.hint("merge"), ["source_no", "block"]).select(
        "row",
        (F.greatest("start", F.col("block") * b) - F.col("start")).alias("first"),
        (F.least("end", (F.col("block") + 1) * b) - F.col("start")).alias("last"),
        "uses",
    )
    return Mix(placed, taken)


def mixed_sizes(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``."""
    made = mix(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source"), spec)
    words_taken = made.taken.groupBy("row").agg(F.sum((F.col("last") - F.col("first")) * F.col("uses")).alias("taken"))
    return made.placed.join(words_taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix with the columns of ``docs``: a row for each document of which the mix takes words.

    text: the words taken in the first round, then those taken once more, in their order. Blocks that follow each
    other make a run, which keeps the white space between its words; runs are joined by one space. n_chars, if
    there, is the length. All other columns are unchanged.
    """
    # the document's own columns stay in a struct: they may have any name
    whole = F.struct(*docs.columns).alias("doc")
    tagged = shared.written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "tagged")
    pieces = mix(tagged.select("row", "doc.doc_id", "doc.text", "doc.source"), spec).taken.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "uses"))).alias("pieces")  # of one document
    )
    names, schema = docs.columns, docs.schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            own, texts = pa.RecordBatch.from_struct_array(batch.column(0)), []
            for part in words.parts(own.column(names.index("text"))):
                body = part.data.tobytes()
                for r, (a, b) in enumerate(zip(part.first_word[:-1], part.first_word[1:])):
                    lot = batch.column(1)[part.first_row + r].as_py()
                    runs: list[list[int]] = []
                    for t in range(max(p["uses"] for p in lot)):
                        turn = len(runs)
                        for p in lot:
                            if p["uses"] <= t:
                                continue
                            if len(runs) > turn and runs[-1][1] == p["first"]:
                                runs[-1][1] = p["last"]
                            else:
                                runs.append([p["first"], p["last"]])
                    texts.append(b" ".join(body[part.starts[a + x] : part.ends[a + y - 1]] for x, y in runs))
            columns = dict(zip(names, own.columns))
            columns["text"] = pa.array([t.decode() for t in texts], pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t.decode()) for t in texts]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    # pieces grow with the documents: never broadcast, however few they look
    return tagged.join(pieces.hint("merge"), "row").select("doc", "pieces").mapInArrow(rebuild, schema)
