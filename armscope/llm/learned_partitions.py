"""Approximate nearest neighbours by learned partitions.

1. A bounded sample (the ``sample`` rows of least hash, in the commonest vector length) gets its exact graph of
   ``graph`` nearest neighbours, found in Spark by the block search below.
2. The graph is cut into ``partitions`` equal parts by halving: nodes are ordered by a smoothed vector (powers of
   the random walk on the graph), split at the median, and pairs are swapped while that cuts fewer edges.
3. A small classifier (one hidden layer) learns, from a vector, how the neighbours of a sampled row spread over
   the parts. A fifth of the sample is held out; on it the share of neighbours that the ``k`` most probable parts
   hold gives the number of parts to search for ``recall``.
4. Every row is laid into its most probable part; a part of any size is as many bounded groups of blocks as it
   takes. A query visits the most probable parts, and the rows met there are ranked by their exact distances.

Defined cases: rows with a null id, and vectors that are null, zero, or hold null or non-finite components, take no
part. A vector meets only vectors of its own length; lengths other than the commonest are one part each, searched
whole. Repeated rows are rows of their own as candidates, equal queries are answered once, a query's own id is never
its answer, and several queries under one id are told apart by ``query_no``. Ties go to the smaller id. Other columns
are ignored. An empty table gives no rows. A sample too small to cut makes one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm import shared
from armscope.llm import vector_blocks as vb


@dataclass(frozen=True)
class LearnedPartitions:
    """Parameters: answers of a query, fit sample, neighbours in its graph, parts, wanted recall, classifier."""

    answers: int = 10
    sample: int = 8192
    graph: int = 10
    partitions: int = 64
    recall: float = 0.97
    hidden: int = 128
    epochs: int = 12
    seed: int = 11


@dataclass(frozen=True)
class Router:
    """The fitted classifier for vectors of length ``dim``, and how many parts a query visits."""

    dim: int
    weights: tuple[np.ndarray, ...]
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(_unit(x) @ w1 + b1, 0) @ w2 + b2


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to a typical component of 1: the classifier's input."""
    return x / np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(x.shape[1])


def halved(nodes: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two equal halves of ``nodes``; ``edges`` (n, 2) number them from 0 and hold each edge in both directions."""
    n, (x, y) = len(nodes), edges.T
    degree = np.bincount(x, minlength=n) + 1e-9
    place = rng.normal(size=n)
    for _ in range(60):
        place = 0.5 * place + 0.5 * np.bincount(x, weights=place[y], minlength=n) / degree
        place -= np.average(place, weights=degree)
        place /= np.abs(place).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(place, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        # what a node gains by changing sides: edges across less edges within
        gain = np.bincount(x, weights=np.where(side[x] != side[y], 1.0, -1.0), minlength=n)
        one, two = (s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(side), np.flatnonzero(~side)))
        pairs = min(len(one), len(two))
        worth = int((gain[one[:pairs]] + gain[two[:pairs]] > 2).sum()) // 4  # a part: swapped neighbours undo each other
        if not worth:
            break
        trial = side.copy()
        trial[one[:worth]], trial[two[:worth]] = False, True
        if (trial[x] != trial[y]).sum() >= (side[x] != side[y]).sum():
            break
        side = trial
    return np.flatnonzero(~side), np.flatnonzero(side)


def balanced_parts(n: int, edges: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """The part of each of ``n`` nodes, by halving again and again; ``parts`` is a power of two."""
    rng, label = np.random.default_rng(seed), np.zeros(n, np.int64)
    both = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0) if len(edges) else np.zeros((0, 2), np.int64)
    todo = [(np.arange(n), both, 0, parts)]
    while todo:
        nodes, own, first, count = todo.pop()
        if count == 1:
            label[nodes] = first
            continue
        for k, half in enumerate(halved(nodes, own, rng)):
            number = np.full(len(nodes), -1)
            number[half] = np.arange(len(half))
            inside = number[own]
            todo.append((nodes[half], inside[(inside >= 0).all(axis=1)], first + k * count // 2, count // 2))
    return label


def fitted(x: np.ndarray, targets: np.ndarray, spec: LearnedPartitions) -> tuple[np.ndarray, ...]:
    """Weights of the classifier: cross-entropy against ``targets`` (shares of parts), Adam, fixed steps."""
    rng = np.random.default_rng(spec.seed)
    x, parts = _unit(x), targets.shape[1]
    w = [
        rng.normal(size=(x.shape[1], spec.hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(spec.hidden),
        rng.normal(size=(spec.hidden, parts)) * np.sqrt(1 / spec.hidden), np.zeros(parts),
    ]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(spec.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
            logits = hidden @ w[2] + w[3]
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            off = (share / share.sum(axis=1, keepdims=True) - targets[rows]) / len(rows)
            back = (off @ w[2].T) * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(axis=0), hidden.T @ off, off.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def probes_for(ranks: np.ndarray, recall: float) -> int:
    """The least number of parts that holds ``recall`` of the neighbours; ranks: of each neighbour's part, from 0."""
    order = np.sort(ranks)
    return int(order[min(len(order) - 1, int(np.ceil(recall * len(order))) - 1)]) + 1 if len(order) else 1


def taking_part(rows: DataFrame) -> DataFrame:
    """(id, query, dim, vec) of the rows that take part; vec holds doubles."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = vb.matrix(batch.column(2))
            vecs = [values[p:q].tobytes() for p, q in zip(at[:-1], at[1:])]
            more = [pa.array(np.diff(at), pa.int64()), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *more], ["id", "query", "dim", "vec"])

    kept = rows.where(F.col("vec_id").isNotNull() & vb.finite("embedding") & F.exists("embedding", lambda x: x != 0))
    return kept.select(
        F.col("vec_id").cast("long"), F.coalesce("query", F.lit(False)), F.col("embedding").cast("array<double>")
    ).mapInArrow(flat, "id long, query boolean, dim long, vec binary")


def nearest(answers: int) -> vb.Work:
    """The nearest rows of each query in a group, by exact distance. State: the query's own id."""

    def work(held: list[dict], queries: list[dict]) -> list[tuple]:
        ids, x = np.concatenate([b["ids"] for b in held]), np.concatenate([b["vecs"] for b in held])
        y = np.array([q["vec"] for q in queries])
        own = np.array([int(np.frombuffer(q["state"], np.int64)[0]) for q in queries])
        sizes, wanted = (x * x).sum(axis=1), (y * y).sum(axis=1)
        rough = wanted[:, None] + sizes[None, :] - 2 * (y @ x.T)
        slack = 1e-12 * x.shape[1] * (wanted + sizes.max())  # above the rounding of the rough squares
        rough[own[:, None] == ids[None, :]] = np.inf
        k = min(answers, len(ids)) - 1
        reach = np.partition(rough, k, axis=1)[:, k] + 2 * slack
        out = []
        for n, q in enumerate(queries):
            near = np.flatnonzero((rough[n] <= reach[n]) & (ids != own[n]))
            score = np.sqrt(((x[near] - y[n]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], score))[:answers]
            out += [(q["query"], int(ids[near[i]]), float(score[i])) for i in order]
        return out

    return work


def _answers(laid: DataFrame, visits: DataFrame, answers: int, visits_a_task: int | None = None) -> DataFrame:
    """(query, rank, id, score) over all groups that a query visits."""
    met = vb.met(laid, visits, nearest(answers), "query long, id long, score double", visits_a_task)
    order = Window.partitionBy("query").orderBy("score", "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= answers)


def router(table: DataFrame, spec: LearnedPartitions) -> Router | None:
    """Fit parts and classifier on the sample of ``table`` (id, dim, vec); None if the table is empty."""
    most = table.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if most is None:
        return None
    hashed = table.where(F.col("dim") == most.dim).select("vec").distinct().select("vec", F.xxhash64("vec").alias("h"))
    chosen = hashed.orderBy("h", "vec").limit(spec.sample)
    place = Window.orderBy("h", "vec")  # ``sample`` rows at most
    chosen = shared.written(chosen.select((F.row_number().over(place) - 1).cast("long").alias("id"), "vec"), "fit-sample")
    x = np.frombuffer(b"".join(r.vec for r in chosen.orderBy("id").collect()), np.float64).reshape(-1, most.dim)
    parts = 1
    while parts * 2 <= min(spec.partitions, len(x) // 16):
        parts *= 2
    if parts == 1:
        return Router(most.dim, (np.zeros((most.dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    laid = shared.written(vb.blocks(chosen.withColumn("part", F.lit(0).cast("long")), ["part"], ["id"], few=True), "sample-blocks")
    groups = F.array(*[F.lit(r.grp) for r in laid.select("grp").distinct().collect()])  # the sample's: a few
    visits = chosen.select(
        F.explode(groups).alias("grp"), F.col("id").alias("query"), "vec", vb.as_bytes(F.col("id")).alias("state")
    )
    found = _answers(laid, visits, spec.graph, visits_a_task=512).select("query", "id").collect()  # sample * graph rows at most
    edges = np.array(sorted((r.query, r.id) for r in found), np.int64).reshape(-1, 2)
    part = balanced_parts(len(x), edges, parts, spec.seed)
    targets = np.bincount(
        np.concatenate([edges[:, 0], np.arange(len(x))]) * parts + np.concatenate([part[edges[:, 1]], part]),
        minlength=len(x) * parts,
    ).reshape(-1, parts).astype(float)
    targets /= targets.sum(axis=1, keepdims=True)
    held_out = np.arange(len(x)) % 5 == 4  # the sample is in hash order
    model = Router(most.dim, fitted(x[~held_out], targets[~held_out], spec), 1)
    scores = model.scores(x)
    rank = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    laid_in = scores.argmax(axis=1)
    tried = edges[held_out[edges[:, 0]]]
    return Router(most.dim, model.weights, probes_for(rank[tried[:, 0], laid_in[tried[:, 1]]], spec.recall))


def routed(rows: DataFrame, model: Router, every: bool) -> DataFrame:
    """Adds ``part`` (``every``: ``parts``, all that the row visits as a query): the most probable parts first.

    A vector of another length goes to the part that bears the length, below zero.
    """
    kind = "array<long>" if every else "long"
    name, count = ("parts", model.probes) if every else ("part", 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, dims = batch.column(3).to_pylist(), batch.column(2).to_numpy()
            found = [[-int(d)] for d in dims]
            which = np.flatnonzero(dims == model.dim)
            if len(which):
                scores = model.scores(vb.shaped(b"".join(vecs[i] for i in which), len(which)))
                for i, best in zip(which, np.argsort(-scores, axis=1, kind="stable")[:, :count].tolist()):
                    found[i] = best
            part = pa.array(found, pa.list_(pa.int64())) if every else pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], ["id", "query", "dim", "vec", name])

    return rows.select("id", "query", "dim", "vec").mapInArrow(route, f"id long, query boolean, dim long, vec binary, {name} {kind}")


def nearest_neighbours(rows: DataFrame, spec: LearnedPartitions = LearnedPartitions()) -> DataFrame:
    """(query_id, rank, vec_id, score, query_no): the nearest rows found, nearest first.

    rows: vec_id, embedding, query (boolean: is the row a query?).
    """
    table = shared.written(taking_part(rows), "vectors")
    model = router(table, spec)
    if model is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_no long")
    laid = shared.written(vb.blocks(routed(table, model, False), ["part"], ["dim", "id"]), "parts")
    queries = table.where("query").select("id", "query", "dim", "vec").distinct()
    queries = shared.written(
        routed(queries, model, True).select(F.monotonically_increasing_id().alias("query"), "id", "vec", "parts"), "queries"
    )
    groups = laid.select("part", "grp").distinct().groupBy("part").agg(F.collect_list("grp").alias("grps"))
    visits = (
        queries.withColumn("part", F.explode("parts")).join(groups, "part")
        .select(F.explode("grps").alias("grp"), "query", "vec", vb.as_bytes(F.col("id")).alias("state"))
    )
    found = _answers(laid, visits, spec.answers)
    names = queries.select("query", F.col("id").alias("query_id"))
    return found.join(names, "query").select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score", F.col("query").alias("query_no")
    )
