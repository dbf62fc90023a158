"""Hard negatives by angular triangle filtering.

1. Vectors become whole numbers, floor(scale * x); a score is their inner product.
2. Reference directions, picked far from each other in a bounded sample, stand for the table's directions. Each
   row's angles to all of them are stored; rows are laid in blocks by label, nearest reference and that angle.
3. By the triangle inequality on angles, an anchor at angle p of a reference and a row at angle q of it are
   |p - q| to min(p + q, 2 pi - p - q) apart. The intervals of all references meet in one; its cosines times the
   norms bound the score. Bounds are widened by more than all rounding (``SLACK``).
4. Only blocks and groups of blocks whose bounds overlap what is looked for are scored: for positives, scores
   that reach the fifth best so far (an anchor visits its most promising group first); for negatives, the windows
   that the positives' scores open. Scores are exact integers.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part. A vector
meets only vectors of its own length. Repeated rows are rows of their own as positives and negatives, equal
anchors are answered once, and rows with the anchor's own id are never its partners; of several anchors under
one id each is answered, ``anchor_no`` tells them apart. An empty table gives no rows. Other columns are ignored.
A score beyond 64 bits raises.
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

#: Radians by which an angle interval is widened: arccos near 1 is good to about 1.5e-8.
SLACK = 1e-6
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class HardNegatives:
    """Parameters: quantisation, positives of an anchor, negatives of a pair, window in percent of the positive score.

    References are picked among at most ``sample`` rows; they change what is filtered, never the result.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    references: int = 16
    sample: int = 1024


def directions(z: np.ndarray) -> np.ndarray:
    """Unit vectors; a zero vector stays zero."""
    norms = np.sqrt((z * z).sum(axis=1))
    return z / np.where(norms > 0, norms, 1)[:, None]


def angles(z: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions(z) @ references.T, -1, 1))


def far_directions(z: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` directions of rows of ``z``, each the farthest from those before it."""
    unit = directions(z[(z != 0).any(axis=1)])
    picked: list[int] = []
    nearest = np.full(len(unit), -2.0)
    while len(picked) < min(count, len(unit)):
        new = int(np.argmin(nearest)) if picked else 0
        if picked and nearest[new] > 1 - 1e-9:
            break
        picked.append(new)
        nearest = np.maximum(nearest, unit @ unit[new])
    return unit[picked]


def box_note(references: dict[int, np.ndarray]):
    """A block's note: least and greatest norm, then least and greatest angle to each reference."""

    def note(z: np.ndarray) -> bytes:
        norms = np.sqrt((z * z).sum(axis=1))
        parts = [norms.min(), norms.max()]
        if z.shape[1] in references:
            own = angles(z, references[z.shape[1]])
            zero = (norms == 0)[:, None]  # no direction: any angle, and a score of 0 whatever it is
            own_low, own_high = np.where(zero, 0.0, own), np.where(zero, np.pi, own)
            parts += [*own_low.min(axis=0), *own_high.max(axis=0)]
        return np.array(parts, np.float64).tobytes()

    return note


def score_bounds(anchor: np.ndarray, own: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of ``anchor``, at angles ``own``, with each box (least norm, greatest norm, angles)."""
    count = len(own)
    low, high = boxes[:, 2 : 2 + count], boxes[:, 2 + count :]
    if count:
        least = np.maximum(np.maximum(low - own, own - high), 0).max(axis=1)
        over = lambda q: np.minimum(own + q, 2 * np.pi - own - q)
        most = np.where((low <= np.pi - own) & (np.pi - own <= high), np.pi, np.maximum(over(low), over(high))).min(axis=1)
    else:
        least, most = np.zeros(len(boxes)), np.full(len(boxes), np.pi)
    least, most = np.maximum(least - SLACK, 0), np.minimum(most + SLACK, np.pi)
    norm = float(np.sqrt((anchor * anchor).sum()))
    up, down = np.cos(least), np.cos(most)
    upper = norm * np.where(up > 0, boxes[:, 1], boxes[:, 0]) * up
    lower = norm * np.where(down > 0, boxes[:, 0], boxes[:, 1]) * down
    wide = 1 + 1e-9 * norm * boxes[:, 1]
    return np.nan_to_num(lower - wide, nan=-np.inf), np.nan_to_num(upper + wide, nan=np.inf)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where no sum can pass 2^52, else in unbounded integers."""
    most = float(np.sqrt((x * x).sum(axis=1)).max() * np.sqrt((y * y).sum(axis=1)).max()) if x.size and y.size else 0.0
    if most < 2.0**52:
        return (x @ y.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(x), whole(y).T).astype(np.int64)


def quantised(rows: DataFrame, spec: HardNegatives) -> DataFrame:
    """(id, label, dim, anchor, vec) of the rows that take part; vec holds whole numbers."""
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vb.finite("embedding"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = vb.matrix(batch.column(3))
            whole = np.floor(spec.scale * values)
            vecs = [whole[p:q].tobytes() for p, q in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(vecs, pa.binary())],
                ["id", "label", "anchor", "dim", "vec"],
            )

    return kept.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce("anchor", F.lit(False)),
        F.col("embedding").cast("array<double>"),
    ).mapInArrow(scaled, "id long, label long, anchor boolean, dim long, vec binary")


def reference_directions(rows: DataFrame, spec: HardNegatives) -> dict[int, np.ndarray]:
    """For each vector length of a bounded sample, its reference directions."""
    chosen = rows.select("vec", F.xxhash64("id", "label", "vec").alias("h")).orderBy("h", "vec").limit(spec.sample).collect()
    found: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        v = np.frombuffer(r.vec, np.float64)
        found.setdefault(len(v), []).append(v)
    return {d: far for d, vs in found.items() if len(far := far_directions(np.array(vs), spec.references))}


def placed(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Adds (angles, ref, angle): the angles to all references of the length, the nearest one and its angle."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, own = batch.column(4).to_pylist(), [None] * batch.num_rows
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                if d in references:
                    which = np.flatnonzero(dims == d)
                    found = angles(vb.shaped(b"".join(vecs[i] for i in which), len(which)), references[d])
                    for i, a in zip(which, found):
                        own[i] = a
            near = [0 if a is None else int(np.argmin(a)) for a in own]
            told = [b"" if a is None else a.tobytes() for a in own]
            angle = [0.0 if a is None else float(a[k]) for a, k in zip(own, near)]
            more = [pa.array(told, pa.binary()), pa.array(near, pa.int64()), pa.array(angle, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "angles", "ref", "angle"])

    return rows.mapInArrow(place, "id long, label long, anchor boolean, dim long, vec binary, angles binary, ref long, angle double")


def group_boxes(laid: DataFrame) -> DataFrame:
    """(grp, label, dim, box): the box of a group is that of all its blocks."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = []
            for notes in batch.column(3).to_pylist():
                all_of = np.array([np.frombuffer(n, np.float64) for n in notes])
                count = (all_of.shape[1] - 2) // 2
                low, high = all_of.min(axis=0), all_of.max(axis=0)
                boxes.append(np.concatenate([[low[0], high[1]], low[2 : 2 + count], high[2 + count :]]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(boxes, pa.binary())], ["grp", "label", "dim", "box"])

    whole = laid.groupBy("grp", "label", "dim").agg(F.collect_list("note").alias("notes"))  # GROUP_BLOCKS notes at most
    return whole.mapInArrow(merged, "grp long, label long, dim long, box binary")


def bounded_visits(anchors: DataFrame, groups: DataFrame, same_label: bool, spread: int) -> DataFrame:
    """(grp, query, lower, upper): bounds of an anchor's scores in each group of its length that it may visit.

    Groups are dealt to ``spread`` shares, and anchors sent to every share, so that no key holds all groups.
    """
    share = F.pmod(F.xxhash64("grp"), F.lit(spread)).cast("int")
    left = anchors.select("query", "dim", F.col("label").alias("own_label"), "vec", "angles")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    same = F.col("label") == F.col("own_label")
    pairs = left.join(groups.withColumn("share", share), ["dim", "share"]).where(same if same_label else ~same)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for vec, own, box in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                p, q = score_bounds(*(np.frombuffer(x, np.float64) for x in (vec, own)), np.frombuffer(box, np.float64)[None, :])
                low.append(float(p[0]))
                high.append(float(q[0]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["grp", "query", "lower", "upper"]
            )

    return pairs.select("grp", "query", "vec", "angles", "box").mapInArrow(bound, "grp long, query long, lower double, upper double")


def _boxes(held: list[dict]) -> np.ndarray:
    return np.array([np.frombuffer(b["note"], np.float64) for b in held])


def best_partners(spec: HardNegatives) -> vb.Work:
    """Best same-label rows of each query in a group. State: (own id, score to reach), then the angles."""

    def work(held: list[dict], queries: list[dict]) -> list[tuple]:
        boxes, out = _boxes(held), []
        for q in queries:
            own, floor = (int(x) for x in np.frombuffer(q["state"][:16], np.int64))
            upper = score_bounds(q["vec"], np.frombuffer(q["state"][16:], np.float64), boxes)[1]
            best: list[tuple[int, int]] = []
            for k in np.argsort(-upper, kind="stable"):
                if upper[k] < floor:
                    break
                ids = held[k]["ids"]
                scores = exact_scores(q["vec"][None, :], held[k]["vecs"])[0]
                fits = np.flatnonzero((scores >= floor) & (ids != own))
                best = sorted(best + [(-int(scores[i]), int(ids[i])) for i in fits])[: spec.positives]
                if len(best) == spec.positives:
                    floor = max(floor, -best[-1][0])
            out += [(q["query"], i, -s) for s, i in best]
        return out

    return work


def window_partners(spec: HardNegatives) -> vb.Work:
    """Best rows in each window of each query. State: own id and window count, (least, greatest) scores, angles.

    Once a window holds all it needs, only scores from its last one on are of use: ``least`` rises, blocks close.
    """

    def work(held: list[dict], queries: list[dict]) -> list[tuple]:
        boxes = _boxes(held)
        heads = np.array([np.frombuffer(q["state"][:16], np.int64) for q in queries])
        own, counts = heads.T
        windows = [np.frombuffer(q["state"][16 : 16 + 16 * c], np.int64).reshape(c, 2) for q, c in zip(queries, counts)]
        bounds = [
            score_bounds(q["vec"], np.frombuffer(q["state"][16 + 16 * c :], np.float64), boxes) for q, c in zip(queries, counts)
        ]
        low, high = (np.array([b[k] for b in bounds]) for k in (0, 1))
        vecs = np.array([q["vec"] for q in queries])
        least = np.array([w[:, 0].min() for w in windows])
        most = np.array([w[:, 1].max() for w in windows])
        best: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in windows]
        for k, block in enumerate(held):
            asking = np.flatnonzero((low[:, k] <= most) & (high[:, k] >= least))
            if not len(asking):
                continue
            ids, scores = block["ids"], exact_scores(vecs[asking], block["vecs"])
            hits = (scores >= least[asking, None]) & (scores <= most[asking, None]) & (ids[None, :] != own[asking, None])
            for row in np.flatnonzero(hits.any(axis=1)):
                n, where = asking[row], np.flatnonzero(hits[row])
                where = where[np.lexsort((ids[where], -scores[row, where]))]
                falling, found = -scores[row, where], ids[where]
                useful = []
                for w, (bottom, top) in enumerate(windows[n]):
                    a = int(np.searchsorted(falling, -top))
                    b = min(int(np.searchsorted(falling, -bottom, "right")), a + spec.negatives)
                    mine = best[n][w]
                    if a < b:
                        mine = best[n][w] = sorted(mine + list(zip(falling[a:b].tolist(), found[a:b].tolist())))[: spec.negatives]
                    if bottom <= top:
                        useful.append(-mine[-1][0] if len(mine) == spec.negatives else int(bottom))
                least[n] = min(useful, default=most[n] + 1)
        return [(q["query"], w, i, -s) for q, of in zip(queries, best) for w, mine in enumerate(of) for s, i in mine]

    return work


def first_of(rows: DataFrame, keys: list[str], count: int, at: str) -> DataFrame:
    """The first ``count`` rows of each key by score, then id; ``at`` numbers them from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn(at, F.row_number().over(order)).where(F.col(at) <= count)


def hard_negatives(rows: DataFrame, spec: HardNegatives = HardNegatives()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_no).

    rows: vec_id, label, embedding, anchor (boolean: is the row an anchor?).
    """
    spark = rows.sparkSession
    whole = shared.written(quantised(rows, spec), "quantised")
    references = reference_directions(whole, spec)
    table = placed(whole, references)
    laid = shared.written(vb.blocks(table, ["label", "dim"], ["ref", "angle", "id"], box_note(references)), "vector-blocks")
    groups = shared.written(group_boxes(laid), "groups")
    anchors = table.where("anchor").select("id", "label", "dim", "vec", "angles").distinct()
    anchors = shared.written(anchors.select(F.monotonically_increasing_id().alias("query"), "*"), "anchors")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    near = shared.written(bounded_visits(anchors, groups, True, spread), "visits")
    found, floor = None, F.lit(_NONE)
    first = near.groupBy("query").agg(F.max_by("grp", F.struct("upper", "grp")).alias("grp"))
    state = lambda least: F.concat(vb.as_bytes(F.col("id"), least), "angles")
    schema = "query long, id long, score long"
    visits = first.join(anchors, "query").select("grp", "query", "vec", state(floor).alias("state"))
    found = shared.written(vb.met(laid, visits, best_partners(spec), schema), "positives")
    reach = found.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    reach = anchors.join(reach, "query", "left").withColumn(
        "least", F.when(F.col("n") >= spec.positives, F.col("least")).otherwise(floor)
    )
    visits = (
        near.join(first, ["query", "grp"], "left_anti").join(reach, "query").where("upper >= least")
        .select("grp", "query", "vec", state(F.col("least")).alias("state"))
    )
    more = vb.met(laid, visits, best_partners(spec), schema)
    positives = shared.written(first_of(found.unionByName(more), ["query"], spec.positives, "place"), "positives")
    for used in (near, found):
        shared.discard(used)

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State of a query: the windows of its positives in their order; an empty window is one that nothing fits."""
        for batch in batches:
            out = []
            for own, scores, told in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4))):
                ends = [(-(-spec.low * s // 100), spec.high * s // 100) for s in scores]
                out.append(np.array([own, len(ends), *(x for pair in ends for x in pair)], np.int64).tobytes() + told)
            least = [min((-(-spec.low * s // 100) for s in x), default=0) for x in batch.column(3).to_pylist()]
            most = [max((spec.high * s // 100 for s in x), default=0) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out, pa.binary()), pa.array(least, pa.int64()), pa.array(most, pa.int64())],
                ["query", "vec", "state", "least", "most"],
            )

    listed = positives.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    asking = anchors.join(listed, "query").select("query", "id", "vec", "scores", "angles")
    asking = asking.mapInArrow(window, "query long, vec binary, state binary, least long, most long")
    visits = (
        bounded_visits(anchors, groups, False, spread).join(asking, "query")
        .where("lower <= most and upper >= least").select("grp", "query", "vec", "state")
    )
    found = vb.met(laid, visits, window_partners(spec), "query long, window long, id long, score long")
    chosen = first_of(found, ["query", "window"], spec.negatives, "rank")
    names = anchors.select("query", F.col("id").alias("anchor_id"))
    partners = positives.select("query", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        chosen.join(partners.join(names, "query"), ["query", "window"])
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"), (F.col("window") + 1).cast("int").alias("positive_rank"),
            F.col("query").alias("anchor_no"),
        )
    )


def sql(label: str, spec: HardNegatives = HardNegatives()) -> str:
    """The same over a table of unique vec_id, every fiftieth an anchor, as DuckDB SQL."""
    return f"""
WITH own AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({spec.scale} * x::DOUBLE)) AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    list_inner_product(a.z, r.z)::BIGINT AS score
  FROM own a JOIN own r ON a.vec_id <> r.vec_id AND len(a.z) = len(r.z)
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {spec.positives}
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {spec.low} * p.positive_score <= 100 * s.score AND 100 * s.score <= {spec.high} * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {spec.negatives}
"""
