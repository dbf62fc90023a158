"""Forests and boosted trees of MLlib's definition, grown from counts of equal binned rows.

A tree sees of a row only the bins of its columns, its label and its weight. Rows that agree in these are one cell: every
sum that a split is chosen by is a sum over cells, the number of a cell's rows in a bootstrap sample is a Poisson number,
in a sample without replacement a binomial one. So the rows are read a few times, however many trees and levels there
are; all trees of an ensemble are then grown from its cells in one task.

There are few cells where columns are functions of few others, as features of arm, stratum and time are: then at most the
arms times the strata times the pieces into which all cut points of time cut it, for any number of rows. Beyond
``MOST_CELLS``, or with settings not known here, there is no result, and the caller takes MLlib's own fit.
"""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.session import discard, new_folder, written

#: Up to so many rows MLlib fits: it takes all values for its cut points there, and draws alike on any number of cores.
ROWS_FROM = 20_000
#: So many cells of an ensemble, and different weights of rows, are told apart; a cell's key has so many bits.
MOST_CELLS, MOST_WEIGHTS, KEY_BITS = 10_000, 8, 62
#: An interval of values on which cut points are sought has at most this part of the weight, or is one value.
RESOLUTION = 1024
_ROUNDS = 12
_COUNTS = pa.schema([("c", pa.int32()), ("fold", pa.int32()), ("w", pa.float64()), ("at", pa.int32()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
_CELLS = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
_NODES = "part int, tree int, id int, prediction double, impurity double, stats array<double>, n bigint, gain double, left int, right int, feature int, threshold double"

# Tasks get the functions of this module with their own code: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def suits(pipeline: Pipeline) -> bool:
    """An assembler, then a forest or boosting whose settings are all known here."""
    stages = pipeline.getStages()
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], (RandomForestClassifier, GBTClassifier)):
        return False
    fit = stages[1]
    if isinstance(fit, GBTClassifier):
        return fit.getLossType().lower() == "logistic" and not fit.isDefined("validationIndicatorCol")
    return fit.getImpurity().lower() == "gini"


def ensembles(pipeline: Pipeline, rows: DataFrame, fold: str | None = None, folds: int = 1) -> list[PipelineModel] | None:
    """The pipeline fitted on all rows, or with ``fold`` once for each number of a fold, on the rows of all others.

    ``rows`` have no nulls in what the fit reads, and are read about four times. None: the rows do not make few cells.
    """
    assembler, fit = pipeline.getStages()
    columns = assembler.getInputCols()
    weight = F.col(fit.getWeightCol()).cast("double") if fit.isDefined("weightCol") else F.lit(1.0)
    number = F.col(fold).cast("int") if fold else F.lit(-1)
    frame = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], weight.alias("_w"), number.alias("_f"), F.col(fit.getLabelCol()).cast("double").alias("_y"))
    held = list(range(folds)) if fold else [None]
    counted = _value_counts(frame, len(columns), fit.getMaxBins())
    if counted is None:
        return None
    weights, values = counted
    cuts = [[_cut_points(v, k, fit.getMaxBins()) for v in values] for k in held]
    units = _cells(frame, held, cuts, weights)
    if units is None:
        return None
    settings = _settings(fit, len(columns))
    grown = written(_grown(rows.sparkSession, units, cuts, settings), "grown")
    fitted = _as_models(fit, assembler, grown, len(held), settings)
    discard(grown)
    return [PipelineModel(stages=[assembler, m]) for m in fitted]


def _value_counts(frame: DataFrame, columns: int, bins: int) -> tuple[np.ndarray, list] | None:
    """The weights there are, and per column (fold, weight of rows, rows, least, greatest) of intervals of its values, in order.

    The intervals of a column are those of its values that hold rows; one with much of the weight is cut into smaller
    ones in the next round, until it holds little or one value; all are where there are no more than some bins.
    """
    edges: list[np.ndarray] = [np.empty(0)] * columns
    done: list = [None] * columns
    weights = np.empty(0)
    for _ in range(_ROUNDS):
        todo = [c for c in range(columns) if done[c] is None]
        if not todo:
            return weights, done
        kind = "c int, fold int, w double, at int, n bigint, lo double, hi double"
        parts = frame.mapInArrow(_interval_counter({c: edges[c] for c in todo}), kind)
        got = parts.groupBy("c", "fold", "w", "at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
        table = {f: got[f].to_numpy() for f in got.column_names}
        weights = np.unique(table["w"]) if not len(weights) else weights
        whole = np.isfinite(table["lo"]) & np.isfinite(table["hi"]) & np.isfinite(table["w"]) & (table["w"] >= 0)
        if not len(table["c"]) or (table["c"] < 0).any() or len(weights) > MOST_WEIGHTS or not whole.all():
            return None
        if len(np.unique(table["c"][table["lo"] < table["hi"]])) >= KEY_BITS:  # each of them is cut
            return None
        for c in todo:
            mine = {f: v[table["c"] == c] for f, v in table.items()}
            order = np.lexsort((mine["w"], mine["fold"], mine["at"]))
            mine = {f: v[order] for f, v in mine.items()}
            ats, first = np.unique(mine["at"], return_index=True)
            mass = np.add.reduceat(mine["n"] * mine["w"], first)
            lo, hi = np.minimum.reduceat(mine["lo"], first), np.maximum.reduceat(mine["hi"], first)
            share = mass / max(mass.sum(), sys.float_info.min)
            wide = (lo < hi) & ((share > 1 / RESOLUTION) | (len(ats) <= 2 * bins))
            if not wide.any():
                done[c] = (mine["fold"], mine["n"] * mine["w"], mine["n"], mine["lo"], mine["hi"])
                continue
            inner = [np.linspace(lo[i], hi[i], max(64, int(np.ceil(share[i] * 2 * RESOLUTION))) + 1)[:-1] for i in np.flatnonzero(wide)]
            edges[c] = np.unique(np.concatenate([hi[:-1], *inner]))
    return None


def _interval_counter(edges: dict[int, np.ndarray]):
    """Rows of each column, fold, weight and interval of values, with the least and greatest value of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            w, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_w", "_f"))
            kinds, kind = np.unique(np.rec.fromarrays([f, w]), return_inverse=True)
            if len({k[1] for k in kinds}) > MOST_WEIGHTS:
                yield pa.RecordBatch.from_pylist([dict(c=-1, fold=0, w=0.0, at=0, n=0, lo=0.0, hi=0.0)], schema=_COUNTS)
                return
            for c, e in edges.items():
                x, size = batch.column(f"_{c}").to_numpy(zero_copy_only=False), len(e) + 1
                at = kind * size + np.searchsorted(e, x)
                n = np.bincount(at, minlength=len(kinds) * size)
                lo, hi = np.full(len(n), np.inf), np.full(len(n), -np.inf)
                np.minimum.at(lo, at, x)
                np.maximum.at(hi, at, x)
                for i, (fold, weight) in enumerate(kinds):
                    part = slice(i * size, (i + 1) * size)
                    key = (c, int(fold), float(weight))
                    if key not in held:
                        held[key] = [n[part].copy(), lo[part].copy(), hi[part].copy()]
                    else:
                        held[key][0] += n[part]
                        np.minimum(held[key][1], lo[part], out=held[key][1])
                        np.maximum(held[key][2], hi[part], out=held[key][2])
        for (c, fold, weight), (n, lo, hi) in held.items():
            at = np.flatnonzero(n)
            same = [np.full(len(at), v) for v in (c, fold, weight)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*same, at, n[at], lo[at], hi[at]], _COUNTS.types)], schema=_COUNTS)

    return run


def _cut_points(values: tuple, held: int | None, bins: int) -> np.ndarray:
    """MLlib's rule: midway between neighbouring values if those are few, else where the weight passes equal shares."""
    fold, weight, n, lo, hi = values
    if held is not None:
        weight, n, lo, hi = (v[fold != held] for v in (weight, n, lo, hi))
    # rows of one interval, of other folds and weights, stand together in this order
    order = np.argsort(lo, kind="stable")
    weight, n, lo, hi = weight[order], n[order], lo[order], hi[order]
    if not len(lo):
        return np.empty(0)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]]))
    weight, lo, hi = np.add.reduceat(weight, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    middle, splits = (hi[:-1] + lo[1:]) / 2, min(bins, int(n.sum())) - 1
    if len(middle) <= splits:
        return middle
    stride = weight.sum() / (splits + 1)
    found, target, so_far = [], stride, weight[0]
    for i in range(1, len(weight)):
        before, so_far = so_far, so_far + weight[i]
        if abs(before - target) < abs(so_far - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def _cells(frame: DataFrame, held: list, cuts: list[list[np.ndarray]], weights: np.ndarray) -> list[dict] | None:
    """For each ensemble the cells of its rows: bins of the columns, label, weight and number of rows, in one order."""
    sizes = [[len(c) + 1 for c in of] for of in cuts]
    if any(np.log2(np.array(s, float)).sum() + np.log2(2 * len(weights)) > KEY_BITS for s in sizes):
        return None
    got = frame.mapInArrow(_cell_counter(held, cuts, weights), "part int, key bigint, n bigint")
    table = got.groupBy("part", "key").agg(F.sum("n").alias("n")).limit((MOST_CELLS + 1) * len(held)).toArrow()
    part, key, n = (table[c].to_numpy() for c in ("part", "key", "n"))
    if (key < 0).any():
        return None
    out = []
    for p, size in enumerate(sizes):
        order = np.argsort(key[part == p])
        rest, bins = key[part == p][order], []
        rest, y = np.divmod(rest, 2)
        rest, w = np.divmod(rest, len(weights))
        for s in reversed(size):
            rest, b = np.divmod(rest, s)
            bins.append(b)
        # a fit of one class is left to MLlib
        if len(y) > MOST_CELLS or len(np.unique(y)) < 2:
            return None
        out.append({"bins": np.stack(bins[::-1], 1).astype(np.int64), "y": y.astype(float), "w": weights[w], "n": n[part == p][order]})
    return out


def _cell_counter(held: list, cuts: list[list[np.ndarray]], weights: np.ndarray):
    """Rows of each cell of each ensemble; a key holds the bins, the place of the weight and the label."""

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [([], []) for _ in held]
        odd = pa.RecordBatch.from_pylist([dict(part=0, key=-1, n=0)], schema=_CELLS)
        for batch in batches:
            w, f, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_w", "_f", "_y"))
            if not np.isin(y, (0.0, 1.0)).all():
                yield odd
                return
            last = np.searchsorted(weights, w) * 2 + y.astype(np.int64)
            columns = [batch.column(f"_{c}").to_numpy(zero_copy_only=False) for c in range(len(cuts[0]))]
            for (keys, counts), k, of in zip(kept, held, cuts):
                key = np.zeros(len(y), np.int64)
                for x, c in zip(columns, of):
                    if len(c):
                        key = key * (len(c) + 1) + np.searchsorted(c, x)
                key = key * (2 * len(weights)) + last
                found, n = np.unique(key if k is None else key[f != k], return_counts=True)
                keys.append(found)
                counts.append(n)
                if len(keys) > 32:
                    found, n = merged(keys, counts)
                    keys[:], counts[:] = [found], [n]
                    if len(found) > MOST_CELLS:
                        yield odd
                        return
        for p, (keys, counts) in enumerate(kept):
            if keys:
                found, n = merged(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), p), pa.int32()), pa.array(found), pa.array(n)], schema=_CELLS)

    return run


def _settings(fit, columns: int) -> dict:
    """What MLlib makes of the estimator's parameters."""
    boosted = isinstance(fit, GBTClassifier)
    trees = fit.getMaxIter() if boosted else fit.getNumTrees()
    share = fit.getFeatureSubsetStrategy().lower()
    if share == "auto":
        share = "all" if boosted or trees == 1 else "sqrt"
    named = {"all": columns, "sqrt": int(np.ceil(np.sqrt(columns))), "log2": max(1, int(np.ceil(np.log2(columns)))), "onethird": int(np.ceil(columns / 3))}
    if share in named:
        tried = named[share]
    else:
        tried = min(columns, int(share)) if share.isdigit() else int(np.ceil(float(share) * columns))
    return {
        "boosted": boosted, "trees": trees, "tried": tried, "seed": fit.getSeed(), "depth": fit.getMaxDepth(), "rows": fit.getMinInstancesPerNode(),
        "weight": fit.getMinWeightFractionPerNode(), "gain": fit.getMinInfoGain(), "share": fit.getSubsamplingRate(),
        "again": not boosted and fit.getOrDefault("bootstrap"), "rate": fit.getStepSize() if boosted else 1.0,
    }


def _grown(spark, units: list[dict], cuts: list[list[np.ndarray]], settings: dict) -> DataFrame:
    """The nodes of all trees of each ensemble, numbered as MLlib saves them; an ensemble is grown in one task."""
    held = [(p, bytearray(pickle.dumps((u, c)))) for p, (u, c) in enumerate(zip(units, cuts))]
    tasks = spark.createDataFrame(spark.sparkContext.parallelize(held, len(held)), "part int, units binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                unit, of = pickle.loads(packed)
                for number, tree in enumerate(_trees(unit, [len(c) + 1 for c in of], settings)):
                    nodes = _numbered(tree, of, not settings["boosted"])
                    size = len(nodes["id"])
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p] * size, pa.int32()), "tree": pa.array([number] * size, pa.int32()), **nodes})

    return tasks.mapInArrow(run, _NODES)


def _trees(unit: dict, sizes: list[int], settings: dict) -> Iterator[dict]:
    """The trees of an ensemble, one after the other."""
    rng = np.random.default_rng(settings["seed"])
    n, w, y = unit["n"], unit["w"], unit["y"]
    least = settings["weight"] * float((n * w).sum())
    score = np.zeros(len(n))
    target = 2 * y - 1  # boosting: residuals of labels -1 and 1
    for t in range(settings["trees"]):
        if settings["again"]:
            taken = rng.poisson(settings["share"] * n)
        else:
            taken = rng.binomial(n, settings["share"]) if settings["share"] < 1 else n
        k = taken * w
        stats = [k, k * target, k * target * target] if settings["boosted"] else [k * (y == 0), k * (y == 1)]
        tree = _tree(unit["bins"], sizes, np.stack([*stats, taken.astype(float)]), settings, least, rng)
        yield tree
        if settings["boosted"]:
            score += (settings["rate"] if t else 1.0) * tree["prediction"][tree["leaf"]]
            target = 4 * (2 * y - 1) / (1 + np.exp(2 * (2 * y - 1) * score))


def _impurity(stats: np.ndarray, boosted: bool) -> np.ndarray:
    """Variance of (weight, sum, sum of squares), or Gini of the classes' weights, along the first axis; 0 without rows."""
    total = stats[0] if boosted else stats[0] + stats[1]
    some = np.where(total > 0, total, 1.0)
    if boosted:
        value = (stats[2] - stats[1] * stats[1] / some) / some
    else:
        value = 1.0 - (stats[0] / some) ** 2 - (stats[1] / some) ** 2
    return np.where(total > 0, value, 0.0)


def _tree(bins: np.ndarray, sizes: list[int], stats: np.ndarray, settings: dict, least: float, rng) -> dict:
    """One tree, level by level. The last row of ``stats`` is the number of rows, those before what the impurity is made of."""
    boosted, columns = settings["boosted"], len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = bins + starts[:-1]
    width = int(starts[-1])
    of_split = np.repeat(np.arange(columns), [s - 1 for s in sizes])  # the column of each possible split
    cut_of = np.concatenate([np.arange(s - 1) for s in sizes]).astype(int)
    nodes = {c: [] for c in ("stats", "gain", "feature", "cut", "left", "right")}

    def add(rows: np.ndarray) -> np.ndarray:
        """Leaves with these stats, a row each; their numbers."""
        first = len(nodes["gain"])
        nodes["stats"].extend(rows)
        for c, v in (("gain", -1.0), ("feature", -1), ("cut", -1), ("left", -1), ("right", -1)):
            nodes[c].extend([v] * len(rows))
        return np.arange(first, first + len(rows))

    open_nodes = add(stats.sum(1)[None])
    leaf = np.zeros(len(bins), np.int64)  # the node of each cell
    slot = np.zeros(len(bins), np.int64)  # its place among the open nodes, or -1
    for level in range(settings["depth"]):
        if not len(open_nodes) or not len(of_split):
            break
        size, at = len(open_nodes), np.flatnonzero(slot >= 0)
        index = (slot[at, None] * width + flat[at]).ravel()
        sums = np.stack([np.bincount(index, np.repeat(s[at], columns), size * width).reshape(size, width) for s in stats])
        left, total = np.empty((len(stats), size, len(of_split))), np.empty((len(stats), size, len(of_split)))
        first = 0
        for c, s in enumerate(sizes):
            if s > 1:
                upto = np.cumsum(sums[:, :, starts[c] : starts[c] + s], axis=2)
                left[:, :, first : first + s - 1] = upto[:, :, :-1]
                total[:, :, first : first + s - 1] = upto[:, :, -1:]
                first += s - 1
        right = total - left
        weight_l, weight_r = (x[0] if boosted else x[0] + x[1] for x in (left, right))
        whole = np.where(weight_l + weight_r > 0, weight_l + weight_r, 1.0)
        parent = _impurity(np.array([nodes["stats"][i] for i in open_nodes]).T, boosted)
        gain = parent[:, None] - weight_l / whole * _impurity(left, boosted) - weight_r / whole * _impurity(right, boosted)
        valid = (left[-1] >= settings["rows"]) & (right[-1] >= settings["rows"]) & (weight_l >= least) & (weight_r >= least) & (gain >= settings["gain"])
        place = np.tile(np.arange(columns), (size, 1))  # where a column stands among those tried at a node
        if settings["tried"] < columns:
            place = _tried(size, columns, settings["tried"], rng)
            valid &= place[:, of_split] < columns
        gain = np.where(valid, gain, -np.inf)
        # of the greatest gains, the first in the order in which columns are tried
        order = np.where(gain == gain.max(1, keepdims=True), place[:, of_split] * len(of_split) + np.arange(len(of_split)), np.iinfo(int).max)
        best = order.argmin(1)
        split = np.flatnonzero(gain[np.arange(size), best] > 0)
        chosen = best[split]
        lefts, rights = add(left[:, split, chosen].T), add(right[:, split, chosen].T)
        for i, s, a, b in zip(split, chosen, lefts, rights):
            node = open_nodes[i]
            nodes["gain"][node], nodes["feature"][node], nodes["cut"][node] = gain[i, s], of_split[s], cut_of[s]
            nodes["left"][node], nodes["right"][node] = a, b
        # the cells move on
        feature, cut, child = np.zeros(size, int), np.zeros(size, int), np.full((2, size), -1)
        feature[split], cut[split], child[0, split], child[1, split] = of_split[chosen], cut_of[chosen], lefts, rights
        to_right = (bins[at, feature[slot[at]]] > cut[slot[at]]).astype(int)
        to = child[to_right, slot[at]]
        moved = to >= 0
        leaf[at[moved]] = to[moved]
        children = np.concatenate([lefts, rights])
        pure = np.abs(_impurity(np.array([nodes["stats"][i] for i in children]).reshape(-1, len(stats)).T, boosted)) < sys.float_info.epsilon
        open_nodes = children[~pure]
        number = np.full(len(nodes["gain"]) + 1, -1)  # the last stands for no node
        number[open_nodes] = np.arange(len(open_nodes))
        slot[at] = number[to]
    out = {c: np.array(v) for c, v in nodes.items()}
    if boosted:
        total = out["stats"][:, 0]
        out["prediction"] = np.where(total > 0, out["stats"][:, 1] / np.where(total > 0, total, 1.0), 0.0)
    else:
        out["prediction"] = (out["stats"][:, 1] > out["stats"][:, 0]).astype(float)
    out["impurity"] = _impurity(out["stats"].T, boosted)
    out["leaf"] = leaf
    return out


def _tried(size: int, columns: int, number: int, rng) -> np.ndarray:
    """For each node the places of the columns tried there, drawn by MLlib's reservoir; ``columns`` for those left out."""
    drawn, rows = np.tile(np.arange(number), (size, 1)), np.arange(size)
    for c in range(number, columns):
        at = (rng.random(size) * (c + 1)).astype(int)
        drawn[rows[at < number], at[at < number]] = c
    place = np.full((size, columns), columns)
    np.put_along_axis(place, drawn, np.tile(np.arange(number), (size, 1)), 1)
    return place


def _numbered(tree: dict, cuts: list[np.ndarray], classifies: bool) -> dict[str, pa.Array]:
    """The nodes as MLlib keeps them: leaves of one parent that predict alike are one leaf; numbers count down the left side first."""
    left, right, prediction = tree["left"].copy(), tree["right"].copy(), tree["prediction"]
    for i in range(len(left) - 1, -1, -1):  # children come after their parents
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and prediction[a] == prediction[b]:
            left[i] = right[i] = -1
    order, todo = [], [0]
    while todo:
        i = todo.pop()
        order.append(i)
        if left[i] >= 0:
            todo += [right[i], left[i]]
    order = np.array(order)
    place = np.full(len(left) + 1, -1)
    place[order] = np.arange(len(order))
    inner = left[order] >= 0
    feature = np.where(inner, tree["feature"][order], -1)
    return {
        "id": pa.array(np.arange(len(order)), pa.int32()),
        "prediction": pa.array(prediction[order]),
        "impurity": pa.array(tree["impurity"][order]),
        "stats": pa.array(tree["stats"][order][:, :-1].tolist(), pa.list_(pa.float64())),
        "n": pa.array(np.rint(tree["stats"][order][:, -1]).astype(np.int64)),
        "gain": pa.array(np.where(inner, tree["gain"][order], -1.0)),
        "left": pa.array(place[left[order]], pa.int32()),
        "right": pa.array(place[right[order]], pa.int32()),
        "feature": pa.array(feature, pa.int32()),
        "threshold": pa.array([float(cuts[f][c]) if f >= 0 else None for f, c in zip(feature, tree["cut"][order])], pa.float64()),
    }


def _as_models(fit, assembler: VectorAssembler, grown: DataFrame, parts: int, settings: dict) -> list:
    """MLlib's models of the nodes: what MLlib saves of an ensemble of one tree, with these trees in it, is loaded."""
    spark = grown.sparkSession
    columns = list(dict.fromkeys([*assembler.getInputCols(), fit.getLabelCol()]))
    two = spark.createDataFrame([tuple([float(i)] * len(columns)) for i in range(2)], ", ".join(f"`{c}` double" for c in columns))
    if fit.isDefined("weightCol") and fit.getWeightCol() not in columns:
        two = two.withColumn(fit.getWeightCol(), F.lit(1.0))
    name = "maxIter" if settings["boosted"] else "numTrees"
    small = fit.copy({fit.getParam(name): 1, fit.maxDepth: 1}).fit(assembler.transform(two))
    path = new_folder(spark, "small")
    small.write().save(path)
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    one = json.loads(spark.read.parquet(f"{path}/treesMetadata").first()[1])
    for params, known in ((about, True), (one, False)):
        for p in (fit.getParam(name), fit.maxDepth):
            if p.name in params["paramMap"]:
                params["paramMap"][p.name] = fit.getOrDefault(p)
    about["numTrees"] = settings["trees"]
    trees = [(t, json.dumps({**one, "uid": f"{one['uid']}_{t}"}), settings["rate"] if t else 1.0) for t in range(settings["trees"])]
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    node = F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    out = []
    for p in range(parts):
        to = new_folder(spark, "ensemble")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{to}/metadata")
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{to}/treesMetadata")
        grown.where(F.col("part") == p).select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{to}/data")
        out.append(type(small).load(to))
    return out
