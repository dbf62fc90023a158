"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each is a linear model over words and word beginnings, and
over the probabilities of the categories before it. While a chain is fitted those probabilities come from
models that did not see the row (out-of-fold); the model used later is fitted on all rows of the sample.

The chain is fitted on a bounded sample of labelled rows: at most ``sample_rows`` texts, those of the smallest id hashes.
Scoring reads every whole text once and moves no rows.

Defined cases: null or empty text has no features; its probabilities are those of the intercepts. Labels
without a document, null ids and documents without a label are left out of the fit; of repeated labels the
largest value counts; different texts of one id all have its label, a repeated row counts once. Without labels of both kinds a
category's probability is its share in the sample (0 without labels). Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm import shared, words


@dataclass(frozen=True)
class ChainSpec:
    """``beginnings``: lengths in bytes of word beginnings; ``buckets``: hashed features, a power of two."""

    sample_rows: int = 8000
    folds: int = 4
    buckets: int = 1 << 20
    features: int = 3000
    least_rows: int = 3
    beginnings: tuple[int, ...] = (4, 5)
    ridge: float = 1e-3
    steps: int = 250
    threshold: float = 0.3


@dataclass
class Linear:
    """A linear model on selected hashed features and on the chain's earlier probabilities."""

    chosen: np.ndarray
    weights: np.ndarray
    before: np.ndarray
    bias: float


@dataclass
class Chain:
    names: list[str]
    spec: ChainSpec
    models: list[Linear] = field(default_factory=list)


def found_features(part: words.Part, spec: ChainSpec) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning, repeats included."""
    slices, starts, ends, rows = part.slices(lower=True), part.starts, part.ends, part.row_of_word
    shift = np.uint64(64 - int(np.log2(spec.buckets)))
    which, feature = [rows], [slices(starts, ends) >> shift]
    for n in spec.beginnings:
        long = ends - starts > n
        which.append(rows[long])
        feature.append(words.mixed(slices(starts[long], starts[long] + n) + np.uint64(n)) >> shift)
    return np.concatenate(which), np.concatenate(feature).astype(np.int64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(
    row: np.ndarray, feature: np.ndarray, before: np.ndarray, target: np.ndarray, use: np.ndarray, spec: ChainSpec
) -> Linear:
    """Ridge logistic regression on the rows in ``use``; features are chosen there by their chi-square."""
    n, k = int(use.sum()), before.shape[1]
    share = float(target[use].mean()) if n else 0.0
    none = np.zeros(0, np.int64)
    if share in (0.0, 1.0):
        return Linear(none, np.zeros(0), np.zeros(k), -30.0 if share == 0 else 30.0)
    seen = use[row]
    all_in = np.bincount(feature[seen], minlength=spec.buckets)
    hits = np.bincount(feature[seen], weights=target[row[seen]], minlength=spec.buckets)
    spread = np.maximum(all_in * share * (1 - share) * (1 - all_in / n), 1e-9)
    score = np.where(all_in >= spec.least_rows, (hits - all_in * share) ** 2 / spread, 0)
    # 20: beyond what the best of a million unrelated features reaches only now and then
    chosen = np.sort(np.argsort(-score, kind="stable")[: spec.features])
    chosen = chosen[score[chosen] > 20]
    place = np.full(spec.buckets, -1)
    place[chosen] = np.arange(len(chosen))
    mask = seen & (place[feature] >= 0)
    compact = np.cumsum(use) - 1
    r, c = compact[row[mask]], place[feature[mask]]
    y, extra = target[use], before[use]
    size = len(chosen) + k + 1
    theta, speed = np.zeros(size), np.zeros(size)
    theta[-1] = np.log(share / (1 - share))
    square = np.zeros(size)
    for step in range(1, spec.steps + 1):
        logit = np.bincount(r, weights=theta[c], minlength=n) + extra @ theta[len(chosen) : -1] + theta[-1]
        gap = (_logistic(logit) - y) / n
        slope = np.concatenate(
            [np.bincount(c, weights=gap[r], minlength=len(chosen)), extra.T @ gap, [gap.sum()]]
        )
        slope[:-1] += spec.ridge * theta[:-1] / np.sqrt(n)
        # Adam
        speed = 0.9 * speed + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta -= 0.1 * speed / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Linear(chosen, theta[: len(chosen)], theta[len(chosen) : -1], float(theta[-1]))


def predict(model: Linear, row: np.ndarray, feature: np.ndarray, before: np.ndarray, spec: ChainSpec) -> np.ndarray:
    """row, feature: distinct pairs."""
    weight = np.zeros(spec.buckets)
    weight[model.chosen] = model.weights
    n = len(before)
    return _logistic(np.bincount(row, weights=weight[feature], minlength=n) + before @ model.before + model.bias)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], spec: ChainSpec = ChainSpec()) -> Chain:
    """categories: name -> 0/1 column of ``labels``, in the order of the chain."""
    names = list(categories)
    targets = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.coalesce(F.max(c.cast("double")), F.lit(0.0)).alias(f"y_{i}") for i, c in enumerate(categories.values())]
    )
    # a sample of texts, not of ids: one labelled id may stand on any number of rows
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    there = texts.join(targets, "doc_id").distinct()
    sample = there.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(spec.sample_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            lists: list[np.ndarray] = []
            for part in words.parts(batch.column(0), breaks=words.LETTERS_ONLY):
                row, feature = found_features(part, spec)
                pairs = np.unique(row * spec.buckets + feature)
                cuts = np.searchsorted(pairs, np.arange(1, part.n_rows) * spec.buckets)
                lists += [(x % spec.buckets).astype(np.int32) for x in np.split(pairs, cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in lists], pa.binary()), *batch.columns[1:]],
                ["found", *batch.schema.names[1:]],
            )

    columns = [f"y_{i}" for i in range(len(names))]
    rows = (
        # the sample is bounded by its parameter, so it may be broadcast
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        .join(F.broadcast(sample), ["doc_id", "text_hash"])
        .dropDuplicates(["doc_id", "text_hash"])  # a repeated row counts once
        .select("text", *columns, F.xxhash64("doc_id").alias("h"))
        .mapInArrow(featurise, "found binary, " + "".join(f"{c} double, " for c in columns) + "h long")
        .collect()
    )
    rows.sort(key=lambda r: (r.h, bytes(r.found)))
    found = [np.frombuffer(r.found, np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    feature = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    fold = np.array([r.h % spec.folds for r in rows], np.int64)
    everything, chain = np.ones(len(rows), bool), Chain(names, spec)
    before = np.zeros((len(rows), 0))
    for i, column in enumerate(columns):
        target = np.array([r[column] for r in rows])
        chain.models.append(fit_linear(row, feature, before, target, everything, spec))
        if i + 1 < len(columns):
            held_out = np.zeros(len(rows))
            for k in range(spec.folds):
                model = fit_linear(row, feature, before, target, fold != k, spec)
                held_out[fold == k] = predict(model, row, feature, before, spec)[fold == k]
            before = np.column_stack([before, held_out])
    return chain


def scorer(chain: Chain) -> Callable[[pa.Array], np.ndarray]:
    """A function from an Arrow column of texts to probabilities: a row a category, a column a text."""
    spec = chain.spec
    chosen = np.unique(np.concatenate([m.chosen for m in chain.models])).astype(np.int64)
    weights = np.zeros((len(chain.models), len(chosen)))
    for i, m in enumerate(chain.models):
        weights[i, np.searchsorted(chosen, m.chosen)] = m.weights
    place = np.full(spec.buckets, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    width = max(1, len(chosen))

    def probabilities(texts: pa.Array) -> np.ndarray:
        out = [np.zeros((len(chain.models), 0))]
        for part in words.parts(texts, breaks=words.LETTERS_ONLY):
            row, feature = found_features(part, spec)
            at = place[feature]
            known = at >= 0
            pairs = np.unique(row[known] * width + at[known])
            row, at = pairs // width, pairs % width
            p = np.zeros((len(chain.models), part.n_rows))
            for i, m in enumerate(chain.models):
                own = np.bincount(row, weights=weights[i, at], minlength=part.n_rows)
                p[i] = _logistic(own + m.before @ p[:i] + m.bias)
            out.append(p)
        return np.concatenate(out, axis=1)

    return probabilities


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<name> double of each category, in the chain's order) of every row."""
    names = ["doc_id", *[f"p_{n}" for n in chain.names]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = scorer(chain)
        for batch in shared.lean(batches):
            p = probabilities(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in p]], names)

    return docs.select("doc_id", "text").mapInArrow(
        apply, "doc_id long" + "".join(f", {n} double" for n in names[1:])
    )


def low_quality_then_toxic(docs: DataFrame, labels: DataFrame, spec: ChainSpec = ChainSpec()) -> Chain:
    """The chain over the two labels there are: first low quality, then toxic."""
    return fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, spec)


def toxic_documents(docs: DataFrame, labels: DataFrame, spec: ChainSpec = ChainSpec()) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic, kept) of every row of ``docs``; kept: not toxic."""
    toxic = F.col("p_toxic") >= spec.threshold
    return score(docs, low_quality_then_toxic(docs, labels, spec)).withColumns({"toxic": toxic, "kept": ~toxic})


def without_toxic(docs: DataFrame, labels: DataFrame, spec: ChainSpec = ChainSpec()) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are; one pass, no shuffle of texts."""
    chain, schema, text = low_quality_then_toxic(docs, labels, spec), docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = scorer(chain)
        for batch in shared.lean(batches):
            yield batch.filter(pa.array(probabilities(batch.column(text))[-1] < spec.threshold))

    return docs.mapInArrow(keep, schema)
