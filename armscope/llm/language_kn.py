"""Language ID with interpolated Kneser-Ney character models.

One model of order ``order`` for each language, fitted on a bounded sample (``sample_docs`` documents of each
language, those with the smallest id hashes). Texts are lower-cased; all but letters is one space. The models
share sorted hash arrays: an n-gram that some language has seen stores its interpolated log-probability under
every language, so most characters cost one lookup; others back off by stored context weights.

The prediction is the language with the lowest cross-entropy per character. How far the next best is behind
(bits per character) is turned into a probability of being right by a logistic curve, fitted on a second
sample (``calibration_docs`` of each language, disjoint from the first); below ``reject_below`` it is rejected.
A language with fewer documents than both samples gives each its share (3 in 8 calibrate, by default, from
three documents on). Once the curve is there, its models are fitted again with the calibration's documents, up
to ``sample_docs``: what they predict rests on all there is.

Only text and lang of the rows that ``learn`` admits are learned from; lang, source and id never enter a
prediction. Defined cases: null text, or text without a letter, is ``und`` with score 0. Null lang is not
learned from. No language to learn: all ``und``. One language: score 1. Ties go to the first language in code
point order. Repeated rows each get a row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm import words

UNKNOWN = "und"
PART_CHARS = 1 << 19
_ALPHA: np.ndarray | None = None


@dataclass(frozen=True)
class KnSpec:
    order: int = 5
    sample_docs: int = 250
    calibration_docs: int = 150
    reject_below: float = 0.5


def _alpha() -> np.ndarray:
    """Which characters of the basic plane are letters; all beyond it count as letters."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.array([chr(i).isalpha() for i in range(1 << 16)] + [True])
    return _ALPHA


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, targets, row of each target) of some texts, each led by order - 1 start marks (code 1)."""
    mark = "\x01" * (order - 1)
    joined = mark.join(["", *(t.replace("\x01", " ") if "\x01" in t else t for t in texts)]).lower()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = _alpha()[np.minimum(codes, 1 << 16)]
    start = codes == 1
    codes = np.where(letter | start, codes, np.uint32(32))
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | start[:-1]))
    codes, start = codes[keep], start[keep]
    row = np.cumsum(start) // (order - 1) - 1
    targets = np.flatnonzero(~start)
    return codes, targets, row[targets]


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    return words.runs(words.mixed(codes.astype(np.uint64) + np.uint64(77)), n) if n else np.zeros(len(codes), np.uint64)


class Hashes:
    """A sorted hash array with an index on the leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.first = np.append(self.first, len(keys)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there is none."""
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(wanted), -1, np.int32)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            here = at[todo]
            hit = self.keys[here] == wanted[todo]
            out[todo[hit]] = here[hit]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out


@dataclass
class Level:
    """N-grams of one length: log2 probabilities, and weights of their contexts, a column a language."""

    grams: Hashes
    log_p: np.ndarray
    contexts: Hashes
    log_weight: np.ndarray


@dataclass
class Models:
    languages: list[str]
    spec: KnSpec
    levels: list[Level]  # levels[n - 1] for n-grams
    floor: np.ndarray  # log2 probability of an unseen character, before the weight of the empty context
    slope: float = 0.0
    offset: float = 0.0


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and its summed weight."""
    found, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return found, first, np.bincount(which, weights=weights, minlength=len(found))


def fit(grams: dict[str, tuple[np.ndarray, np.ndarray]], spec: KnSpec) -> Models:
    """grams: language -> (codes of its distinct longest n-grams, one a row; their counts)."""
    languages, order = sorted(grams), spec.order
    if not languages:
        return Models([], spec, [], np.zeros(0, np.float32))
    per_level: list[dict] = [{} for _ in range(order)]
    floor = []
    for language in languages:
        codes, value = grams[language]
        for n in range(order, 0, -1):
            own = codes[:, order - n :]
            flat = own.ravel()
            at = np.arange(len(own)) * n
            keys = gram_hashes(flat, n)[at]
            keys, first, value = _distinct(keys, value)
            codes, own, at = codes[first], own[first], at[first]
            once, twice = float((value == 1).sum()), float((value == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = gram_hashes(flat, n - 1)[at]
            found, which, types = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(which, weights=value)
            per_level[n - 1][language] = {
                "codes": own, "keys": keys, "alpha": (value - discount) / total[which],
                "contexts": found, "weight": discount * types / total,
            }
            value = np.ones(len(keys))  # below the longest, distinct continuations are counted
        floor.append(-np.log2(len(per_level[0][language]["keys"]) + 1))
    levels: list[Level] = []
    for n in range(1, order + 1):
        parts = per_level[n - 1]
        keys, first = np.unique(np.concatenate([p["keys"] for p in parts.values()]), return_index=True)
        codes = np.concatenate([p["codes"] for p in parts.values()])[first]
        contexts = np.unique(np.concatenate([p["contexts"] for p in parts.values()]))
        flat, at = codes.ravel(), np.arange(len(codes)) * n
        own_context = gram_hashes(flat, n - 1)[at]
        shorter = gram_hashes(flat, n - 1)[np.minimum(at + 1, len(flat) - 1)] if n > 1 else None
        log_p, log_weight = np.zeros((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
        for k, p in enumerate(parts.values()):
            alpha = np.zeros(len(keys))
            alpha[np.searchsorted(keys, p["keys"])] = p["alpha"]
            weight = np.ones(len(contexts))  # an unseen context hands everything on
            weight[np.searchsorted(contexts, p["contexts"])] = p["weight"]
            below = 2.0 ** (floor[k] if n == 1 else levels[-1].log_p[levels[-1].grams.find(shorter), k].astype(float))
            log_p[:, k] = np.log2(alpha + weight[np.searchsorted(contexts, own_context)] * below)
            log_weight[:, k] = np.log2(weight)
        levels.append(Level(Hashes(keys), log_p.astype(np.float32), Hashes(contexts), log_weight.astype(np.float32)))
    return Models(languages, spec, levels, np.array(floor, np.float32))


def log_probabilities(models: Models, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(summed log2 probability, characters) of each text: a row a text, a column a language."""
    order, n_lang = models.spec.order, len(models.languages)
    total, count = np.zeros((len(texts), n_lang)), np.zeros(len(texts), np.int64)
    codes, targets, row = characters(texts, order)
    if not len(targets):
        return total, count
    symbols = words.mixed(codes.astype(np.uint64) + np.uint64(77))
    value = np.zeros((len(targets), n_lang), np.float32)
    todo = np.arange(len(targets))
    for n in range(order, 0, -1):
        level = models.levels[n - 1]
        at = targets[todo] - n + 1
        place = level.grams.find(words.runs(symbols, n)[at])
        hit = place >= 0
        value[todo[hit]] += level.log_p[place[hit]]
        todo, at = todo[~hit], at[~hit]
        if not len(todo):
            break
        context = words.runs(symbols, n - 1)[at] if n > 1 else np.zeros(len(at), np.uint64)
        place = level.contexts.find(context)
        seen = place >= 0
        value[todo[seen]] += level.log_weight[place[seen]]
        if n == 1:
            value[todo] += models.floor
    count = np.bincount(row, minlength=len(texts))
    full = np.flatnonzero(count)
    total[full] = np.add.reduceat(value, np.searchsorted(row, full), axis=0, dtype=np.float64)
    return total, count


def predict(models: Models, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, margin in bits per character, cross-entropy of the prediction) of each text."""
    best, margin, entropy = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    if not models.languages:
        return best, margin, entropy
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < PART_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        own = [t or "" for t in texts[at:stop]]
        total, count = log_probabilities(models, own)
        lettered = np.array([any(map(str.isalpha, t)) for t in own], bool)
        entropies = -total / np.maximum(count, 1)[:, None]
        ranked = np.sort(entropies, axis=1)
        best[at:stop] = np.where(lettered, np.argmin(entropies, axis=1), -1)
        entropy[at:stop] = ranked[:, 0]
        margin[at:stop] = ranked[:, 1] - ranked[:, 0] if len(models.languages) > 1 else np.inf
        at = stop
    return best, margin, entropy


def _curve(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Logistic curve of being right by the margin, with a little ridge: Newton's steps."""
    theta = np.zeros(2)
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - right) + 0.1 * theta
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, learn: Column, spec: KnSpec = KnSpec()) -> Models:
    """Models of every lang value of the rows that ``learn`` admits; docs: doc_id, text, lang."""
    order = spec.order
    learnable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    ranked = learnable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    # of each language, so many ids: the window keeps only the first ranks of each task before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    most = spec.sample_docs + spec.calibration_docs
    chosen = ranked.select("*", rank.alias("rank")).where(F.col("rank") <= most)
    # ``nth`` of the ranks so far calibrate: an even share of any number of documents
    nth, ids = F.expr(f"rank * {spec.calibration_docs} div {most}"), F.count(F.lit(1)).over(Window.partitionBy("lang"))
    fitted = F.col("ids") - F.expr(f"ids * {spec.calibration_docs} div {most}")
    chosen = chosen.withColumns({"nth": nth, "ids": ids}).select(
        "doc_id",
        "lang",
        (F.col("nth") > F.expr(f"(rank - 1) * {spec.calibration_docs} div {most}")).alias("calibrates"),
        (fitted + F.col("nth") <= spec.sample_docs).alias("refits"),
    )
    # bounded by the parameters and the number of languages
    sample = learnable.join(F.broadcast(chosen), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, later in zip(*[c.to_pylist() for c in batch.columns]):
                codes, targets, _ = characters([text], order)
                windows = codes[targets[:, None] + np.arange(1 - order, 1)]
                found, n = np.unique(windows, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([g.tobytes() for g in found], pa.binary()),
                        pa.array(n * (not later), pa.int64()),
                        pa.array(n * later, pa.int64()),
                    ],
                    ["lang", "gram", "n", "more"],
                )

    fitted_on = sample.where("not calibrates or refits").select("text", "lang", "calibrates")
    table = (
        fitted_on.mapInArrow(count, "lang string, gram binary, n long, more long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"), F.sum("more").alias("more"))
        .toArrow()
    )
    langs = table.column("lang").to_numpy(zero_copy_only=False)
    n, more = table.column("n").to_numpy(), table.column("more").to_numpy()
    codes = np.frombuffer(b"".join(table.column("gram").to_pylist()), np.uint32).reshape(-1, order)

    def fitted_to(counts: np.ndarray) -> Models:
        own = {g: (langs == g) & (counts > 0) for g in sorted(set(langs))}
        return fit({g: (codes[x], counts[x].astype(float)) for g, x in own.items()}, spec)

    models = fitted_to(n)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, margin, _ = predict(models, batch.column(0).to_pylist())
            right = [b >= 0 and models.languages[b] == g for b, g in zip(best, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(margin), pa.array(right, pa.bool_())], ["margin", "right"])

    if len(models.languages) > 1:
        second = sample.where("calibrates").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
        rows = second.mapInArrow(margins, "margin double, right boolean").orderBy("margin", "right").collect()
        if rows:
            models.slope, models.offset = _curve(
                np.array([r.margin for r in rows]), np.array([r.right for r in rows], float)
            )
    if more.any():
        curve = models.slope, models.offset
        models = fitted_to(n + more)
        models.slope, models.offset = curve
    return models


def languages(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cross_entropy) of every row of ``docs`` (doc_id, text)."""
    shared_models = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    names = ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Models = shared_models.value
        for batch in batches:
            best, margin, entropy = predict(own, batch.column(1).to_pylist())
            score = np.ones(len(best))
            if len(own.languages) > 1:
                score = 1 / (1 + np.exp(-np.clip(own.slope * margin + own.offset, -30, 30)))
            score = np.where(best >= 0, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([own.languages[b] if b >= 0 else UNKNOWN for b in best], pa.string()),
                    pa.array(score),
                    pa.array(score < own.spec.reject_below),
                    pa.array(entropy),
                ],
                names,
            )

    return docs.select("doc_id", "text").mapInArrow(
        label, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double"
    )


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, and null ids, are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def predicted_languages(docs: DataFrame, spec: KnSpec = KnSpec()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, cross_entropy): learns from what is not held out."""
    models = train(docs, ~held_out(F.col("doc_id")), spec)
    return languages(docs, models).withColumn("held_out", held_out(F.col("doc_id")))


