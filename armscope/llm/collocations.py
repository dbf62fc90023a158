"""Phrase collocation mining by best-first branch and bound.

A phrase's score is at most ``1000 * n / f(first word)``: cut after the first word, the rest occurs at least as
often as the phrase. So first words make the frontier, the rarest (of those frequent enough) with the highest bound.

1. Words are counted; per language, first words are put in rounds of falling bound, each with ``growth`` times the
   text positions of all before it.
2. A round grows the prefixes of its first words: pairs, then triples of frequent pairs, then longer ones. A prefix
   below the least count, or an infrequent next word, ends the growth. These counts are of 64-bit hashes: a
   collision can only let a phrase in that step 3 throws out.
3. Phrases that pass, and the rests that their cuts need, are counted exactly, by their text, in one more pass.
   An occurrence also notes the words beside it: a phrase that always has the same neighbour lies in a longer
   phrase with the same count, and is dropped.
4. Survivors get their scores. A language whose ``first``-th score is above the bounds of all further first words
   is settled; words with a lower bound are not expanded, those that tie are.

What tasks get to know of frequent words and prefixes are bit fields of at most ``shared.SIEVE_BITS`` bits. With very many
members a field lets more through, which the exact count throws out: results do not depend on its size.

Defined cases: null text: empty; null lang: ``und``, one language with a literal ``und``. Rows are texts of their own:
ids play no part and repeated rows count again. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm import shared, words
from armscope.llm.shared import Sieve

PENDING = 1 << 21
_U = np.uint64
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAKS = _PIECE_ENDS.copy()
_BREAKS[[0x20, 0x09]] = True


@dataclass(frozen=True)
class Collocations:
    """Parameters: longest phrase, least count, phrases of a language, share of positions in the first round."""

    longest: int = 5
    least: int = 100
    first: int = 2000
    first_share: float = 0.125
    growth: float = 8.0


class Reading:
    """The words of a batch of texts: a hash with the language in it, and the piece each lies in."""

    def __init__(self, part: words.Part, codes: np.ndarray, seeds: np.ndarray) -> None:
        rows = part.row_of_word + part.first_row
        self.codes = codes[rows]
        self.keys = words.mixed(part.hashes(lower=True) + seeds[self.codes])
        ends = np.cumsum(_PIECE_ENDS[part.data])
        self.piece = (ends[part.starts] if len(part.starts) else np.zeros(0, np.int64)) + rows
        self.part, self._grams = part, {1: self.keys}

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; only where ``whole(k)`` holds it means anything."""
        if k not in self._grams:
            before = self.grams(k - 1)
            self._grams[k] = words.mixed(before * words._BASE + np.roll(self.keys, 1 - k)) if len(before) else before
        return self._grams[k]

    def whole(self, k: int) -> np.ndarray:
        """Do the k words from each position on lie in one piece?"""
        out = np.zeros(len(self.keys), bool)
        if len(out) >= k:
            out[: len(out) - k + 1] = self.piece[: len(out) - k + 1] == self.piece[k - 1 :]
        return out

    def beside(self, where: np.ndarray, step: int) -> np.ndarray:
        """The word ``step`` places on in the same piece, as a signed number; 0: none there."""
        to = where + step
        inside = (to >= 0) & (to < len(self.keys))
        to = np.where(inside, to, where)
        inside &= self.piece[to] == self.piece[where]
        return np.where(inside, self.keys[to], _U(0)).view(np.int64)

    def texts(self, first: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the phrases from ``first`` on, one space between words, and their lengths."""
        part = self.part
        breaks = _BREAKS[part.data]
        keep = ~breaks
        keep[1:] |= ~breaks[:-1]
        line = np.where(breaks, np.uint8(0x20), words._LOWER[part.data])[keep]
        before = np.concatenate([[0], np.cumsum(keep)])
        at, to = before[part.starts[first]], before[part.ends[first + k - 1]]
        return line[words.spread(at, to - at)], to - at


def readings(batch: pa.RecordBatch, codes: dict[str, int], langs: Sieve | None) -> Iterator[Reading]:
    """The texts of a batch (lang, text, hash of lang) in ``langs``; ``codes`` numbers the languages met so far."""
    if langs:
        batch = batch.filter(pa.array(langs.passes(batch.column(2).to_numpy().view(np.uint64))))
    own = np.array([codes.setdefault(x, len(codes)) for x in batch.column(0).to_pylist()], np.int64)
    seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in codes]
    for part in words.parts(batch.column(1), 1 << 21, _BREAKS):
        yield Reading(part, own, np.array(seeds, np.uint64))


def _texts(docs: DataFrame) -> DataFrame:
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return named.withColumn("h", F.xxhash64("lang"))


def _strings(line: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(line.tobytes())).cast(pa.string())


def counted_phrases(
    docs: DataFrame, lengths: tuple[int, ...], wanted: Sieve | None = None, langs: Sieve | None = None
) -> DataFrame:
    """(lang, phrase, h, f, left_least, left_most, right_least, right_most): exact counts by text.

    ``wanted``: only phrases whose hash passes; ``langs``: only texts whose language does. The last four are the least and greatest word hash beside an
    occurrence, 0 where the piece ends: equal and not 0 if all occurrences have the same neighbour.
    """
    names = ["lang", "phrase", "h", "f", "left_least", "left_most", "right_least", "right_most"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        for batch in batches:
            for read in readings(batch, codes, langs):
                for k in lengths:
                    fits, keys = read.whole(k), read.grams(k)
                    if wanted:
                        fits &= wanted.passes(keys)
                    where = np.flatnonzero(fits)
                    if not len(where):
                        continue
                    where = where[np.argsort(keys[where], kind="stable")]
                    own = keys[where]
                    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    first = where[cuts]
                    sides = [read.beside(where, -1), read.beside(where, k)]
                    named = np.array(list(codes), object)[read.codes[first]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(named, pa.string()),
                            _strings(*read.texts(first, k)),
                            pa.array(own[cuts].view(np.int64)),
                            pa.array(np.diff(np.append(cuts, len(own)))),
                            *[pa.array(best.reduceat(side, cuts)) for side in sides for best in (np.minimum, np.maximum)],
                        ],
                        names,
                    )

    rows = _texts(docs).mapInArrow(count, f"lang string, phrase string, {' long, '.join(names[2:])} long")
    sums = [F.min("h").alias("h"), F.sum("f").alias("f")]
    return rows.groupBy("lang", "phrase").agg(*sums, *[(F.min if n.endswith("least") else F.max)(n).alias(n) for n in names[4:]])


def hash_counts(
    docs: DataFrame, lengths: tuple[int, ...], next_words: Sieve, gate: Sieve, gate_length: int, langs: Sieve
) -> DataFrame:
    """(h, f, rests) of phrases that begin with a prefix of ``gate_length`` words in ``gate`` and go on with ``next_words``.

    rests: the hashes of the phrase without its first word, first two words, ... down to two words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        wide = max(lengths) - 2

        def combined() -> pa.RecordBatch:
            keys, counts, rests = map(np.concatenate, zip(*pending))
            pending.clear()
            own, first, back = np.unique(keys, return_index=True, return_inverse=True)
            sums = np.bincount(back, weights=counts, minlength=len(own)).astype(np.int64)
            columns = [pa.array(own.view(np.int64)), pa.array(sums), *[pa.array(rests[first, c].view(np.int64)) for c in range(wide)]]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for read in readings(batch, codes, langs):
                open_to = gate.passes(read.grams(gate_length))
                ready = next_words.passes(read.keys)
                for step in range(gate_length, min(lengths) - 1):
                    open_to &= np.roll(ready, -step)
                for k in lengths:
                    open_to = open_to & np.roll(ready, 1 - k)
                    where = np.flatnonzero(open_to & read.whole(k))
                    own, first, counts = np.unique(read.grams(k)[where], return_index=True, return_counts=True)
                    rests = np.zeros((len(own), wide), np.uint64)
                    for c in range(k - 2):
                        rests[:, c] = read.grams(k - 1 - c)[where[first] + 1 + c]
                    pending.append((own, counts, rests))
                if sum(len(p[0]) for p in pending) > PENDING:
                    yield combined()
        if pending:
            yield combined()

    wide = max(lengths) - 2
    names = ["h", "f", *[f"r{c}" for c in range(wide)]]
    rows = _texts(docs).mapInArrow(count, ", ".join(f"{n} long" for n in names))
    rests = F.array(*[F.min(f"r{c}") for c in range(wide)]) if wide else F.array().cast("array<long>")
    return rows.groupBy("h").agg(F.sum("f").alias("f"), rests.alias("rests"))


def rounds(first_words: DataFrame, spec: Collocations) -> DataFrame:
    """Adds ``round``, from 0: words of a language by rising count, in classes of counts, as their share adds up."""
    at = F.floor(4 * F.log2("f")).cast("int")
    mass = first_words.groupBy("lang", at.alias("class")).agg(F.sum("f").alias("mass"))
    before = Window.partitionBy("lang").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("mass").over(before), F.lit(0)) / F.sum("mass").over(Window.partitionBy("lang"))
    number = F.when(share <= spec.first_share, 0).otherwise(F.ceil(F.log(share / spec.first_share) / np.log(spec.growth)))
    return first_words.withColumn("class", at).join(mass.withColumn("round", number.cast("int")), ["lang", "class"])


def scored(phrases: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the lowest-scoring cut, the first of several. known: (lang, phrase, f)."""
    parts = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("one"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), " ").alias("two"),
    )
    of = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    joined = cuts.join(of("one", "l"), ["lang", "one"]).join(of("two", "r"), ["lang", "two"]).join(totals, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(18,0))"  # noqa: E731  1000 * a * n below 10^38
    exact = joined.withColumn("score", F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {wide('a')} * CAST(n AS DECIMAL(16,0))) div ({wide('l')} * {wide('r')})"))
    least = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("least")
    return exact.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), least).select(
        "lang", "phrase", "a", "least.l", "least.r", "n", "least.score"
    )


def grown(docs: DataFrame, frontier: DataFrame, next_words: Sieve, spec: Collocations) -> DataFrame:
    """Exact counts (as ``counted_phrases``) of all frequent phrases that begin in ``frontier``, and of their rests."""
    spark = docs.sparkSession
    langs = Sieve(spark, frontier.select(F.xxhash64("lang").alias("h")).distinct())
    gate, length, found = Sieve(spark, frontier.select("h")), 1, []
    for lengths in [(2,), (3,), tuple(range(4, spec.longest + 1))]:
        if lengths and max(lengths) <= spec.longest:
            level = hash_counts(docs, lengths, next_words, gate, length, langs).where(F.col("f") >= spec.least)
            found.append(shared.written(level, "prefixes"))
            gate, length = Sieve(spark, found[-1].select("h")), max(lengths)
    hashes = [f.select(F.explode(F.concat(F.array("h"), "rests")).alias("h")) for f in found]
    every = hashes[0]
    for more in hashes[1:]:
        every = every.unionByName(more)
    wanted = Sieve(spark, every.where("h <> 0").distinct())
    counts = counted_phrases(docs, tuple(range(2, spec.longest + 1)), wanted, langs)
    out = shared.written(counts.where(F.col("f") >= spec.least), "phrases")
    for used in found:
        shared.discard(used)
    return out


def collocations(docs: DataFrame, spec: Collocations = Collocations()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases. docs: lang, text."""
    spark = docs.sparkSession
    tally = shared.written(counted_phrases(docs, (1,)).select("lang", "phrase", "h", "f"), "words")
    totals = shared.written(tally.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = tally.where(F.col("f") >= spec.least)
    first_words = shared.written(
        rounds(frequent, spec).join(totals, "lang").withColumn("bound", F.floor(1000 * F.col("n") / F.col("f")) + 1), "first-words"
    )
    shared.discard(tally)
    next_words = Sieve(spark, first_words.select("h"))
    last = first_words.agg(F.max("round")).first()[0]
    done: DataFrame | None = None
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    for number in range(-1 if last is None else last + 1):
        frontier = first_words.where(F.col("round") == number).select("lang", F.col("phrase").alias("first_word"), "h", "bound")
        if done is not None:
            ranked = done.withColumn("rank", F.row_number().over(order))
            reached = ranked.where(F.col("rank") == spec.first).select("lang", F.col("score").alias("least"))
            frontier = frontier.join(reached, "lang", "left").where("least IS NULL OR bound >= least").drop("least")
        frontier = shared.written(frontier, "frontier")
        if frontier.isEmpty():
            continue
        phrases = grown(docs, frontier, next_words, spec)
        words_in = F.size(F.split("phrase", " "))
        alone = lambda side: ~((F.col(f"{side}_least") == F.col(f"{side}_most")) & (F.col(f"{side}_least") != 0))
        kept = phrases.where((words_in == spec.longest) | (alone("left") & alone("right")))
        kept = kept.withColumn("first_word", F.substring_index("phrase", " ", 1)).join(
            frontier.select("lang", "first_word"), ["lang", "first_word"], "left_semi"
        )
        known = phrases.select("lang", "phrase", "f").unionByName(first_words.select("lang", "phrase", "f"))
        new = scored(kept, known, totals)
        new = new if done is None else done.unionByName(new)
        done = shared.written(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.first).drop("rank"), "best")
        shared.release(spark)
    if done is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    return done.withColumn("rank", F.row_number().over(order)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(spec: Collocations = Collocations()) -> str:
    """The same as DuckDB SQL."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)"
        for k in range(1, spec.longest + 1)
    )
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE text IS NOT NULL
), cut AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0b\\x0c\\r]')) AS p FROM texts
), pieces AS (
  SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM cut
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counts WHERE k > 1 AND f >= {spec.least}
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates b WHERE b.lang = c.lang AND b.k > c.k AND b.f >= c.f
      AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS place FROM kept
), scores AS (
  SELECT c.lang, c.phrase, c.a, c.place, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN counts x ON x.lang = c.lang AND x.k = c.place AND x.phrase = array_to_string(c.w[1:c.place], ' ')
    JOIN counts y ON y.lang = c.lang AND y.k = c.k - c.place AND y.phrase = array_to_string(c.w[c.place + 1:], ' ')
), least AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1
)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= {spec.first}
"""
