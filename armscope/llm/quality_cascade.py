"""Quality rules as a short-circuit cascade.

Base figures are counted for every text; the base rules on them come first. The further rules are ordered by
what they reject for their cost: both are measured on a bounded sample of documents that pass the base rules
(``sample_rows`` rows with the smallest id hashes), each rule alone. A rule then looks only at the rows that
all rules before it have let through. The order changes the work, never the verdict.

Defined cases: null or empty text has no words and fails. Repeated rows each get a row. Null ids are kept.
Extra columns are ignored. An empty table gives an empty result (and rules in their written order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.llm import words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_LETTER = _UPPER | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)) | (np.arange(256) >= 0xC0)
_DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)


class Texts:
    """A part's rows with the figures that rules share, each made when first asked for."""

    def __init__(self, part: words.Part):
        self.part, self._made = part, {}

    def made(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.part.offsets[1:]] - total[self.part.offsets[:-1]]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.part.first_word)

    @property
    def word_chars(self) -> np.ndarray:
        return self.made("word_chars", lambda: self.per_row(~(words._BREAK | _CONTINUES)[self.part.data]))

    @property
    def n_symbols(self) -> np.ndarray:
        return self.made("n_symbols", lambda: self.per_row(_SYMBOL[self.part.data]))

    def _lines(self) -> np.ndarray:
        """(rows, 2): lines with a word, and how many of them equal an earlier one."""
        p = self.part
        feeds = np.flatnonzero(p.data == 0x0A)
        begin = np.unique(np.concatenate([p.offsets[:-1], feeds + 1]))
        begin = begin[begin < len(p.data)]
        row = np.searchsorted(p.offsets, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(p.data)), p.offsets[row + 1])
        end = np.where((end > begin) & (p.data[np.maximum(end, 1) - 1] == 0x0A), end - 1, end)
        full = np.searchsorted(p.starts, end) > np.searchsorted(p.starts, begin)
        begin, end, row = begin[full], end[full], row[full]
        key = words.mixed(p.slices()(begin, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        n = np.bincount(row, minlength=p.n_rows)
        return np.column_stack([n, n - np.bincount(row[first], minlength=p.n_rows)])

    @property
    def n_lines(self) -> np.ndarray:
        return self.made("lines", self._lines)[:, 0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.made("lines", self._lines)[:, 1]

    @property
    def hashes(self) -> np.ndarray:
        return self.made("hashes", self.part.hashes)

    def _repeats(self) -> np.ndarray:
        p, row = self.part, self.part.row_of_word
        n = len(row)
        if n < 3:
            return np.zeros(p.n_rows, np.int64)
        key = words.mixed(words.runs(self.hashes, 3) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[: n - 2]
        inside = row[2:] == row[:-2]
        at = np.flatnonzero(inside)
        _, which, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, np.int64)
        twice = at[counts[which] > 1]
        cover[twice] += 1
        cover[twice + 3] -= 1
        return np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=p.n_rows)

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self.made("repeats", self._repeats)

    def word_has(self, flags: np.ndarray) -> np.ndarray:
        """Words of each row that hold a flagged byte."""
        p = self.part
        total = np.concatenate([[0], np.cumsum(flags[p.data])])
        return np.bincount(p.row_of_word[total[p.ends] > total[p.starts]], minlength=p.n_rows)

    def top_word(self) -> np.ndarray:
        """How often each row's most frequent word occurs."""
        p, row = self.part, self.part.row_of_word
        key = words.mixed(self.hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        out = np.zeros(p.n_rows, np.int64)
        np.maximum.at(out, row[first], counts)
        return out

    def only(self, rows: np.ndarray) -> Texts:
        """Some of the rows, as a part of their own."""
        p = self.part
        if len(rows) == p.n_rows:
            return self
        size, n = np.diff(p.offsets)[rows], np.diff(p.first_word)[rows]
        data = p.data[words.spread(p.offsets[rows], size)]
        offsets, first = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(n)])
        own, move = words.spread(p.first_word[rows], n), np.repeat(offsets[:-1] - p.offsets[rows], n)
        out = Texts(words.Part(0, len(rows), data, offsets, p.starts[own] + move, p.ends[own] + move, first))
        for name, value in self._made.items():
            out._made[name] = value[own] if name == "hashes" else value[rows]
        return out


@dataclass(frozen=True)
class Rule:
    """``passes`` tells for each row of some texts whether it may stay."""

    name: str
    passes: Callable[[Texts], np.ndarray]


BASE_RULES = (
    Rule("enough_words", lambda t: t.n_words >= 50),
    Rule("few_repeats", lambda t: 100 * t.n_repeat_words <= 50 * t.n_words),
)
RULES = (
    Rule("word_length", lambda t: (t.word_chars >= 2 * t.n_words) & (t.word_chars <= 15 * t.n_words)),
    Rule("few_symbols", lambda t: 10 * t.n_symbols <= t.n_words),
    Rule("few_repeated_lines", lambda t: 2 * t.n_dup_lines <= t.n_lines),
    Rule("words_have_letters", lambda t: 10 * t.word_has(_LETTER) >= 7 * t.n_words),
    Rule("few_digits", lambda t: 5 * t.per_row(_DIGIT[t.part.data]) <= t.word_chars),
    Rule("few_capitals", lambda t: 2 * t.per_row(_UPPER[t.part.data]) <= t.word_chars),
    Rule("no_dominant_word", lambda t: 10 * t.top_word() <= 3 * t.n_words),
)


def verdicts(texts: Texts, rules: Sequence[Rule], passing: np.ndarray) -> np.ndarray:
    """``passing`` less the rows that some rule rejects; each rule sees only what still passes."""
    kept = passing.copy()
    for rule in rules:
        rows = np.flatnonzero(kept)
        if not len(rows):
            break
        kept[rows] = rule.passes(texts.only(rows))
    return kept


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejections per second on the sample, most first; equal ones in their written order."""
    sample = docs.select("doc_id", "text").where("text is not null")
    ids = sample.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the sample is bounded by its parameter, so it may be broadcast
    rows = sample.join(F.broadcast(ids.distinct()), "doc_id").limit(2 * sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for part in words.parts(batch.column(1)):
                texts = Texts(part)
                good = np.flatnonzero(np.logical_and.reduce([r.passes(texts) for r in BASE_RULES]))
                seen += len(good)
                for i, rule in enumerate(rules):
                    own = texts.only(good)
                    began = time.perf_counter()
                    rejected[i] += len(good) - int(rule.passes(own).sum())
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected), pa.array([seen] * len(rules))],
            ["rule", "seconds", "rejected", "seen"],
        )

    measured = (
        rows.mapInArrow(measure, "rule int, seconds double, rejected long, seen long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen"))
        .collect()
    )
    worth = {r.rule: r.rejected / max(1, r.seen) / max(r.seconds / max(1, r.seen), 1e-9) for r in measured}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth.get(i, 0), i))]


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    cascade = ordered(docs) if rules is None else list(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, failed, kept = [np.zeros((len(BASE), 0), np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
            for part in words.parts(batch.column(1)):
                texts = Texts(part)
                base.append(np.array([getattr(texts, name) for name in BASE]))
                good = np.logical_and.reduce([r.passes(texts) for r in BASE_RULES])
                failed.append(~good)
                kept.append(verdicts(texts, cascade, good))
            figures = [pa.array(x, pa.int64()) for x in np.concatenate(base, axis=1)]
            flags = [pa.array(np.concatenate(x)) for x in (failed, kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures, *flags], ["doc_id", *BASE, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)


#: The same figures and verdicts in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
u AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
k AS (SELECT r, count(DISTINCT i + x) AS n FROM c, (VALUES (0), (1), (2)) v(x) WHERE c.n > 1 GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, w, count(*) AS n FROM u GROUP BY r, w) GROUP BY r),
f AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
    coalesce(top.n, 0) AS top
  FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN top ON top.r = d.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
    AND 2 * n_dup_lines <= n_lines AND 10 * lettered >= 7 * n_words AND 5 * digits <= word_chars
    AND 2 * capitals <= word_chars AND 10 * top <= 3 * n_words AS kept
FROM b"""
