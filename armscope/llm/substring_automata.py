"""Substring dedup by suffix automata of reference shards.

The words of a document that lie in a window of ``min_words`` words occurring anywhere else (in the same
document too) are removed. The corpus is its own reference, so the reference is split into shards that hold
only what can repeat (``repeats``): of each shard a generalized suffix automaton is built, with the number of
places of every state, and the shard's pieces are streamed through it. Where the matching statistic reaches
the window, the state of that window tells whether it has another place; maximal covered spans go.

A reference that grows with the corpus must not be broadcast: each automaton is built in the task that holds
its shard, and the documents' pieces are routed there by anchor. Shards are of bounded size.

Defined cases: null or empty text has no words. Texts shorter than a window keep all. Repeated rows are
separate documents, and so copies of each other. Null ids are kept. Extra columns are ignored. Empty table:
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from armscope.llm import repeats, shared


@dataclass(frozen=True)
class SubstringSpec:
    min_words: int = 35
    gram_words: int = 6


class SuffixAutomaton:
    """Generalized suffix automaton; ``places[v]`` is how often the strings of state v occur."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _clone(self, p: int, c: int, q: int) -> int:
        """Splits off the part of state q that is reached from p by c in one step."""
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.places.append(0)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: list[int], times: int) -> None:
        steps, link, length, places = self.next, self.link, self.length, self.places
        last = 0
        for c in symbols:
            q = steps[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                new = len(steps)
                steps.append({})
                length.append(length[last] + 1)
                link.append(0)
                places.append(0)
                p = last
                while p >= 0 and c not in steps[p]:
                    steps[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = steps[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            places[last] += times

    def close(self) -> None:
        """Hands the places of each state on to its suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[v]] += self.places[v]

    def places_of_windows(self, symbols: list[int], window: int) -> np.ndarray:
        """Streams ``symbols``; how often each window of them occurs in the shard."""
        steps, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for c in symbols:
            while state and c not in steps[state]:
                state = link[state]
                matched = length[state]
            if c in steps[state]:
                state, matched = steps[state][c], matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            out.append(self.places[state] if matched >= window else 0)
        return np.array(out[window - 1 :], np.int64)


def decide_by_automaton(window: int) -> repeats.Decide:
    def decide(pieces: list[repeats.Piece]) -> list[np.ndarray]:
        # a piece that occurs twice repeats as a whole, which is known already; here it is reference only
        symbols = [np.frombuffer(p.body, "<u8").tolist() for p in pieces]
        automaton = SuffixAutomaton()
        for piece, own in zip(pieces, symbols):
            automaton.add(own, piece.times)
        automaton.close()
        return [
            np.zeros(p.windows, bool) if p.times > 1 else automaton.places_of_windows(own, window) > 1
            for p, own in zip(pieces, symbols)
        ]

    return decide


def without_repeats(docs: DataFrame, spec: SubstringSpec = SubstringSpec(), with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans[, kept_text]) of every row of ``docs`` (doc_id, text)."""
    windows = repeats.Windows("word", spec.min_words, spec.gram_words, later_only=False)
    tagged = shared.tagged(docs)
    spans = repeats.repeated(tagged, windows, decide_by_automaton(spec.min_words))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", *["kept_text"] * with_text]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = repeats.spans_of_rows(batch.column(2))
            for part, first in repeats.unpacked_parts(batch.column(1)):
                body, out = part.data.tobytes(), []
                for r, (a, b) in enumerate(zip(part.first_word[:-1], part.first_word[1:])):
                    place = first + part.first_row + r
                    gone = repeats.covered(*lists[place], int(b - a))
                    stay = np.flatnonzero(~gone) + a
                    kept = b" ".join([body[s:e] for s, e in zip(part.starts[stay].tolist(), part.ends[stay].tolist())])
                    n_spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                    out.append((int(b - a), int(gone.sum()), hashlib.sha256(kept).hexdigest(), n_spans, kept.decode()))
                ids = batch.column(0).slice(first + part.first_row, part.n_rows)
                columns = [pa.array(x) for x in zip(*out)][: len(names) - 1]
                yield pa.RecordBatch.from_arrays([ids, *columns], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * with_text
    return tagged.join(spans, "row", "left").select("doc_id", "packed", "spans").mapInArrow(rebuild, schema)
