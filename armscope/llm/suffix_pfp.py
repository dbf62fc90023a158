"""Suffix-array dedup by prefix-free parsing.

Of all texts, taken as bytes in ascending doc_id order, each byte is removed that lies in a string of
``min_bytes`` bytes which also starts earlier. What can repeat at all is found first (``repeats``); its distinct
pieces meet in shards, and each shard is put into suffix order by prefix-free parsing:

1. A rolling hash of ``trigger`` bytes ends a phrase wherever it is 0 modulo ``modulus``; phrases overlap by the
   trigger. The dictionary holds the distinct phrases, the parse says which follow each other.
2. The dictionary's suffixes are ranked by prefix doubling, and so are the parse's.
3. A suffix of the shard is ordered by its rest of the phrase, then by the rank of the parse behind it: no
   phrase's rest longer than a trigger is a proper prefix of another's. Copies of a phrase are ranked once.
4. Neighbours in that order that agree in ``min_bytes`` bytes (compared byte by byte) are one string; all its
   places but the first are removed.

Defined cases: null text is empty. Texts shorter than the string keep all. Repeated rows are separate texts,
the later one of which is removed; of one id, rows follow each other by the hash of their text, and null ids
come first. Extra columns are ignored. An empty table gives an empty result.
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
class ParsingSpec:
    min_bytes: int = 100
    gram_bytes: int = 16
    trigger: int = 6
    modulus: int = 16


PACKED = 7


def _refined(rank: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
    """Splits the groups of equal ``rank`` among ``place`` by ``key``; a rank is the place of its group's first."""
    own = rank[place]
    # one sort key where it fits: ranks are below the length, and so are keys after the first round
    order = np.argsort(own * (len(rank) + 2) + key if own.any() else key)  # ties get one rank, in any order
    r, k = own[order], key[order]
    index = np.arange(len(order))
    new_group = np.ones(len(order), bool)
    new_group[1:] = r[1:] != r[:-1]
    new = new_group.copy()
    new[1:] |= k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(new, index, 0))
    rank[place[order]] = r + first - np.maximum.accumulate(np.where(new_group, index, 0))


def suffix_ranks(codes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Rank of each position's next ``room`` codes (shorter ones first), by prefix doubling.

    Small codes are ranked ``PACKED`` at a time to begin with. A position whose codes are all ranked is done,
    and so are all that equal it, so each round sorts only what is longer.
    """
    n = len(codes)
    rank, every = np.zeros(n, np.int64), np.arange(n)
    have = PACKED if n and codes.max() < 510 else 1
    key = codes.astype(np.int64) + 1
    if have > 1:
        own, key = np.concatenate([key, np.zeros(have, np.int64)]), np.zeros(n, np.int64)
        for k in range(have):
            key = (key << 9) | np.where(room > k, own[k : k + n], 0)
    _refined(rank, every, key)
    while len(every := every[room[every] > have]):
        _refined(rank, every, rank[every + have] + 1)
        have *= 2
    return rank


def phrase_ends(data: np.ndarray, bounds: np.ndarray, spec: ParsingSpec) -> np.ndarray:
    """Ends of the phrases of the strings between ``bounds``: after each trigger, and at each string's end."""
    if len(data) < spec.trigger:
        return bounds[1:]
    rolled = np.zeros(len(data) - spec.trigger + 1, np.uint64)
    for k in range(spec.trigger):
        rolled = rolled * np.uint64(257) + data[k : k + len(rolled)]
    hit = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    ends = np.flatnonzero(hit % np.uint64(spec.modulus) == 0) + spec.trigger
    # a trigger lies in one string, and not at its beginning: every phrase is longer than a trigger
    string = np.searchsorted(bounds, ends - 1, "right") - 1
    ends = ends[ends - bounds[string] > spec.trigger]
    return np.union1d(ends, bounds[1:])


def suffix_order(strings: list[bytes], places: np.ndarray, spec: ParsingSpec) -> np.ndarray:
    """``places`` (positions in the joined strings) in suffix order of their strings; equal suffixes stay adjacent."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    ends = phrase_ends(data, bounds, spec)
    # a phrase begins a trigger before the last one's end, or with its string
    starts = np.concatenate([[0], ends[:-1]])
    starts = np.where(np.isin(starts, bounds), starts, starts - spec.trigger)
    body = data.tobytes()
    last = np.isin(ends, bounds)  # string ends are part of the phrase: a code above 0 that no byte has
    phrases = [body[s:e] + (b"\1" if x else b"\0") for s, e, x in zip(starts.tolist(), ends.tolist(), last.tolist())]
    known = {p: i for i, p in enumerate(sorted(set(phrases)))}
    parse = np.array([known[p] for p in phrases])
    # dictionary: bytes from 2 on, 1 where a string ends, 0 after each phrase
    sizes = np.array([len(p) for p in known])
    joined = np.frombuffer(b"".join(known), np.uint8).astype(np.int64) + 2
    closing = np.cumsum(sizes) - 1
    joined[closing] -= 2  # the mark: 0, or 1 for a string's end
    begin = np.cumsum(sizes) - sizes
    word_rank = suffix_ranks(joined, np.repeat(closing + 1, sizes) - np.arange(len(joined)))
    number = np.arange(len(parse))
    closes = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), number)]
    ahead = suffix_ranks(parse, closes - number + 1)  # of what is left of the string
    # of the phrases that hold a place, the one with more than a trigger left, or else the string's last
    string = np.searchsorted(bounds, places, "right") - 1
    phrase = np.minimum(np.searchsorted(ends, places + spec.trigger, "right"), np.searchsorted(ends, bounds[string + 1]))
    rest = word_rank[begin[parse[phrase]] + places - starts[phrase]]
    behind = np.where(last[phrase], 0, ahead[np.minimum(phrase + 1, len(parse) - 1)])
    return places[np.argsort(rest * (len(parse) + 1) + behind)]


def decide_by_suffix_order(spec: ParsingSpec) -> repeats.Decide:
    width = spec.min_bytes

    def decide(pieces: list[repeats.Piece]) -> list[np.ndarray]:
        bodies = [p.body for p in pieces]
        first = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        windows = np.array([p.windows for p in pieces])
        owner = np.repeat(np.arange(len(pieces)), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        places = suffix_order(bodies, first[owner] + inside, spec)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        string = np.searchsorted(first, places, "right") - 1
        # pieces of one text have windows of their own, in order: a place is its piece's rank and the offset
        turn = np.empty(len(pieces), np.int64)
        turn[np.lexsort((np.array([p.start for p in pieces]), np.array([p.row for p in pieces])))] = np.arange(len(pieces))
        when = turn[string] * (1 + max(map(len, bodies))) + places - first[string]
        same = np.zeros(len(places), bool)  # as the one before
        view = np.lib.stride_tricks.sliding_window_view(data, width)
        for at in range(1, len(places), 1 << 15):
            stop = min(len(places), at + (1 << 15))
            same[at:stop] = (view[places[at:stop]] == view[places[at - 1 : stop - 1]]).all(axis=1)
        begins = np.flatnonzero(~same)
        earliest = np.minimum.reduceat(when, begins)
        later = when != np.repeat(earliest, np.diff(np.append(begins, len(places))))
        gone = np.zeros(first[-1], bool)
        gone[places[later]] = True
        return [gone[f : f + n] for f, n in zip(first[:-1], windows)]

    return decide


def without_repeats(docs: DataFrame, spec: ParsingSpec = ParsingSpec(), with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) of every row of ``docs`` (doc_id, text)."""
    windows = repeats.Windows("byte", spec.min_bytes, spec.gram_bytes, later_only=True)
    tagged = shared.tagged(docs, in_order=True)
    spans = repeats.repeated(tagged, windows, decide_by_suffix_order(spec))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_text]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for body, own in zip(shared.unpacked(some.column(1).to_pylist()), repeats.spans_of_rows(some.column(2))):
                    kept, n_removed, n_spans = body, 0, 0
                    if len(own[0]):
                        gone = repeats.covered(*own, len(body))
                        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                        n_removed = len(body) - len(kept)
                        n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] > gone[:-1]))
                    out.append((len(body), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array(x) for x in zip(*out)][: len(names) - 1]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return tagged.join(spans, "row", "left").select("doc_id", "packed", "spans").mapInArrow(rebuild, schema)
