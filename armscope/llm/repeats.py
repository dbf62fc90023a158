"""Repeated windows of a corpus: every window of ``window`` symbols that starts at more than one place.

Symbols are words or bytes. The search is exact and moves little:

1. Each window names an anchor, the gram with the least hash in it. Equal windows name equal anchors, so a
   window can only repeat if its anchor does. Consecutive windows with one anchor form a piece.
2. Anchors are counted; pieces whose anchor occurs once are done.
3. Pieces with the same content are copies of one another, window by window: one of them stands for all.
4. Anchors with several different pieces are mixed. Their distinct pieces, with how often each occurs, meet
   in one shard. Of an anchor's pieces those go on that agree with another one in half a window's length beyond
   the anchor, before or behind it: no others can have a common window. A ``decide`` function then finds the
   windows that repeat across pieces.
5. Mixed anchors with more than ``HOT`` distinct pieces are not gathered: their windows are hashed (two
   64-bit hashes) and counted, with partial sums before the shuffle.

Nothing is capped or dropped; hot anchors and hot pieces only meet in joins that adaptive execution splits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.llm import shared, words

HOT = 20_000
SHARD_SYMBOLS = 100_000
#: Bytes of text worked on at a time: few enough for the arrays of one part to stay in a core's cache.
PART_BYTES = 1 << 16
#: Pieces of several parts are handed over so many at a time.
ROWS = 20_000
PLACE = (1 << 20) - 1


@dataclass(frozen=True)
class Windows:
    """What a window is. ``unit``: word or byte; ``later_only``: the first place of a window does not count."""

    unit: str
    window: int
    gram: int
    later_only: bool

    def symbols(self, part: words.Part) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit symbols, offsets of the rows) of a part."""
        if self.unit == "word":
            return part.hashes(), part.first_word
        return words._BYTE_CODES[part.data], part.offsets


@dataclass
class Piece:
    """A distinct piece of a shard: how often it occurs, its first place, its windows, its symbols as bytes."""

    times: int
    row: int
    start: int
    windows: int
    body: bytes


Decide = Callable[[list[Piece]], list[np.ndarray]]


class Sequence:
    """Hashes of any stretch of a sequence of symbols, which are hashes themselves."""

    def __init__(self, symbols: np.ndarray):
        self.up, self.down = words.powers(len(symbols))
        self.total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=self.total[1:])

    def each(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` symbols."""
        n = len(self.total) - size
        return words.mixed((self.total[size:] - self.total[:n]) * self.down[:n])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return words.mixed((self.total[ends] - self.total[starts]) * self.down[starts])


def pieces(symbols: np.ndarray, offsets: np.ndarray, spec: Windows, located: bool = False) -> tuple[np.ndarray, ...]:
    """(row, start of the first window, windows, anchor hash, content hash[, the anchor's place in it]) of every piece."""
    empty = np.zeros(0, np.int64)
    n, width = len(symbols), spec.window - spec.gram + 1
    if n < spec.window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), *[empty] * located
    stretch = Sequence(symbols)
    grams = stretch.each(spec.gram)
    at = np.arange(len(grams))
    # the low bits tell where the least gram is; of equal grams the leftmost counts, so that equal windows agree
    marked = (grams & ~np.uint64(PLACE)) | (at & PLACE).astype(np.uint64)
    least = words.sliding(marked, width)
    for wrap in range(PLACE + 1, len(at), PLACE + 1):  # where the low bits start anew, leftmost is looked up
        low, high = max(0, wrap - width + 1), min(wrap, len(least))
        if low < high:
            own = np.lib.stride_tricks.sliding_window_view(grams & ~np.uint64(PLACE), width)[low:high]
            least[low:high] = ((np.arange(low, high) + own.argmin(axis=1)) & PLACE).astype(np.uint64)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(len(least)) + spec.window <= row_end[: len(least)])
    anchor = start + (((least[start] & np.uint64(PLACE)).astype(np.int64) - start) & PLACE)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    start, anchor = start[first], anchor[first]
    end = start + count + spec.window - 1
    row = np.searchsorted(offsets, start, "right") - 1
    content = words.mixed(stretch(start, end) + (end - start).astype(np.uint64))
    return row, start - offsets[row], count, grams[anchor], content, *[anchor - start] * located


def occurrences(tagged: DataFrame, spec: Windows) -> DataFrame:
    """(row, a, p, start, n, g) of every piece: anchor and content hash, place in the text, windows, the anchor's place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lots, n = batch.column(0).to_numpy(), [], 0
            for part, first in unpacked_parts(batch.column(1)):
                row, start, count, a, p, g = pieces(*spec.symbols(part), spec, located=True)
                lots.append([ids[first + part.first_row + row], a.view(np.int64), p.view(np.int64), start, count, g])
                n += len(row)
                if n >= ROWS:
                    yield joined(lots)
                    lots, n = [], 0
            if n:
                yield joined(lots)

    def joined(lots: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*lots)], ["row", "a", "p", "start", "n", "g"])

    return tagged.select("row", "packed").mapInArrow(cut, "row long, a long, p long, start long, n long, g long")


def unpacked_parts(column: pa.Array) -> Iterator[tuple[words.Part, int]]:
    """Parts of a column of packed texts, some hundred texts at a time, with the place of the first of those."""
    for first in range(0, len(column), 256):
        texts = pa.array(shared.unpacked(column.slice(first, 256).to_pylist()), pa.large_binary())
        for part in words.parts(texts, PART_BYTES):
            yield part, first


def may_share(lot: list[Piece], anchors: list[int], spec: Windows) -> list[Piece]:
    """Of pieces with one anchor, at place ``anchors[i]`` of piece i, all that can hold a window of another.

    A window reaches over half of its other symbols beyond the anchor, before or behind it. Pieces with a common
    window agree in the anchor and so many symbols on that side.
    """
    size = 8 if spec.unit == "word" else 1
    gram, half = size * spec.gram, size * ((spec.window - spec.gram + 1) // 2)
    sides: list[tuple[bytes | None, bytes | None]] = []
    for piece, place in zip(lot, anchors):
        body, at = piece.body, size * place
        sides.append(
            (body[at - half : at + gram] if at >= half else None, body[at : at + gram + half] if at + gram + half <= len(body) else None)
        )
    before, behind = (Counter(x) for x in zip(*sides))
    return [
        piece
        for piece, (one, two) in zip(lot, sides)
        if (one is not None and before[one] > 1) or (two is not None and behind[two] > 1)
    ]


def repeated(tagged: DataFrame, spec: Windows, decide: Decide) -> DataFrame:
    """(row, spans): stretches [start, end) of symbols that repeated windows cover, unmerged, of rows that have some."""
    spark = tagged.sparkSession
    found = occurrences(tagged, spec)
    # written first: a join of two plain exchanges is one whose hot keys adaptive execution can split
    anchors = shared.written(
        found.groupBy("a")
        .agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("low"), F.max("p").alias("high"))
        .where("c > 1")
        .select("a", (F.col("low") != F.col("high")).alias("mixed")),
        "anchors",
    )
    shared.release(spark)
    again = shared.written(found.join(anchors, "a"), "pieces")
    shared.release(spark)
    kinds = shared.written(
        again.groupBy("a", "p").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start")).alias("first"), F.max("n").alias("n"),
            F.max("g").alias("g"), F.max("mixed").alias("mixed"),
        ),
        "kinds",
    )
    shared.release(spark)
    decided, bodies = _across(tagged, kinds, spec, decide)
    across = shared.written(decided, "across")
    for used in (anchors, bodies):
        shared.discard(used)
    shared.release(spark)
    whole = again.join(kinds.where("times > 1").select("a", "p", "first"), ["a", "p"])
    if spec.later_only:
        whole = whole.where("row <> first.row or start <> first.start")
    span = F.struct(F.col("start"), (F.col("start") + F.col("n") + spec.window - 1).alias("end"))
    spans = whole.select("row", span.alias("span")).unionByName(across.select("row", F.struct("start", "end").alias("span")))
    return spans.groupBy("row").agg(F.collect_list("span").alias("spans"))  # of one text


def _across(tagged: DataFrame, kinds: DataFrame, spec: Windows, decide: Decide) -> tuple[DataFrame, DataFrame]:
    """(row, start, end): of first pieces of mixed anchors, the stretches whose windows repeat in other pieces.

    Also the written table of the pieces' symbols, from which they come.
    """
    mixed = kinds.where("mixed")
    hot = mixed.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("a", F.lit(True).alias("hot"))
    wanted = (
        mixed.join(hot, "a", "left")
        .select("first.row", F.struct("a", "times", "first.start", "n", "g", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
        .groupBy("row")
        .agg(F.collect_list("w").alias("wanted"))  # of one text
    )
    window, word = spec.window, spec.unit == "word"
    names = ["a", "b", "times", "row", "start", "n", "g", "body"]

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            rows, lists = batch.column(0).to_numpy(), batch.column(2)
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            to = np.concatenate([[0], np.cumsum(sizes)])
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "times", "start", "n", "g", "hot")]
            for part, first in unpacked_parts(batch.column(1)):
                low, high = first + part.first_row, first + part.first_row + part.n_rows
                a, times, start, n, g, hot = (x[to[low] : to[high]] for x in fields)
                inside = np.repeat(np.arange(part.n_rows), sizes[low:high])
                row = rows[low + inside]
                at = (part.first_word if word else part.offsets)[inside] + start
                symbols = spec.symbols(part)[0] if word or hot.any() else None
                source, size = (symbols.astype("<u8").tobytes(), 8) if word else (part.data.tobytes(), 1)
                own = np.flatnonzero(~hot)
                ends = at + n + window - 1
                body = [source[f:t] for f, t in zip((size * at[own]).tolist(), (size * ends[own]).tolist())]
                lot = [a[own], np.zeros(len(own), np.int64), times[own], row[own], start[own], n[own], g[own], body]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lot, types)], names)
                own = np.flatnonzero(hot)
                if not len(own):
                    continue
                piece, places = np.repeat(own, n[own]), words.spread(at[own], n[own])
                one, two = (
                    Sequence(x)(places, places + window).view(np.int64) for x in (symbols, words.mixed(symbols + np.uint64(1)))
                )
                begin, ones = start[piece] + places - at[piece], np.ones(len(piece), np.int64)
                lot = [one, two, times[piece], row[piece], begin, ones, 0 * ones, pa.nulls(len(piece), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lot, types)], names)

    cut = shared.written(
        tagged.select("row", "packed")
        .join(wanted, "row")
        .select("row", "packed", "wanted")
        .mapInArrow(bodies, "a long, b long, times long, row long, start long, n long, g long, body binary"),
        "bodies",
    )
    shared.release(tagged.sparkSession)
    single = cut.where("body is null")
    firsts = single.groupBy("a", "b").agg(F.sum("times").alias("all"), F.min(F.struct("row", "start")).alias("first")).where("all > 1")
    counted = single.join(firsts, ["a", "b"])
    if spec.later_only:
        counted = counted.where("row <> first.row or start <> first.start")
    counted = counted.select("row", "start", (F.col("start") + window).alias("end"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole anchors are put together to shards of about SHARD_SYMBOLS symbols."""
        lot: list[Piece] = []
        own: list[Piece] = []  # of the anchor being read
        anchors: list[int] = []
        size, last = 0, None

        def decided() -> pa.RecordBatch:
            rows, starts, ends = [], [], []
            for piece, repeats in zip(lot, decide(lot)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], repeats.astype(np.int8), [0]])))
                for f, t in edge.reshape(-1, 2).tolist():
                    rows.append(piece.row)
                    starts.append(piece.start + f)
                    ends.append(piece.start + t - 1 + window)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["row", "start", "end"]
            )

        for batch in batches:
            for a, times, row, start, n, g, body in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last and own:
                    able = may_share(own, anchors, spec)
                    lot, size = lot + able, size + sum(p.windows + window - 1 for p in able)
                    own, anchors = [], []
                    if size >= SHARD_SYMBOLS:
                        yield decided()
                        lot, size = [], 0
                own.append(Piece(times, row, start, n, body))
                anchors.append(g)
                last = a
        if own:
            lot = lot + may_share(own, anchors, spec)
        if lot:
            yield decided()

    dealt = cut.where("body is not null").select("a", "times", "row", "start", "n", "g", "body")
    found = dealt.repartition("a").sortWithinPartitions("a", "row", "start").mapInArrow(
        shards, "row long, start long, end long"
    )
    return found.unionByName(counted), cut


def spans_of_rows(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the spans of each row; of a null, none."""
    flat = column.flatten()
    starts, ends = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    to = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [(starts[a:b], ends[a:b]) for a, b in zip([0, *to], to)]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` symbols some span [start, end) covers."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge)[:-1] > 0
