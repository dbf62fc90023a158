"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some stretch of its words is within ``tolerance`` times the item's
length of it in word edits (insert, delete, replace). Words are letters and digits, lower-cased.

1. An item of n words that survives k edits keeps one of k + 1 pieces whole, so only windows around such a
   piece can match. This filter loses nothing.
2. Each item-sized window is embedded by a CGK random walk: a step copies the current word and, by a random
   bit of (step, word), stays or moves on. Few edits then mean few differing steps (Hamming distance).
3. Bit sampling: from each of ``walks`` independent walks, ``draws`` times ``sampled`` steps are drawn;
   windows that agree with an item in all steps of one draw are candidates.
4. Candidates are verified exactly (bit-parallel edit distance, free start and end).

With a share h of differing steps a draw agrees with probability (1 - h)^sampled: the 32 draws of the defaults
find 0.99 at h = 0.6. The benchmark goes to the tasks in blocks of at most ``block_words`` words, one pass over the
documents for each block, so what is broadcast is bounded whatever its size; texts are never shuffled.

Defined cases: null or empty texts and items without a word match nothing. A null item id is reported as null.
Repeated items and repeated documents are each reported. Extra columns are ignored. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.llm import shared, words


@dataclass(frozen=True)
class LeakSpec:
    tolerance: float = 0.2
    walks: int = 4
    draws: int = 8
    sampled: int = 2
    block_words: int = 500_000
    seed: int = 23


@dataclass
class Block:
    """Some items: ids, word hashes, the LSH table and the pieces to look for."""

    ids: list
    items: list[np.ndarray]
    edits: np.ndarray
    keys: np.ndarray  # sorted LSH keys
    of_key: np.ndarray  # item of each
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted hashes, items, offsets


def cgk_keys(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stops: np.ndarray, spec: LeakSpec) -> np.ndarray:
    """(repeats, windows) LSH keys of the windows starts..stops of ``symbols``, embedded as ``sizes`` words.

    A walk takes three steps a word and copies a blank once it has left its window. Each walk is sampled
    ``draws`` times.
    """
    out = np.zeros((spec.walks * spec.draws, len(starts)), np.uint64)
    longest = int(sizes.max()) * 3 if len(sizes) else 0
    some = max(1, (1 << 22) // max(1, longest))
    last = np.int64(len(symbols) - 1)
    for w in range(spec.walks):
        rng = np.random.default_rng([spec.seed, w])
        salts = rng.integers(1, 1 << 63, longest, dtype=np.uint64) | np.uint64(1)
        where = np.random.default_rng([spec.seed, w, 1]).random((spec.draws, spec.sampled))
        for at in range(0, len(starts), some):
            part = slice(at, at + some)
            here, stop, steps = starts[part].astype(np.int64), stops[part], 3 * sizes[part]
            copied = np.zeros((int(steps.max()), len(here)), np.uint64)
            for step in range(len(copied)):
                symbol = np.where(here < stop, symbols[np.minimum(here, last)], np.uint64(0))
                copied[step] = symbol
                # the top bit of an odd multiple is the walk's random bit
                here += ((symbol * salts[step]) >> np.uint64(63)).astype(np.int64)
            for d in range(spec.draws):
                key = words.mixed(sizes[part].astype(np.uint64) * np.uint64(1009) + np.uint64(w * spec.draws + d))
                for u in where[d]:
                    chosen = copied[(u * steps).astype(np.int64), np.arange(len(here))]
                    key = words.mixed(key * np.uint64(0x9E3779B97F4A7C15) + chosen)
                out[w * spec.draws + d, part] = key
    return out


def best_edit(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between ``item`` and any stretch of ``text``, and where in ``text`` that stretch ends."""
    n = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text.tolist()):
        same = places.get(w, 0)
        across = same | minus
        down = (((same & plus) + plus) ^ plus) | same
        up, lower = minus | (full & ~(down | plus)), plus & down
        score += 1 if up & top else -1 if lower & top else 0
        up, lower = (up << 1) & full, (lower << 1) & full  # the first row is 0: a match may start anywhere
        plus, minus = lower | (full & ~(across | up)), up & across
        if score < best:
            best, end = score, j + 1
    return best, end


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def make_block(ids: list, texts: list[str], spec: LeakSpec) -> Block:
    part = next(words.parts(lowered(pa.array(texts, pa.string())), part_bytes=1 << 62, breaks=words.LETTERS_ONLY))
    hashes = part.hashes()
    cut = [hashes[a:b] for a, b in zip(part.first_word[:-1], part.first_word[1:])]
    keep = [i for i, x in enumerate(cut) if len(x)]
    ids, items = [ids[i] for i in keep], [cut[i] for i in keep]
    edits = np.array([int(spec.tolerance * len(x) + 1e-9) for x in items], np.int64)
    keys, of_key = [], []
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, x in enumerate(items):
        own = cgk_keys(x, np.zeros(1, np.int64), np.array([len(x)]), np.array([len(x)]), spec)[:, 0]
        keys.append(own)
        of_key.append(np.full(len(own), i))
        pieces = int(edits[i]) + 1
        length = len(x) // pieces
        offsets = np.arange(pieces) * len(x) // pieces
        found.setdefault(length, []).append((words.runs(x, length)[offsets], np.full(pieces, i), offsets))
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    of_key = np.concatenate(of_key) if of_key else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    table = {}
    for length, lists in found.items():
        h, i, o = (np.concatenate(x) for x in zip(*lists))
        by = np.argsort(h, kind="stable")
        table[length] = h[by], i[by], o[by]
    return Block(ids, items, edits, keys[order], of_key[order], table)


def _ranges(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into wanted, index into sorted_keys) of all equal pairs."""
    low, high = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    return np.repeat(np.arange(len(wanted)), high - low), words.spread(low, high - low)


def finder(block: Block, spec: LeakSpec) -> Callable[[pa.Array], list[tuple[int, int, int, int]]]:
    """A function from a column of texts to (row, item, edits, end word) of every contaminating item."""
    sizes = np.array([len(x) for x in block.items], np.int64)
    filters = {}
    for length, (h, _, _) in block.pieces.items():
        filters[length] = np.zeros(1 << 18, bool)
        filters[length][h >> np.uint64(46)] = True

    def windows(part: words.Part, symbols: np.ndarray) -> np.ndarray:
        """Distinct (row, size, start) of the windows to embed, as rows of an array."""
        out = []
        for length, (h, item, offset) in block.pieces.items():
            if len(symbols) < length:
                continue
            grams = words.runs(symbols, length)[: len(symbols) - length + 1]
            near = np.flatnonzero(filters[length][grams >> np.uint64(46)])
            at, seed = _ranges(h, grams[near])
            at = near[at]
            row = np.searchsorted(part.first_word, at, "right") - 1
            fits = at + length <= part.first_word[row + 1]
            at, seed, row = at[fits], seed[fits], row[fits]
            start = np.maximum(at - offset[seed], part.first_word[row])
            out.append(np.column_stack([row, sizes[item[seed]], start]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def find(texts: pa.Array) -> list[tuple[int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for part in words.parts(lowered(texts), breaks=words.LETTERS_ONLY):
            symbols = part.hashes()
            found = windows(part, symbols)
            if not len(found):
                continue
            stops = np.minimum(found[:, 2] + found[:, 1], part.first_word[found[:, 0] + 1])
            keys = cgk_keys(symbols, found[:, 2], found[:, 1], stops, spec)
            pairs = []
            for own in keys:
                w, k = _ranges(block.keys, own)
                pairs.append(w * len(block.items) + block.of_key[k])
            for pair in np.unique(np.concatenate(pairs)).tolist():
                w, i = divmod(pair, len(block.items))
                row, _, start = found[w].tolist()
                k = int(block.edits[i])
                first, last = part.first_word[row], part.first_word[row + 1]
                low, high = max(first, start - k), min(last, start + len(block.items[i]) + k)
                edits, end = best_edit(block.items[i], symbols[low:high])
                where = part.first_row + row, i
                if edits <= k and edits < best.get(where, (k + 1, 0))[0]:
                    best[where] = edits, int(low + end - first)
        return [(row, i, *x) for (row, i), x in sorted(best.items())]

    return find


def blocks(benchmark: DataFrame, spec: LeakSpec) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; the driver holds one block's texts at a time."""
    ids, texts, n = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if texts and n + len(row.text) // 2 > spec.block_words:
            yield make_block(ids, texts, spec)
            ids, texts, n = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        n += len(row.text) // 2 + 1  # at most so many words
    if texts:
        yield make_block(ids, texts, spec)


def leaks(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """(doc_id, item_id, item_words, edits, end_word): one row for each document and item it contains."""
    schema = "doc_id long, item_id long, item_words long, edits long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, spec):

        def search(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            find = finder(block, spec)
            for batch in shared.lean(batches):
                found = find(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([block.ids[f[1]] for f in found], pa.int64()),
                        pa.array([len(block.items[f[1]]) for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "item_words", "edits", "end_word"],
                )

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are; one pass a block, no shuffle."""
    schema, text = docs.schema, docs.columns.index("text")
    for block in blocks(benchmark, spec):

        def keep(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            find = finder(block, spec)
            for batch in shared.lean(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in find(batch.column(text))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs
