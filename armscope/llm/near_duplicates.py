"""MinHash near-dedup with odd sketches.

1. Each text becomes the set of its distinct word shingles (64-bit hashes, A-Z lower-cased). Texts with the same
   set form one class, the node of all further steps; a class is named by its smallest id. Ids with texts in several
   classes link them.
2. MinHash samples of the set give band keys, and are folded into a parity bitmap (odd sketch): sample i
   flips the bit that a hash of (i, sample) names. Two bitmaps differ in the parity of the samples that the
   sets do not share, so their XOR population count estimates high similarities precisely.
3. Nodes that share a band key make a bucket, cut into blocks of ``BLOCK``; the bucket's leader joins all of its
   blocks. Inside a block, a spanning forest of the pairs that the sketches hold likeliest is confirmed on the full
   sets. So a large group is mostly one component after about as many pairs as it has members.
4. Then, in buckets that still hold several components, every further pair across components that the sketch can't
   rule out is confirmed. Members of a bucket's largest component only meet those outside it: n nodes of which u are
   outside make n * u pairs of bitmaps to compare, dealt to cells of two blocks.
5. Links give components. Pairs that are already connected are not looked at again: they change nothing.

A pair at the threshold is missed with probability (1 - t^r)^b, 5e-7 with the defaults, plus about as much
for the sketch's bound. Nothing is capped.

Defined cases: null or empty text and text without words have the empty set: linked with nothing, kept.
Fewer words than a shingle: the whole sequence is the one shingle. Rows of one id are one document, whatever their
texts: each has a row of its own in the result, and all have one component. A null id is passed through with a null
component and kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.llm import shared, words

BLOCK = 1024


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters: similarity in percent, words of a shingle, bands and rows, samples and bits of a sketch.

    ``ids_link``: texts under one id are one document. Otherwise each text stands for itself, named by its id: an id may
    then have rows in several components.
    """

    percent: int = 85
    shingle: int = 5
    bands: int = 25
    rows: int = 5
    samples: int = 384
    bits: int = 1024
    sigmas: float = 5.0
    ids_link: bool = True
    seed: int = 17

    @property
    def sketch_bound(self) -> float:
        """Estimates below this are no link: the threshold less ``sigmas`` standard errors."""
        t = self.percent / 100
        return t - self.sigmas * float(np.sqrt(t * (1 - t) / self.samples))

    @property
    def most_differing(self) -> int:
        """The greatest XOR population count of two bitmaps whose estimate is not below the bound."""
        return int(np.floor(self.bits / 2 * (1 - np.exp(-4 * self.samples * (1 - self.sketch_bound) / self.bits))))


def shingle_sets(part: words.Part, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a part."""
    hashes = part.hashes(lower=True)
    grams = words.runs(hashes, k) if len(hashes) else hashes
    for a, b in zip(part.first_word[:-1], part.first_word[1:]):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:  # shorter than a shingle: the sequence, told apart by its length
            whole = words.runs(hashes[a:b], int(b - a))[:1]
            yield words.mixed(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def min_samples(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash: the least of each linear permutation of 32 bits of the shingles' hashes."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (factors[:, None] * short[None, at : at + 512] + shifts[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray, bits: int) -> bytes:
    """Parity bitmap of (index, sample) pairs."""
    index = np.arange(len(samples), dtype=np.uint64) << np.uint64(32)
    places = (words.mixed(index + samples) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def estimates(differing: np.ndarray, bits: int, samples: int) -> np.ndarray:
    """Similarity from the XOR population count of two odd sketches."""
    share = np.minimum(2.0 * differing / bits, 1 - 1e-9)
    return 1 + bits * np.log1p(-share) / (4.0 * samples)


def signatures(docs: DataFrame, spec: NearDuplicates) -> DataFrame:
    """(doc_id, text_hash, n_shingles, s1, s2, keys, sketch, tags): s1 and s2 name the set, keys are its band keys,
    tags their low 32 bits: by them, a pair that shares several bands is looked at in the first only."""
    rng = np.random.default_rng(spec.seed)
    factors = (rng.integers(0, 1 << 31, spec.samples, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, spec.samples, dtype=np.uint32)
    band_no = np.arange(spec.bands, dtype=np.uint64) + np.uint64(spec.seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            counts, one, two, keys, sketches, tags = [], [], [], [], [], []
            for part in words.parts(batch.column(2)):
                for found in shingle_sets(part, spec.shingle):
                    counts.append(len(found))
                    one.append(words.mixed(found).sum(dtype=np.uint64))
                    two.append(words.mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    if not len(found):
                        keys.append(np.zeros(0, np.int64))
                        sketches.append(b"")
                        tags.append(b"")
                        continue
                    least = min_samples(found, factors, shifts)
                    key = band_no.copy()
                    for row in range(spec.rows):
                        key = words.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[row : spec.bands * spec.rows : spec.rows])
                    keys.append(key.view(np.int64))
                    tags.append(key.astype(np.uint32).tobytes())
                    sketches.append(odd_sketch(least, spec.bits))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(counts, pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64), pa.int64()),
                    pa.array(np.array(two, np.uint64).view(np.int64), pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                    pa.array(tags, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "s1", "s2", "keys", "sketch", "tags"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sign,
        "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, keys array<long>, sketch binary, tags binary",
    )


def _forest(x: np.ndarray, y: np.ndarray, far: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Kruskal: which of the edges x-y between ``node`` labels make a spanning forest, the least ``far`` first."""
    root, keep = np.arange(node.max() + 1), []
    order = np.argsort(far, kind="stable")
    while len(order):
        for e in order[: 4 * len(root)].tolist():
            p, q = node[x[e]], node[y[e]]
            while root[p] != p:
                root[p] = p = root[root[p]]
            while root[q] != q:
                root[q] = q = root[root[q]]
            if p != q:
                root[max(p, q)] = min(p, q)
                keep.append(e)
        while (root != root[root]).any():
            root = root[root]
        order = order[4 * len(root) :]
        order = order[root[node[x[order]]] != root[node[y[order]]]]
    return np.array(keep, np.int64)


def _cell_pairs(cell: pa.Table, spec: NearDuplicates, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), a < b, of one cell; of all shared bands, only the first one yields a pair.

    ``forest``: only a spanning forest of the likeliest pairs.
    """
    ids, one = np.unique(cell.column("node").to_numpy(), return_index=True)
    none = np.zeros(0, np.int64)
    if len(ids) < 2:
        return none, none
    label, side = (cell.column(c).to_numpy()[one] for c in ("component", "i"))
    low, high, band = (cell.column(c)[0].as_py() for c in ("low", "high", "band"))
    sketch, tags = cell.column("sketch").to_pylist(), cell.column("tags").to_pylist()
    bitmaps = np.frombuffer(b"".join(sketch[i] for i in one), np.uint64).reshape(len(ids), -1)
    tags = np.frombuffer(b"".join(tags[i] for i in one), np.uint32).reshape(len(ids), -1)[:, :band]
    first, second, far = [none], [none], [none]
    for at in range(0, len(ids), 256):
        rows = slice(at, at + 256)
        off = np.zeros((len(ids[rows]), len(ids)), np.uint16)
        for w in range(bitmaps.shape[1]):
            off += np.bitwise_count(bitmaps[rows, w, None] ^ bitmaps[None, :, w])
        fits = (off <= spec.most_differing) & (ids[rows, None] < ids[None, :]) & (label[rows, None] != label[None, :])
        if low != high:
            fits &= side[rows, None] != side[None, :]
        x, y = np.nonzero(fits)
        new = np.ones(len(x), bool)
        for k in range(band):
            new &= tags[x + at, k] != tags[y, k]
        x, y = x[new], y[new]
        first.append(x + at)
        second.append(y)
        far.append(off[x, y].astype(np.int64))
    x, y, far = map(np.concatenate, (first, second, far))
    if forest and len(x):
        keep = _forest(x, y, far, np.unique(label, return_inverse=True)[1])
        x, y = x[keep], y[keep]
    return ids[x], ids[y]


def _block_cells(members: DataFrame, spec: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """Cells of the buckets' blocks: each node is in one block of each of its buckets, a bucket's leader in all of them."""
    by_hash = F.struct(F.xxhash64("node"), "node")
    of_key = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", by_hash).alias("leader"))
    size = shared.written(of_key, "sizes")
    g = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), g).cast("int"))
    every = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), g - 1)).otherwise(own)
    cells = members.join(size, "key").withColumn("low", F.explode(every)).withColumn("i", F.col("low"))
    return cells.withColumn("high", F.col("low")), size


def _cross_cells(members: DataFrame, spec: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """Cells for all pairs across components: the u members outside a bucket's largest component are dealt to blocks
    0, 1, ..., the others to blocks -1, -2, ...; a cell is a pair of blocks of which one is of the former."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    of_key = parts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main")
    )
    size = shared.written(of_key.where("n > n_main"), "sizes")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    outside, hashed = F.col("component") != F.col("main"), F.xxhash64("node")
    others, mains = F.sequence(F.lit(0), F.col("gu") - 1), F.sequence(F.lit(-1), -F.col("gd"), F.lit(-1))
    cells = (
        members.join(size, "key")
        .withColumn("gu", blocks(F.col("n") - F.col("n_main")))
        .withColumn("gd", blocks(F.col("n_main")))
        .withColumn("i", F.when(outside, F.pmod(hashed, F.col("gu"))).otherwise(-1 - F.pmod(hashed, F.col("gd"))).cast("int"))
        .withColumn("j", F.explode(F.when(outside, F.concat(others, mains)).otherwise(others)))
        .withColumns({"low": F.least("i", "j"), "high": F.greatest("i", "j")})
    )
    return cells, size


def _bucket_pairs(members: DataFrame, spec: NearDuplicates, forest: bool) -> DataFrame:
    """Pairs (a, b), a < b, of bucket members with different ``component`` that the sketch can't rule out, written.

    members: key, band, node, component, sketch, tags. ``forest``: only the likeliest pairs inside blocks.
    """
    # written first: a join of two plain exchanges is one whose hot keys can be split
    members = shared.written(members, "members")
    cells, size = (_block_cells if forest else _cross_cells)(members, spec)
    cells = cells.select("key", "low", "high", "band", "i", "node", "component", "sketch", "tags")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after the other; what a batch leaves of its last cell waits for the next batch."""
        waiting: pa.Table | None = None

        def pairs(table: pa.Table, whole: bool) -> tuple[list, pa.Table | None]:
            table = table.combine_chunks()
            key, low, high = (table.column(c).to_numpy() for c in ("key", "low", "high"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            edges = np.concatenate([[0], cuts, [table.num_rows]])
            last = len(edges) - 1 if whole else len(edges) - 2
            found = [_cell_pairs(table.slice(p, q - p), spec, forest) for p, q in zip(edges[:last], edges[1 : last + 1])]
            return found, None if whole else table.slice(int(edges[-2]))

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        for batch in shared.lean(batches):
            table = pa.Table.from_batches([batch])
            found, waiting = pairs(table if waiting is None else pa.concat_tables([waiting, table]), False)
            if found:
                yield batch_of(found)
        if waiting is not None and waiting.num_rows:
            yield batch_of(pairs(waiting, True)[0])

    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    out = shared.written(dealt.mapInArrow(compare, "a long, b long").distinct(), "pairs")
    for used in (members, size):
        shared.discard(used)
    return out


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, spec: NearDuplicates) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= percent * union; written.

    nodes: node, class_id, text_hash: the text that stands for a node. Only texts of nodes in ``pairs`` are packed.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = shared.written(nodes.join(ends, "node").select("node", F.col("class_id").alias("doc_id"), "text_hash"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    sieve = shared.Sieve(docs.sparkSession, wanted.select(F.xxhash64("doc_id", "text_hash").alias("h")))
    near = shared.sifted(texts.withColumn("h", F.xxhash64("doc_id", "text_hash")), sieve)
    # what is wanted grows with the documents: never broadcast
    held = near.join(wanted.hint("merge"), ["doc_id", "text_hash"]).select("node", "text")
    body = shared.written(shared.packed(held, "node").dropDuplicates(["node"]), "bodies")
    left = body.select(F.col("node").alias("a"), F.col("packed").alias("one"))
    right = body.select(F.col("node").alias("b"), F.col("packed").alias("two"))
    k, percent = spec.shingle, spec.percent

    def sets(column: pa.Array) -> list[np.ndarray]:
        # equal bodies, here mostly of one document against several, are cut up once
        bodies = column.to_pylist()
        place = {x: i for i, x in enumerate(dict.fromkeys(bodies))}
        texts = pa.array(shared.unpacked(list(place)), pa.large_binary())
        found = [s for part in words.parts(texts) for s in shingle_sets(part, k)]
        return [found[place[x]] for x in bodies]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in shared.lean(batches):
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keep = []
                for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                    inter = 0
                    if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                        inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * inter >= percent * (len(x) + len(y) - inter) and inter > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    checked = pairs.join(right, "b").join(left, "a").select("a", "b", "one", "two").mapInArrow(check, "a long, b long")
    out = shared.written(checked.distinct(), "confirmed")
    for used in (wanted, body, pairs):
        shared.discard(used)
    return out


def near_duplicates(docs: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept, text_hash) of every row of ``docs`` (doc_id, text).

    class_id: smallest id with the same set; component_id: smallest id that can be reached by links;
    kept: doc_id = component_id.
    """
    of_set = ["n_shingles", "s1", "s2"]
    signed = shared.written(signatures(docs, spec), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = shared.written(full.groupBy(*of_set).agg(F.min("doc_id").alias("class_id")), "class-ids")
    # of a class, a row of its smallest id; several only if that id repeats
    chosen = full.withColumnRenamed("doc_id", "class_id").join(classes, [*of_set, "class_id"], "left_semi").dropDuplicates(of_set)
    nodes = shared.written(chosen.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    shared.discard(classes)
    classed = signed.select("doc_id", "text_hash", *of_set).join(nodes.select("node", "class_id", *of_set), of_set, "left")
    named = [F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("node", "class_id")]
    rows = shared.written(classed.select("doc_id", "text_hash", "n_shingles", *named), "rows")
    shared.discard(signed)
    first = rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    several = shared.written(first.where("a <> z").select("doc_id", "a"), "several")
    links = shared.written(rows.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "own")
    found: DataFrame | None = None
    if spec.ids_link and not links.isEmpty():
        found = shared.components(links)

    def placed() -> DataFrame:
        """Nodes with the component that links have given them so far."""
        if found is None:
            return nodes.withColumn("component", F.col("node"))
        known = found.withColumnRenamed("node", "known")
        joined = nodes.join(known, F.col("node") == F.col("known"), "left").drop("known")
        return joined.withColumn("component", F.coalesce("component", "node"))

    def bucket_members(now: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component; sketches come in by node."""
        keys = now.select(F.posexplode("keys").alias("band", "key"), "node", "component")
        ends = keys.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        open_keys = shared.written(ends.where("x <> y").select("key"), "buckets")
        used.append(open_keys)
        return keys.join(open_keys, "key").join(now.select("node", "sketch", "tags"), "node")

    used: list[DataFrame] = []
    for forest in (True, False):
        now = shared.written(placed().select("node", "component", "keys", "sketch", "tags"), "placed")
        members = bucket_members(now)
        pairs = _bucket_pairs(members, spec, forest)
        new = confirmed(pairs, nodes, docs, spec)
        used += [now, new]
        if not new.isEmpty():
            before, every = found, new
            if before is not None:  # each node and its component stand for all links before
                known = before.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
                every = new.unionByName(known)
                used.append(before)
            found = shared.components(every)
        while used:
            shared.discard(used.pop())
        shared.release(docs.sparkSession)
    shared.discard(links)
    shared.discard(several)
    named = placed().select("node", "component", "class_id")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    label = shared.written(named.join(least, "component").select("node", "component_id"), "labels")
    shared.discard(nodes)
    labelled = rows.join(label, "node", "left")
    if not spec.ids_link:
        return _digest(labelled.withColumn("of_id", F.lit(None).cast("long")))
    # an empty text of an id that also has words
    blank = rows.where("node is null and doc_id is not null").select("doc_id").distinct()
    same_id = labelled.where("node is not null").join(blank, "doc_id", "left_semi")
    same_id = same_id.groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
    return _digest(labelled.join(same_id, "doc_id", "left"))


def _digest(labelled: DataFrame) -> DataFrame:
    component = F.coalesce("component_id", "of_id", "doc_id")
    return labelled.select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        "text_hash",
    )
