"""Token ids of whole texts in compressed, checksummed blocks.

1. Documents are dealt to files by ranges of doc_id and sorted; each file's documents are encoded with a
   public tokenizer, an end id after each, and gathered into blocks of whole documents.
2. The ids of all blocks are counted; the counts make one shared frequency table.
3. Each block becomes one frame of a static range asymmetric numeral system (``rans``).

The output folder holds ``table`` (id, frequency) and ``blocks``: file, block, doc_ids, doc_tokens, frame.
Ascending (file, block) is ascending doc_id; of one id, rows follow each other by the hash of their text.
Frames decode on their own, so readers work in parallel. Writing and reading go through Spark's committed
files: a lost task leaves nothing behind.

Defined cases: a null text is an empty one: just the end id. Null ids come first. Repeated rows are all
written. Extra columns are ignored. An empty table makes an empty folder, and reading it gives no rows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armscope.llm import rans, shared, words
from armscope.llm.word_table import SPARE, WordTable, roomy


@dataclass(frozen=True)
class TokenSpec:
    tokenizer: str
    end_id: int = 0
    block_tokens: int = 1 << 18
    file_bytes: int = 16 << 20
    kept_words: int = 600_000  # words whose ids a worker remembers before it starts anew


#: How a byte-level vocabulary writes a space and a line feed.
_MARKS = ("\u0120", "\u010a")
#: New words in one text for the tokenizer: short texts are encoded fastest, very short ones cost a call each.
JOINED = 200
_ASCII_MARKS = np.zeros(256, bool)
_ASCII_MARKS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ASCII_LETTERS = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
_SPACE, _LINE_FEED = 0x20, 0x0A
# Of a byte: white space between words; never in texts looked up by words; may begin a space of several bytes.
_WHITE, _OTHER, _MAY_BE_SPACE = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[[_SPACE, _LINE_FEED]] = _WHITE
_KINDS[[0x00, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = _OTHER
_KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = _MAY_BE_SPACE


def _wide_spaces(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where these three bytes begin with white space beyond ASCII."""
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return (
        (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        | (a == 0xE2) & general
        | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    )


def _single_spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: it is words with one space or line feed between them, and holds no other white space or zero byte."""
    kinds = _KINDS[data[: offsets[-1]]]
    white, other = kinds == _WHITE, kinds == _OTHER
    other[1:] |= white[1:] & white[:-1]
    may = np.flatnonzero(kinds == _MAY_BE_SPACE)
    other[may] |= _wide_spaces(data[may], data[may + 1], data[may + 2])
    out = np.diff(offsets) > 0
    out[np.searchsorted(offsets, np.flatnonzero(other), "right") - 1] = False
    there = np.flatnonzero(out)
    out[there] = ~(white[offsets[there]] | white[offsets[there + 1] - 1])
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters, of blocks that no version of Unicode changes: a-z, \u00c0 to \u0233, not \u00d7 or \u00f7."""
    out = _ASCII_LETTERS[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    a, b = data[at], data[at + 1]
    at = at[~((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) & ((a < 0xC8) | (b <= 0xB3))]
    out[at] = out[at + 1] = True
    return out


class Encoder:
    """Ids of texts; words met before are looked up instead of encoded again.

    A byte-level pre-tokenizer always cuts before a single space or line feed between two other characters,
    and never merges across a cut. So a text without other white space or white space in a row is the ids of
    its words, each with the space or line feed before it. Other texts are encoded as they are.

    A new word after a space that is letters and then marks is put together from the ids of both, as the pre-tokenizer
    cuts between them; ASCII letters go to the tokenizer's model as the pre-tokenizer would hand them over.
    """

    def __init__(self, spec: TokenSpec):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.spec = Tokenizer.from_file(spec.tokenizer), spec
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space or a line feed
        self.begins[[i for piece, i in vocabulary.items() if piece[:1] in _MARKS]] = True
        self.model = Tokenizer(self.tokenizer.model) if self._cuts_at_marks() else None
        self.known, self.flat, self.n_flat = WordTable(), np.zeros(1 << 14, np.uint32), 0
        self.starts, self.ends, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _cuts_at_marks(self) -> bool:
        """Does this tokenizer encode the letters and the marks of a word apart, and words that follow each other too?"""
        parts = json.loads(self.tokenizer.to_str())
        before, after = (parts[k] or {} for k in ("pre_tokenizer", "post_processor"))
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        # added tokens are found anywhere in a text: each has a mark before a letter, so none lies in letters and then marks
        apart = all(re.search(r"[\W\d_].*[^\W\d_]", t["content"], re.S) for t in parts["added_tokens"])
        model = parts["model"]
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        merges = model["type"] == "BPE" and not any(model.get(o) for o in options)
        alone = not any(re.search(f"[A-Za-z]{_MARKS[0]}", piece) for piece in model.get("vocab", ())) if merges else False
        return plain and apart and alone and parts["normalizer"] is None and after.get("type", "ByteLevel") == "ByteLevel"

    def _forget(self) -> None:
        """Of the words known, keep those looked up most often since the last time: half of them at most."""
        n, flat, starts, ends = self.known.n, self.flat, self.starts, self.ends
        often = np.sort(self.uses[1 : n + 1])[n // 2]
        stay = 1 + np.flatnonzero(self.uses[1 : n + 1] > often)
        self.known, self.flat, self.n_flat = self.known.only(stay), np.zeros(1 << 14, np.uint32), 0
        self.starts, self.ends, self.uses = (np.zeros(len(stay) + 1, np.int64) for _ in range(3))
        sizes = ends[stay] - starts[stay]
        self._put(sizes, flat[words.spread(starts[stay], sizes)])

    def _put(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the words known last, one word after the other."""
        n = self.known.n
        self.flat = roomy(self.flat, self.n_flat + len(ids))
        self.starts, self.ends, self.uses = (roomy(x, n + 1) for x in (self.starts, self.ends, self.uses))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        ends = self.n_flat + np.cumsum(sizes)
        self.ends[n + 1 - len(sizes) : n + 1], self.starts[n + 1 - len(sizes) : n + 1] = ends, ends - sizes
        self.n_flat += len(ids)

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words at these bytes of ``data``, each with the white space before it; new ones are encoded."""
        low, high = self.known.keys(data, starts, ends)
        out = self.known.find(low, high)
        new = np.flatnonzero(out == 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            own = order[first]
            self._learn(data, starts[own], ends[own], low[own], high[own])
            out[new] = self.known.find(low[new], high[new])
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Finds the ids of new words, and of what they are put together from: letters, and the marks behind them."""
        sizes = ends - starts
        data = np.concatenate([data[words.spread(starts, sizes)], np.zeros(SPARE, np.uint8)])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        begin, plain, both = data[starts], np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        if self.model:
            at = np.where(_ASCII_MARKS[data], -1, np.arange(len(data)))
            stems = np.maximum(np.maximum.accumulate(at)[ends - 1] + 1, starts)  # where the marks begin
            letters, wide = (np.concatenate([[0], np.cumsum(x)]) for x in (_letters(data), data >= 0x80))
            n_letters = stems - starts - 1
            lettered = (begin == _SPACE) & (n_letters > 0) & (letters[stems] - letters[starts + 1] == n_letters)
            both = lettered & (stems < ends)
            plain = lettered & ~both & (wide[ends] == wide[starts])
        if plain.any():
            text = data[words.spread(starts[plain], sizes[plain])].tobytes().decode().replace(" ", _MARKS[0])
            self._cut(self.model, _split(text, sizes[plain]), 0, low[plain], high[plain])
        # a text's first word has no white space before it, and is encoded alone
        spaced, others = (begin == _SPACE) | (begin == _LINE_FEED), ~(plain | both)
        own = np.concatenate([np.flatnonzero(others & spaced), alone := np.flatnonzero(others & ~spaced)])
        if len(own):
            joint = own[: len(own) - len(alone)]
            text = data[words.spread(starts[joint], sizes[joint])].tobytes()
            texts = _split(text, sizes[joint]) + [data[starts[i] : ends[i]].tobytes() for i in alone.tolist()]
            self._cut(self.tokenizer, [t.decode() for t in texts], len(alone), low[own], high[own])
        if both.any():
            # the ids of the letters and those of the marks, by turns
            source = [self._places(data, starts[both], stems[both]), self._places(data, stems[both], ends[both])]
            source = np.array(source).T.ravel()
            starts, sizes = self.starts[source], self.ends[source] - self.starts[source]
            self.known.add(low[both], high[both])
            self._put(sizes.reshape(-1, 2).sum(axis=1), self.flat[words.spread(starts, sizes)])

    def _cut(self, tokenizer, texts: list[str], n_alone: int, low: np.ndarray, high: np.ndarray) -> None:
        """Encodes ``JOINED`` words in a text, for new words with these keys: its ids are cut where one begins with white space.

        The last ``n_alone`` texts are one word each.
        """
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        own = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        begins = self.begins[own]
        alone = np.array([len(x) for x in found[len(found) - n_alone :]], np.int64)
        last = len(own) - int(alone.sum())
        begins[last:] = False
        begins[last + np.cumsum(alone) - alone] = True
        cuts = np.flatnonzero(begins)
        if len(cuts) != len(low):
            raise ValueError("a word's first id does not begin with the white space before it: not a byte-level tokenizer")
        self.known.add(low, high)
        self._put(np.diff(np.append(cuts, len(own))), own)

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        if self.known.n > self.spec.kept_words:
            self._forget()
        column = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        out = [np.zeros(0, np.uint32)] * len(column)
        if offsets[0] == offsets[-1]:
            return out
        own = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        data, offsets = np.concatenate([own, np.zeros(SPARE, np.uint8)]), offsets - offsets[0]
        sizes, by_words = np.diff(offsets), _single_spaced(data, offsets)
        whole = np.flatnonzero(~by_words & (sizes > 0))
        for i in whole.tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        looked_up = np.flatnonzero(by_words)
        if not len(looked_up):
            return out
        if len(whole):
            data = np.concatenate([data[: offsets[-1]][np.repeat(by_words, sizes)], np.zeros(SPARE, np.uint8)])
        texts_end = np.cumsum(sizes[looked_up])
        begins = _KINDS[data[: texts_end[-1]]] == _WHITE
        begins[0] = begins[texts_end[:-1]] = True
        starts = np.flatnonzero(begins)
        at = self._places(data, starts, np.append(starts[1:], texts_end[-1]))
        np.add.at(self.uses, at, 1)
        starts_of, n_ids = self.starts[at], self.ends[at] - self.starts[at]
        ids = self.flat[words.spread(starts_of, n_ids)]
        ends = np.concatenate([[0], np.cumsum(n_ids)])[np.searchsorted(starts, texts_end)].tolist()
        for i, first, last in zip(looked_up.tolist(), [0, *ends], ends):
            out[i] = ids[first:last]
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]


def _split(text: str | bytes, sizes: np.ndarray) -> list:
    """``text``, which is words of these sizes, in texts of ``JOINED`` words."""
    bounds = [0, *np.cumsum(sizes).tolist()]
    cuts = [*bounds[: len(sizes) : JOINED], bounds[-1]]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_BLOCK = "file int, block int, doc_ids array<long>, doc_tokens array<long>, ids binary"


def token_blocks(docs: DataFrame, spec: TokenSpec) -> DataFrame:
    """(file, block, doc_ids, doc_tokens, ids): blocks of whole documents in ascending order; ids: u32, packed."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-n_bytes // spec.file_bytes))
    # texts are shuffled as they are: bounds are found by a scan that does no more than hash them
    body = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    dealt = body.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    numbered = dealt.select(F.spark_partition_id().alias("file"), "doc_id", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = worker_encoder(spec), zstandard.ZstdCompressor(level=1)
        file, block, ids, own, n = 0, 0, [], [], 0
        end = np.array([spec.end_id], np.uint32)

        def row() -> pa.RecordBatch:
            bound = np.concatenate(own)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in own]], pa.list_(pa.int64())),
                    pa.array([press.compress(bound.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
                ],
                ["file", "block", "doc_ids", "doc_tokens", "ids"],
            )

        for batch in shared.lean(batches):
            for at in range(0, batch.num_rows, 256):
                files, doc_ids, texts = batch.slice(at, 256).columns
                found = encoder.many(texts)
                for file, d, x in zip(files.to_pylist(), doc_ids.to_pylist(), found):
                    ids.append(d)
                    own.append(np.concatenate([x, end]))
                    n += len(own[-1])
                    if n >= spec.block_tokens:
                        yield row()
                        block, ids, own, n = block + 1, [], [], 0
        if own:
            yield row()

    return numbered.mapInArrow(gather, _BLOCK)


_KEPT: dict[TokenSpec, Encoder] = {}


def worker_encoder(spec: TokenSpec) -> Encoder:
    """One encoder for each Python worker, kept between tasks with the words it knows."""
    if spec not in _KEPT:
        _KEPT[spec] = Encoder(spec)
    return _KEPT[spec]


def unpacked_ids(body: bytes) -> np.ndarray:
    """The u32 ids of a block; their bytes are stored plane by plane."""
    planes = np.frombuffer(shared.unpacked([body])[0], np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def count_ids(blocks: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in shared.lean(batches):
            for body in batch.column(0).to_pylist():
                own = np.bincount(unpacked_ids(body))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    return blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, spec: TokenSpec) -> None:
    """Encode all texts of ``docs`` (doc_id, text) and write ``folder``."""
    spark = docs.sparkSession
    blocks = shared.written(token_blocks(docs, spec), "token-blocks", compact=True)
    counts = count_ids(blocks).collect()  # as many rows as the vocabulary has ids
    ids = np.array([r.id for r in counts], np.int64)
    by_id = np.argsort(ids)
    size = int(ids.max()) + 1 if len(ids) else 1
    frequency = rans.frequency_table(ids[by_id], np.array([r.n for r in counts], np.float64)[by_id], size)
    spark.createDataFrame(
        [(int(i), int(frequency[i])) for i in np.flatnonzero(frequency)], "id long, frequency long"
    ).coalesce(1).write.parquet(f"{folder}/table")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequency)
        for batch in shared.lean(batches):
            for i, body in enumerate(batch.column(4).to_pylist()):
                frame = rans.encode(unpacked_ids(body).astype(np.int64), table)
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array([frame], pa.binary())], [*_NAMES, "frame"])

    coded = blocks.select(*_NAMES, "ids").mapInArrow(frames, _BLOCK.replace("ids binary", "frame binary"))
    coded.write.options(**shared.COMPACT).parquet(f"{folder}/blocks")
    shared.discard(blocks)


_NAMES = ["file", "block", "doc_ids", "doc_tokens"]


def read_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The shared frequencies by id; at most as many rows as the vocabulary has ids."""
    rows = spark.read.schema("id long, frequency long").parquet(f"{folder}/table").collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.frequency
    return out


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids u32 binary]) of every document, decoded from the frames."""
    frequency = read_table(spark, folder)
    blocks = spark.read.schema(_BLOCK.replace("ids binary", "frame binary")).parquet(f"{folder}/blocks")
    schema = "file int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequency)
        for batch in shared.lean(batches):
            for file, block, docs, sizes, frame in zip(*(c.to_pylist() for c in batch.columns)):
                ids = rans.decode(frame, table).astype("<u4")
                ends = np.cumsum(sizes)
                bodies = [ids[e - n : e].tobytes() for n, e in zip(sizes, ends)]
                columns = [
                    pa.array([file] * len(docs), pa.int32()),
                    pa.array([block] * len(docs), pa.int32()),
                    pa.array(docs, pa.int64()),
                    pa.array(ends - np.array(sizes), pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                ] + [pa.array(bodies, pa.binary())] * with_ids
                names = ["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    size = F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("file", "block", size.alias("n"))
    before = (Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("n").alias("n")).select(  # one row a file
        "file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(*before)), F.lit(0)).alias("first")
    )
    firsts = sizes.join(files, "file").select(
        "file",
        "block",
        (F.col("first") + F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(*before)), F.lit(0))).alias("first"),
    )
    return (
        blocks.mapInArrow(unfold, schema)
        .join(firsts, ["file", "block"])
        .select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    )


def token_digest(docs: DataFrame, folder: str, spec: TokenSpec) -> DataFrame:
    """Write the token files of ``docs`` to ``folder`` and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    write_tokens(docs, folder, spec)
    return read_documents(docs.sparkSession, folder)
