"""What the executors hold: pages of block files, rows of a scan, and what a Python worker keeps between batches."""

import glob
import os
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from armscope.llm import shared, token_files  # noqa: E402
from armscope.llm.queries import tokenizer  # noqa: E402
from armscope.llm.ship import ship  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def resident_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_lean_hands_on_every_batch_and_gives_memory_back():
    there = [pa.record_batch([pa.array([i, None, i + 1])], ["x"]) for i in range(3)]
    got, pins, after = [], [], []
    for batch in shared.lean(iter(there)):
        after.append(resident_mb())
        got.append(batch)
        held = [bytes(3000) for _ in range(20_000)]
        full = resident_mb()
        pins.append([bytes(3000) for _ in range(50)])  # above what is freed: the allocator can't cut its heap here
        del held
    assert got == there
    assert full - resident_mb() > 40


@pytest.fixture
def blocks_folder(spark, tmp_path):
    ship(spark)
    texts = [(i, f"word{i} " * 400) for i in range(64)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    spec = token_files.TokenSpec(tokenizer(), block_tokens=4000)
    token_files.write_tokens(docs, str(tmp_path / "tokens"), spec)
    return str(tmp_path / "tokens"), spec, texts


def test_blocks_are_not_compressed_again_and_read_back(spark, blocks_folder):
    folder, spec, texts = blocks_folder
    files = glob.glob(f"{folder}/blocks/*.parquet")
    for file in files:
        groups = pq.ParquetFile(file).metadata
        for g in range(groups.num_row_groups):
            assert {groups.row_group(g).column(c).compression for c in range(groups.num_columns)} == {"UNCOMPRESSED"}
    rows = {r.doc_id: r.n_tokens for r in token_files.read_documents(spark, folder).collect()}
    encoder = token_files.Encoder(spec)
    assert rows == {i: len(encoder.ids(t or "")) + 1 for i, t in texts}


def test_pages_of_blocks_end_with_the_row_that_fills_them(spark, tmp_path):
    """A page per block of over a MB; before, up to 100 such blocks were one page."""
    path = str(tmp_path / "large")
    rows = spark.range(12).selectExpr("id", "cast(repeat(cast(id as string), 1200000) as binary) as ids").coalesce(1)
    rows.write.options(**shared.COMPACT).parquet(path)
    (file,) = glob.glob(f"{path}/*.parquet")
    column = pq.ParquetFile(file).metadata.row_group(0).column(1)
    # each page begins with a header of some bytes, and each value with four bytes of length
    sizes = [len(r.ids) + 4 for r in rows.collect()]
    headers = column.total_uncompressed_size - sum(sizes)
    assert headers >= 10 * len(sizes)


def test_a_stage_scans_few_rows_at_once(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(name)
    try:
        docs = shared.written(spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA), "few")
        mixed = corpus_pipeline.mix_sources(spark, docs, "")
        assert int(spark.conf.get(name)) <= 512
        assert [r.doc_id for r in mixed.collect()] == [1]
    finally:
        spark.conf.unset(name)
