"""From raw documents to a mixed, tokenized corpus: each stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the digest of
the token files it wrote. Between stages rows are written as Parquet and read again; what a stage wrote on its way is
deleted when the next one starts.

In every stage: a null text is an empty one, and stays; texts of any length are taken whole; repeated rows stay
repeated rows (a copy under the same id is no near duplicate); a null id is a document of its own that is never removed
as a near copy; columns beyond those of documents, whatever their
names, are passed on as they are; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armscope.llm import decontaminate, mixing, near_duplicates, queries, shared, token_files, toxicity
from armscope.llm.ship import ship
from armscope.session import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of Parquet that a scan holds as arrays at once: thousands of whole texts are tens of MB a task, a few hundred are one or two.
SCAN_ROWS = 256


def stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)
        with shared.stage(docs):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


#: The stage links at a similarity of 0.8; with 37 bands a pair there is missed with a chance of 4e-7. Each text stands
#: for itself: a copy goes, another text under its id stays.
NEAR = near_duplicates.NearDuplicates(percent=80, bands=37, ids_link=False)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    gone = near_duplicates.near_duplicates(docs, NEAR).where("not kept").select("doc_id", "text_hash").distinct()
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or within the edit tolerance, go."""
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights; a document's text becomes the words that the mix takes of it."""
    return mixing.mixed_documents(docs)


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_digest(docs, new_folder(spark, "tokens"), token_files.TokenSpec(queries.tokenizer(), kept_words=100_000))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The stages rest on fitted models, hashing and drawing, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, work in STAGES[:-1]:
        docs = shared.written(work(spark, docs, sf_dir), name)
        if before is not None:
            shared.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
