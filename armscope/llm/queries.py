"""The operators as named queries over whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armscope.llm import collocations, decontaminate, language_kn, learned_partitions, line_frequency, mixing
from armscope.llm import hard_negatives as hard
from armscope.llm import near_duplicates as near
from armscope.llm import quality_cascade, substring_automata, suffix_pfp, token_files, toxicity
from armscope.llm.ship import ship
from armscope.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    """The public vocabulary file of the token query; a parameter, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_odd_sketch_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


@query("op2_toxicity_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_cgk_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_block_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_rans_tokens")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = token_files.TokenSpec(tokenizer())
    return token_files.token_digest(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), spec)


@query("op10_site_line_frequency", line_frequency.sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.without_boilerplate(table(spark, sf_dir, "pages"))


@query("op5_quality_cascade", quality_cascade.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality(table(spark, sf_dir, "documents"))


@query("op6_kneser_ney_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_kn.predicted_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")


@query("op1_suffix_automata_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_automata.without_repeats(table(spark, sf_dir, "documents"))


@query("op3_prefix_free_parsing_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pfp.without_repeats(table(spark, sf_dir, "documents"))


#: Labels of every seventh vector are moved on by one, as noise.
NOISY_LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@query("op11_angular_hard_negatives", hard.sql(NOISY_LABEL))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr(NOISY_LABEL))
    found = hard.hard_negatives(rows.withColumn("anchor", F.col("vec_id") % 50 == 0))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op12_phrase_collocations", collocations.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_learned_partition_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = learned_partitions.nearest_neighbours(rows.withColumn("query", F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", "vec_id", "score")
