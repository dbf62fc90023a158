"""Each stage on planted documents, and the registered queries."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

import __spark_entry__  # noqa: E402
from armscope.llm import queries, shared  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage kept of the documents and some planted ones."""
    docs = queries.table(spark, SF, "documents")
    item = queries.table(spark, SF, "benchmark").first().text
    rng = random.Random(9)
    clean = [(9000 + i, brute.prose(rng, 120)) for i in range(5)]
    near = clean[0][1].split()
    near[60] = "other"
    planted = clean + [(9100, clean[1][1]), (9101, " ".join(near)), (9200, clean[2][1][:200] + " " + item), (9300, None), (9301, "")]
    planted += [(9400, clean[3][1][:300] + " idiot stupid scum moron trash")]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], docs.schema)
    docs, out = shared.written(docs.unionByName(more), "planted"), {}
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF), name)
        out[name] = docs
        if name != "tokens":
            assert docs.schema == schema
    return {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in out.items()} | {"rows": out}


def test_stages_take_out_what_they_should(kept):
    assert 9400 not in kept["toxicity"] and {*range(9000, 9005), 9300, 9301} <= kept["toxicity"]
    assert not {9100, 9101} & kept["near_duplicates"] and set(range(9000, 9005)) <= kept["near_duplicates"]
    assert 9200 not in kept["decontamination"] and set(range(9000, 9005)) <= kept["decontamination"]
    assert kept["mixing"] <= kept["decontamination"] and kept["tokens"] == kept["mixing"]
    mixed, tokens = kept["rows"]["mixing"], kept["rows"]["tokens"]
    assert tokens.count() == mixed.count()
    rows = tokens.orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_near_duplicate_stage_equals_brute_force(spark, kept):
    """At the stage's similarity of 0.8, which links some pairs that 0.85 does not."""
    rows = brute.pairs(kept["rows"]["toxicity"])
    roots = brute.near_components(rows, 80)
    assert kept["near_duplicates"] == {i for i, r in roots.items() if i == r}
    assert roots != brute.near_components(rows)


def test_stages_on_an_empty_table(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names
