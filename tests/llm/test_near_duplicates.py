import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from armscope.llm import near_duplicates as near  # noqa: E402
from armscope.llm import shared  # noqa: E402


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 2)  # buckets go through several cells
    docs = brute.odd_documents(spark)
    rows = brute.pairs(docs)
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute.near_components([r for r in rows if r[0] is not None])
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted([(r.doc_id, r.n_shingles) for r in got], key=repr) == sorted(
        [(i, len(brute.shingle_set(t))) for i, t in rows], key=repr
    )


def test_a_chain_and_unlike_texts(spark):
    import random

    rng = random.Random(1)
    rows, text = [], brute.prose(rng, 200).split()
    for i in range(12):  # each close to the one before, the last far from the first
        rows.append((i, " ".join(text)))
        text[i * 15] = "new" + str(i)
    rows += [(100 + i, brute.prose(rng, 60)) for i in range(5)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near_components(rows)


def near_rows(spark, rows, spec=near.NearDuplicates()):
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), spec).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.component_id for r in got} == brute.near_components(rows)
    return got


def test_texts_under_one_id_link_it(spark):
    import random

    rng = random.Random(4)
    a, b, c = (brute.prose(rng, n) for n in (100, 140, 90))
    near_rows(spark, [(1, a), (2, a), (2, b)])
    near_rows(spark, [(1, a), (2, a + " more"), (2, b), (3, b), (4, "z " + b)])
    near_rows(spark, [(5, a), (5, b), (5, ""), (5, None), (6, b + " end"), (7, c), (3, c + " end"), (7, a), (8, "")])


def test_texts_on_their_own(spark):
    import random

    rng = random.Random(14)
    a, b, c = (brute.prose(rng, n) for n in (100, 140, 90))
    rows = [(1, a), (2, a), (2, b), (3, b + " end"), (4, c), (4, c), (4, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(docs, near.NearDuplicates(ids_link=False)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == sorted(
        [(1, 96, 1, True), (2, 96, 1, False), (2, 136, 2, True), (3, 137, 2, False), (4, 86, 4, True), (4, 86, 4, True), (4, 0, 4, True)]
    )
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_a_third_of_the_rows_under_one_id(spark):
    import random

    rng = random.Random(6)
    rows = [(i, brute.prose(rng, 30)) for i in range(60)] + [(17, brute.prose(rng, 30)) for _ in range(30)]
    rows += [(100, rows[70][1] + " end"), (101, rows[20][1] + " end")]
    got = near_rows(spark, rows)
    assert {r.component_id for r in got if r.doc_id in (17, 100)} == {17}


def test_a_hot_bucket_makes_few_pairs(spark, monkeypatch):
    import random

    rng = random.Random(8)
    words, rows = brute.prose(rng, 300).split(), []
    for i in range(3000):
        own = list(words)
        own[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(5000 + i, " ".join(words[: 200 + i]) + " " + brute.prose(rng, 100 - i)) for i in range(40)]
    checked, real = [], near.confirmed

    def counted(pairs, *more):
        checked.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(near, "confirmed", counted)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 3000} == {0}
    assert sum(checked) <= near.NearDuplicates().bands * len(rows)  # of 4.5 million


def test_empty_table(spark):
    assert near.near_duplicates(brute.empty_documents(spark)).count() == 0


def test_sketch_estimates_high_similarity():
    spec, rng = near.NearDuplicates(), np.random.default_rng(3)
    factors = (rng.integers(0, 1 << 31, spec.samples, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, spec.samples, dtype=np.uint32)
    errors = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, 75), dtype=np.uint64)
        bits = [
            np.frombuffer(near.odd_sketch(near.min_samples(np.concatenate([both, o]), factors, shifts), spec.bits), np.uint8)
            for o in own
        ]
        errors.append(near.estimates(np.bitwise_count(bits[0] ^ bits[1]).sum(), spec.bits, spec.samples) - 0.85)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03
    assert min(errors) > spec.sketch_bound - 0.85


def test_components_of_stars_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    got = shared.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {
        **{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 203)}
    }
