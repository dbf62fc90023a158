import json
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from armscope.llm import mixing, rans, ship, token_files, word_table  # noqa: E402
from armscope.llm.queries import tokenizer as tokenizer_file  # noqa: E402
from armscope.session import new_folder  # noqa: E402

SPEC = token_files.TokenSpec(tokenizer_file(), block_tokens=500)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000])
def test_frames_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int64)
    found, counts = np.unique(ids, return_counts=True)
    table = rans.Table(rans.frequency_table(found, counts.astype(float), 50_257))
    frame = rans.encode(ids, table)
    assert (rans.decode(frame, table) == ids).all()
    if n > rans.LANES * rans.CHECKPOINT:
        assert (rans.decode(frame, table, start=1) == ids[rans.LANES * rans.CHECKPOINT :]).all()
    broken = bytearray(frame)
    broken[-8] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)


def test_frequencies_cover_every_symbol():
    counts = np.array([1.0, 1e12, 3.0])
    out = rans.frequency_table(np.array([2, 5, 9]), counts, 12)
    assert out.sum() == 1 << rans.BITS and (out[[2, 5, 9]] > 0).all() and out[3] == 0


@pytest.mark.parametrize("kept,joined", [(600_000, 200), (40, 3)])
def test_remembered_words_change_no_id(tokenizer, monkeypatch, kept, joined):
    monkeypatch.setattr(token_files, "JOINED", joined)
    encoder, rng = token_files.Encoder(token_files.TokenSpec(tokenizer_file(), kept_words=kept)), random.Random(3)
    bits = ["a", "the", "'s", " ", "  ", "\n", "\n\n", "\t", "23", "é", "ß!", "<|endoftext|>", " ", "　", "Ä", "don't", ".", ",", "\0", "x\x1cy"]
    plain = ["a", "the's", "é,", "23.", "\nA", "b\nc", "<|endoftext|>", "!?.", "end.", "ab,,", "1,", "ª."]
    for i in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        if i % 2:
            text = " ".join(rng.choice(plain) for _ in range(rng.randint(1, 8)))
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


class _Noted:
    """A tokenizer that notes what it is given."""

    def __init__(self, own):
        self.own, self.seen = own, []

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.own.encode_batch_fast(texts, **options)


def test_letters_are_encoded_once_for_all_marks_behind_them(tokenizer):
    encoder = token_files.Encoder(token_files.TokenSpec(tokenizer_file()))
    encoder.model, encoder.tokenizer = _Noted(encoder.model), _Noted(encoder.tokenizer)
    text = "a quixotry, quixotry. quixotry quixotry!?) naïvetéx; naïvetéx don't' x'' <|endoftext|>, b2. ª."
    for _ in range(2):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    seen = " ".join(encoder.model.seen + encoder.tokenizer.seen)
    assert seen.count("quixotry") == 1 and seen.count("naïvetéx") == 1


def test_words_are_looked_up_by_arrays():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(1, 20))) for _ in range(20_000)]
    order = list(dict.fromkeys(texts))
    data = np.frombuffer(b"".join(texts) + bytes(word_table.SPARE), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    known = word_table.WordTable()
    low, high = known.keys(data, ends - [len(t) for t in texts], ends)
    assert not known.find(low, high).any()
    first = np.array([texts.index(t) for t in order[:500]])
    known.add(low[first], high[first])
    want = {t: i for i, t in enumerate(order[:500], 1)}
    assert known.find(low, high).tolist() == [want.get(t, 0) for t in texts]
    kept = known.only(np.arange(2, 501, 2))
    want = {t: i // 2 for t, i in want.items() if i % 2 == 0}
    assert kept.find(low, high).tolist() == [want.get(t, 0) for t in texts]


def test_texts_of_one_batch_do_not_touch(tokenizer):
    encoder = token_files.Encoder(token_files.TokenSpec(tokenizer_file(), kept_words=20))
    texts = ["one two", None, "two", "", "three, two", " two", "two\n", "one\ntwo", "one\u2003two", "\u2019two\u2019 two", "two\u3000", "\u30b3two", "x" * 40 + " two;"]
    for _ in range(3):
        found = encoder.many(pa.array(["cut off", *texts])[1:])
        assert [x.tolist() for x in found] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_batches_of_long_rows_are_small(spark):
    ship.ship(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = spark.range(0, 40, 1, 1).selectExpr("cast(repeat('x', 500000) as binary) AS b")
    got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 40 and max(r.size for r in got) < ship.BATCH_BYTES + 600_000


@pytest.mark.parametrize(
    "change",
    [
        {"added_tokens": [{"id": 50257, "content": "ab,", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
        {"normalizer": {"type": "Lowercase"}},
    ],
)
def test_tokenizers_that_may_not_cut_at_marks_get_whole_words(tmp_path, change):
    from tokenizers import Tokenizer

    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps({**json.loads(Path(tokenizer_file()).read_text()), **change}))
    encoder = token_files.Encoder(token_files.TokenSpec(str(path)))
    assert encoder.model is None
    text = "The Ab, ab, cab. Cab!"
    if "pre_tokenizer" not in change:
        assert encoder.ids(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_files_hold_every_document_in_order(spark, tokenizer):
    docs = brute.odd_documents(spark)
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, SPEC)
    got = token_files.read_documents(spark, folder, with_ids=True).orderBy("start").collect()
    assert len(got) == docs.count()
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    want = sorted((str(i), tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in brute.pairs(docs))
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want


def test_no_documents(spark):
    none = brute.empty_documents(spark)
    assert token_files.token_digest(none, new_folder(spark, "tokens"), SPEC).count() == 0
    assert mixing.mixed_sizes(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_targets_stop_at_the_cap_and_reshare():
    sizes = [100, 1000, 1000, 0, 50]
    goal = mixing.targets(sizes, mixing.MixSpec())
    assert abs(sum(goal) - 1.5 * sum(sizes)) < 1e-6
    assert all(g <= 2 * s + 1e-9 for g, s in zip(goal, sizes))
    free = [i for i, (g, s) in enumerate(zip(goal, sizes)) if g < 2 * s - 1e-9]
    weight = [5, 2, 1, 5, 2]
    assert len({round(goal[i] / weight[i], 6) for i in free}) <= 1


def test_permutations_and_shards():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    quota, spec, known = np.array([5000, 0, 123, 9000]), mixing.MixSpec(shard_slots=64), {}
    before = np.zeros(4, np.int64)
    for shard in range(-(-quota.sum() // 64)):
        start, here = mixing.shard_counts(quota, shard, spec, known)
        assert (start == before).all() and here.sum() == min(64, quota.sum() - before.sum())
        before = before + here
    assert (before == quota).all()


def test_very_many_slots_are_drawn_too():
    quota = np.array([2 * 10**9, 0, 10**9, 5])
    slots, total = 1_200_000_000, int(quota.sum())
    drawn = np.array([mixing._halve(quota, slots, (0, i), 41) for i in range(300)])
    assert (drawn.sum(axis=1) == slots).all() and (drawn <= quota).all() and (drawn >= 0).all()
    for i in (0, 2):
        share = quota[i] / total
        sd = np.sqrt(slots * share * (1 - share) * (total - slots) / (total - 1))
        assert abs(drawn[:, i].mean() - slots * share) < 5 * sd / np.sqrt(300)
        assert 0.8 < drawn[:, i].std() / sd < 1.2
    rng = np.random.default_rng(3)  # the law itself, where numpy draws it as well
    for good, bad, n in ((7, 5, 6), (3, 400, 50), (60, 2, 61)):
        own = [mixing._large_hypergeometric(rng, good, bad, n) for _ in range(4000)]
        assert abs(np.mean(own) - rng.hypergeometric(good, bad, n, 40_000).mean()) < 0.1
    assert mixing._large_hypergeometric(rng, 5, 0, 3) == 3 and mixing._large_hypergeometric(rng, 5, 4, 9) == 5


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, brute.prose(rng, rng.randint(0, 200)), rng.choice(["a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spec = mixing.MixSpec(block=16, bin_rows=50, shard_slots=100)
    got = mixing.mixed_sizes(docs, spec).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed_sizes(docs, spec).collect()))
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split())
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 32, s
    mixed = mixing.mixed_documents(docs, spec)
    assert mixed.schema == docs.schema
    words = {r.doc_id: r.taken for r in got}
    for r in mixed.collect():
        own = set(rows[r.doc_id][1].split())
        cut = r.text.split(" ")
        assert len(cut) == words[r.doc_id] and set(cut) <= own
    assert {r.doc_id for r in mixed.collect()} == {i for i, n in words.items() if n}


def test_white_space_inside_a_run_stays(spark):
    rng = random.Random(12)
    texts = {i: "\n\n".join("\t" + brute.prose(rng, 7) + "  " + brute.prose(rng, 6) for _ in range(rng.randint(1, 9))) for i in range(60)}
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs, mixing.MixSpec(share=1.0, block=16)).collect()
    whole = [r for r in mixed if r.text == texts[r.doc_id].strip()]
    assert len(whole) == len(texts)  # each word once: all blocks of a document are one run
    parts = mixing.mixed_documents(docs, mixing.MixSpec(share=0.5, block=16)).collect()
    assert any("\n\n\t" in r.text for r in parts)
    for r in parts:  # the words between two joints are in the document as they are
        left, known = r.text, texts[r.doc_id]
        while left:
            end = max(k for k in [*(m.start() for m in re.finditer(" ", left)), len(left)] if left[:k] in known)
            assert end
            left = left[end + 1 :]


def test_odd_documents_are_mixed(spark):
    docs = brute.odd_documents(spark)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == docs.count()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t in brute.pairs(docs))
    assert sorted(r.size for r in got) == sizes
    mixed = mixing.mixed_documents(docs).collect()
    assert len(mixed) == sum(r.taken > 0 for r in got)
    assert all(r.n_chars == len(r.text) and r.key == "k" for r in mixed)
