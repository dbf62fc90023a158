import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from armscope.llm import repeats, substring_automata, suffix_pfp, words  # noqa: E402


@pytest.mark.parametrize("hot", [20_000, 1])
def test_words_that_repeat_anywhere_go(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = brute.odd_documents(spark)
    got = substring_automata.without_repeats(docs, with_text=True).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == brute.word_repeats(
        brute.pairs(docs)
    )
    assert all(len(r.kept_text.split()) == r.n_words - r.n_removed for r in got)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_bytes_that_start_earlier_go(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = brute.odd_documents(spark)
    rows = brute.pairs(docs.where("doc_id is null or doc_id not in (12, 13)"))  # of one id, order is by hash
    got = suffix_pfp.without_repeats(docs.where("doc_id is null or doc_id not in (12, 13)")).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute.byte_repeats(
        sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    )
    both = suffix_pfp.without_repeats(docs.where("doc_id = 12"), with_text=True).collect()
    assert sorted(r.n_removed > 0 for r in both) == [False, False, True]  # the repeated row is the later copy


def test_empty_tables(spark):
    none = brute.empty_documents(spark)
    assert substring_automata.without_repeats(none).count() == 0
    assert suffix_pfp.without_repeats(none).count() == 0


def test_every_window_has_one_anchor_that_equal_windows_share(monkeypatch):
    spec = repeats.Windows("byte", 8, 3, False)
    rng = np.random.default_rng(1)
    for place in (15, (1 << 20) - 1):  # the first lets the low bits start anew often
        monkeypatch.setattr(repeats, "PLACE", place)
        for _ in range(60):
            symbols = words.mixed(rng.integers(0, 2, rng.integers(8, 120)).astype(np.uint64))
            offsets = np.array([0, len(symbols) // 2, len(symbols)])
            anchors, n = {}, 0
            for r, s, c, a, _ in zip(*repeats.pieces(symbols, offsets, spec)):
                own = [symbols[offsets[r] + s + k : offsets[r] + s + k + 8].tobytes() for k in range(c)]
                assert len(set(own)) == c
                n += c
                for w in own:
                    assert anchors.setdefault(w, a) == a
            assert n == sum(max(0, int(x) - 7) for x in np.diff(offsets))


def _pieces(rng, window):
    out = []
    for i in range(rng.randint(1, 8)):
        body = bytes(rng.choice(b"\0ab") for _ in range(rng.randint(window, window + 14)))
        out.append(repeats.Piece(1, rng.randrange(5), 100 * i, len(body) - window + 1, body))
    return out


def test_shard_decisions_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        w = rng.choice([3, 5, 8])
        pieces = _pieces(rng, w)
        places = {}
        for p in pieces:
            for k in range(p.windows):
                places.setdefault(p.body[k : k + w], []).append((p.row, p.start + k))
        spec = suffix_pfp.ParsingSpec(min_bytes=w, gram_bytes=2, trigger=2, modulus=rng.choice([2, 3, 16]))
        for p, gone in zip(pieces, suffix_pfp.decide_by_suffix_order(spec)(pieces)):
            assert gone.tolist() == [min(places[p.body[k : k + w]]) != (p.row, p.start + k) for k in range(p.windows)]
        longs = [repeats.Piece(1, p.row, p.start, p.windows, np.frombuffer(p.body, np.uint8).astype("<u8").tobytes()) for p in pieces]
        count = Counter(p.body[k : k + w] for p in pieces for k in range(p.windows))
        for p, gone in zip(pieces, substring_automata.decide_by_automaton(w)(longs)):
            assert gone.tolist() == [count[p.body[k : k + w]] > 1 for k in range(p.windows)]


@pytest.mark.parametrize("unit,window,gram", [("byte", 12, 4), ("byte", 11, 4), ("word", 9, 2)])
def test_of_an_anchor_only_pieces_that_can_share_a_window_meet(unit, window, gram):
    spec, rng, n_left, n_all = repeats.Windows(unit, window, gram, True), random.Random(7), 0, 0
    for _ in range(40):
        kinds = {}
        for row in range(12):
            text = b" ".join(rng.choice([b"a", b"b", b"cd"]) for _ in range(rng.randint(0, 40)))
            part = next(words.parts(pa.array([text], pa.large_binary())))
            symbols, offsets = spec.symbols(part)
            for _, start, n, a, p, g in zip(*repeats.pieces(symbols, offsets, spec, located=True)):
                end = start + n + window - 1
                body = (symbols.astype("<u8") if unit == "word" else part.data)[start:end].tobytes()
                kinds.setdefault(int(a), {}).setdefault(body, (repeats.Piece(1, row, int(start), int(n), body), int(g)))
        size = 8 if unit == "word" else 1
        for own in (list(zip(*x.values())) for x in kinds.values()):
            pieces, anchors = map(list, own)
            held = [{p.body[size * k : size * (k + window)] for k in range(p.windows)} for p in pieces]
            left = repeats.may_share(pieces, anchors, spec)
            for p, mine in zip(pieces, held):
                if any(mine & other for other in held if other is not mine):
                    assert p in left
            n_left, n_all = n_left + len(left), n_all + len(pieces)
    assert 0 < n_left < n_all


def test_pieces_alike_at_their_anchor_only_do_not_meet():
    spec = repeats.Windows("byte", 12, 4, True)
    bodies = [b"01234567ANCH89012345", b"ghijklmnANCHopqrstuv", b"ghijABCDANCHEFGHopqr", b"01234567ANCH8901wxyz"]
    pieces = [repeats.Piece(1, i, 0, 9, b) for i, b in enumerate(bodies)]
    assert [p.row for p in repeats.may_share(pieces, [8] * 4, spec)] == [0, 3]


def test_spans_of_rows_and_what_they_cover():
    spans = pa.array([[(1, 3), (2, 5)], None, [], [(0, 1), (6, 7)]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    for first in range(4):
        got = [np.flatnonzero(repeats.covered(*x, 7)).tolist() for x in repeats.spans_of_rows(spans.slice(first))]
        assert got == [[1, 2, 3, 4], [], [], [0, 6]][first:]
