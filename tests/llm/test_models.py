import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_text import text_of

from tabspark.llm import lattice, quality, toxicity

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def brute_force(own, word, weights):
    """Sum over all segmentations, one by one."""
    text = b" " + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(text)]
        p = 0.0
        for s, e in itertools.pairwise(at):
            k = own_pieces(own).get(text[s:e])
            if k is None:
                break
            p += weights[k]
        else:
            total += math.exp(p)
    return math.log(total)


def own_pieces(own):
    import sentencepiece

    if not hasattr(own, "_pieces"):
        model, pieces = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY), {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
                piece = model.id_to_piece(k).replace("▁", " ").encode()
                if b" " not in piece[1:]:
                    pieces.setdefault(piece, len(pieces))
        for b in range(256):
            pieces.setdefault(bytes([b]), len(pieces))
        own._pieces = pieces
    return own._pieces


def test_marginal_is_the_sum_over_all_segmentations():
    own = lattice.lattice(VOCABULARY)
    words = [b"the", b"thing", "café".encode(), b"a", "é中".encode(), b"\x01z", b"international"]
    got = own.log_probability(words, own.weights)
    assert np.allclose(got, [brute_force(own, w, own.weights) for w in words], rtol=1e-9)


def test_expected_counts_are_the_gradient_and_grow_the_likelihood():
    own = lattice.lattice(VOCABULARY)
    words, counts = [b"thing", b"things", b"nothing", b"the", b"x" * 70], np.array([3.0, 1.0, 2.0, 9.0, 1.0])
    used = own.expected(words, counts, own.weights)
    # every segmentation covers every byte once
    lengths = np.zeros(own.n)
    for piece, k in own_pieces(own).items():
        lengths[k] = len(piece)
    assert abs((used * lengths).sum() - sum((len(w) + 1) * c for w, c in zip(words, counts))) < 1e-6
    for k in np.argsort(used)[-3:]:
        step = own.weights.copy()
        step[k] += 1e-6
        slope = ((own.log_probability(words, step) - own.log_probability(words, own.weights)) * counts).sum() / 1e-6
        assert abs(slope - used[k]) < 1e-3 * max(1, used[k])
    better = np.log((used + 1e-6) / (used + 1e-6).sum())
    assert (own.log_probability(words, better) * counts).sum() > (own.log_probability(words, own.weights) * counts).sum()


def test_document_scores_against_plain(rows, monkeypatch):
    docs = [(k, text_of(k % 7, 5 + 3 * k)) for k in range(30)] + [(40, None), (41, ""), (42, "UPPER upper\tUpper"), (43, "q" * 30000), (44, text_of(3, 9)), (44, text_of(3, 9))]
    table = rows("doc_id long, text string, h long, c long", *((k, t, 0, 0) for k, t in docs))
    train = [(k, t) for k, t in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    from pyspark.sql import functions as F

    kept = table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    tokens = lambda t: (t or "").encode().lower().split()
    count = Counter(w for _, t in train for w in tokens(t))
    n, kinds = sum(count.values()) + len(train), len(count) + 1
    for frequent in (lattice.FREQUENT, 20):  # all words broadcast, or most joined
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        model = lattice.fit(kept, VOCABULARY)
        assert (model.tokens, model.kinds) == (n, kinds)
        got = lattice.score(table, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(k for k, _ in docs)
        own, by_id = lattice.lattice(VOCABULARY), dict(docs)
        for r in got:
            ws = tokens(by_id[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(w in count for w in ws) + 1, n)
            base = sum(math.log10((count[w] + 1) / (n + kinds + 1)) for w in ws) + math.log10((len(train) + 1) / (n + kinds + 1))
            assert r.base_score == pytest.approx(base, rel=1e-9)
            paths = own.log_probability(ws, model.weights)
            score = math.log10((len(train) - model.discount) / n)
            for w, lp in zip(ws, paths):
                p = max(count[w] - model.discount, 0) / n + model.back_off * math.exp(lp)
                score += math.log10(p) if p > 1e-290 else math.log10(model.back_off) + lp / math.log(10)
            assert r.score == pytest.approx(score, rel=1e-9)


def test_scores_without_training_texts_and_of_nothing(rows):
    table = rows("doc_id long, text string", (1, "some words"), (2, None))
    model = lattice.fit(table.where("false"), VOCABULARY)
    got = {r.doc_id: r for r in lattice.score(table, model).collect()}
    assert got[1].n_known == 0 and got[1].base_score == 0 and got[1].score < 0 and got[2].score == 0
    assert lattice.score(table.where("false"), lattice.fit(table, VOCABULARY)).count() == 0


def test_class_models_are_distributions():
    codes = [b"ab ", b"abc", b"bad", b"good"]
    data = np.frombuffer(b"".join(codes).replace(b" ", b"x"), np.uint8)
    ends = np.cumsum([3, 3, 3, 4])
    runs, word = toxicity.runs_of(data, ends - [3, 3, 3, 4], ends, 3)
    assert list(word) == [0] * 4 + [1] * 4 + [2] * 4 + [3] * 5
    assert [int(x).to_bytes(3, "big") for x in runs[:4]] == [b"  a", b" ab", b"abx", b"bx "]
    kinds, n = np.unique(runs, return_counts=True)
    level = toxicity.Level.of(kinds, [n, n[::-1].copy(), n + n[::-1]])
    flat = np.full(256, 1 / 256)
    for context in np.unique(kinds >> np.uint64(8)):
        all_next = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        shared = level.probability(2, all_next, flat)
        assert shared.sum() == pytest.approx(1)
        assert level.apart(0, all_next, shared).sum() == pytest.approx(1)


def labelled(rows, n=300):
    bad = ["grumblefuss", "snarkwit", "dolthead"]
    docs = []
    for k in range(n):
        w = text_of(k, 30 + k % 40).split()
        if k % 5 == 0:
            w[k % 20] = bad[k // 5 % 3]
            w[10 + k % 15] = bad[k // 10 % 3]
        docs.append((k, " ".join(w), int(k % 5 == 0)))
    return docs


def test_toxicity_finds_held_out_rows(rows):
    docs = labelled(rows)
    table = rows("doc_id long, text string, y int, share double", *((k, t, 0, 0.5) for k, t, _ in docs), (900, None, 0, 0.0), (901, "", 0, 0.0), (901, "...", 0, 0.0), (902, "word " * 40000, 0, 0.0))
    labels = rows("doc_id long, toxic int", *((k, y) for k, _, y in docs if k % 3), (1, None), (None, 1))
    got = toxicity.score(table, toxicity.fit(table, labels)).collect()
    assert len(got) == len(docs) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = {r.doc_id: r.predicted for r in got if r.doc_id < 900 and r.doc_id % 3 == 0}
    assert np.mean([held[k] == y for k, _, y in docs if k % 3 == 0]) > 0.95
    assert len({r.score for r in got if r.doc_id == 901}) == 1


def test_toxicity_level_does_not_depend_on_the_sample(rows):
    # a label that the text tells nothing of, on one row in eleven: the scores are its rate
    docs = [(k, text_of(k % 500, 12)) for k in range(6600)]
    table = rows("doc_id long, text string", *docs)
    labels = rows("doc_id long, toxic int", *((k, int(k % 11 == 0)) for k, _ in docs))
    for max_rows in (6600, 500):
        got = [r.score for r in toxicity.score(table, toxicity.fit(table, labels, max_rows=max_rows)).select("score").collect()]
        assert 0.06 < np.mean(got) < 0.14


def test_scaled_counts_are_a_distribution():
    kinds, toxic, ordinary = np.arange(97, 105, dtype=np.uint64), np.array([3, 0, 1, 2, 0, 1, 4, 9]), np.array([0, 2, 1, 5, 1, 0, 3, 9])
    plain = toxicity.Level.of(kinds, [toxic, ordinary, toxic + ordinary])
    codes, flat = np.arange(256, dtype=np.uint64), np.full(256, 1 / 256)
    scaled = toxicity.Level.of(kinds, [toxic, ordinary, toxic + ordinary], (toxic + 8.0 * ordinary) / (toxic + ordinary))
    p, q = plain.probability(2, codes, flat), scaled.probability(2, codes, flat)
    assert q.sum() == pytest.approx(1) and q[97] < p[97] and q[98] > p[98]
    even = toxicity.Level.of(kinds, [toxic, ordinary, toxic + ordinary], np.full(8, 8.0))
    assert even.probability(2, codes, flat) == pytest.approx(p)


def test_toxicity_without_both_classes_or_rows(rows):
    table = rows("doc_id long, text string", (1, "a b"), (2, None))
    for labels, want in (([], 0.5), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.fit(table, rows("doc_id long, toxic int", *labels))
        assert [r.score for r in toxicity.score(table, model).collect()] == pytest.approx([want] * 2, abs=1e-3)
    assert toxicity.score(table.where("false"), toxicity.fit(table, rows("doc_id long, toxic int"))).count() == 0


def noisy(k):
    w = text_of(k, 30 + k % 50).split()
    if k % 6 == 0:
        w = [x + "%%$#"[k % 3 :] for x in w]
    elif k % 6 == 3:
        w = [x.upper() + "!!" for x in w]
    return " ".join(w[:15]) + ".\n" + " ".join(w[15:]) + ".", int(k % 3 != 0)


def test_quality_ranks_held_out_rows(rows):
    docs = [(k, *noisy(k)) for k in range(240)]
    table = rows("doc_id long, text string, x int, id int, good boolean", *((k, t, 0, 0, True) for k, t, _ in docs), (900, None, 0, 0, True), (900, None, 0, 0, True), (901, "", 0, 0, True), (902, "word " * 40000, 0, 0, True))
    labels = rows("doc_id long, quality int", *((k, y) for k, _, y in docs if k % 4), (1, None), (None, 1))
    features = quality.feature_table(table)
    model = quality.fit(features, labels)
    got = quality.score(features, model).collect()
    assert len(got) == len(docs) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = {r.doc_id: r.predicted for r in got}
    assert np.mean([held[k] == y for k, _, y in docs if k % 4 == 0]) > 0.95
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in got if r.predicted)


def test_quality_without_both_classes_or_rows(rows):
    table = rows("doc_id long, text string", (1, "a b"), (2, None))
    features = quality.feature_table(table)
    for labels, want in (([], 0.5), ([(1, 0)], 0), ([(1, 1)], 1)):
        got = quality.score(features, quality.fit(features, rows("doc_id long, quality int", *labels))).collect()
        assert [round(r.score, 1) for r in got] == [want] * 2
    empty = quality.feature_table(table.where("false"))
    assert quality.score(empty, quality.fit(empty, rows("doc_id long, quality int", (1, 1)))).count() == 0
