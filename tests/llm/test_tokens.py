import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabspark.llm import mph, packing, tokenfile
from tabspark.llm.encode import PieceEncoder
from tabspark.llm.words import U64, blocks

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
PARTS = ["a", "b", "Z", "é", "ß", " ", "  ", "\n", "\t", "—", "'s", "'t", "'", ",", ".", "!!", "%%%", "1", "23", "<|endoftext|>", "\x0b", "\x1c", "\x85", "́", "=", "̸", "İ", "Σ", "😀", "\x00", "中文", "　", " ", " "]


def whole(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaces"), KINDS)
def test_pieces_give_the_ids_of_whole_texts(name, spaces):
    own = PieceEncoder(public_tokenizers.path(name), spaces)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=8))
    def check(texts):
        got = [r.tolist() for b in blocks(pa.array(texts, pa.string())) for r in own.rows(b)]
        assert got == whole(name, texts)

    check()


def test_table_of_pieces_starts_anew_when_full():
    texts = [f"word{k} other{k * 7}" for k in range(400)]
    own = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True, slots=64, pool=100)
    got = [r.tolist() for part in (texts[:3], texts[3:]) for b in blocks(pa.array(part), 200) for r in own.rows(b)]
    assert got == whole("byte_bpe_50k.json", texts)


@given(st.integers(0, 3000), st.integers(0, 9))
@settings(max_examples=20, deadline=None)
def test_index_is_minimal_and_refuses_strangers(n, seed):
    rng = np.random.default_rng(seed)
    h, g = (rng.integers(0, 1 << 63, n).astype(U64) for _ in "hg")
    index = mph.Bucket(mph.build(h, g, np.arange(n), np.arange(n) * 10, np.arange(n) + 1))
    assert len(index.entries) == n
    found, entries = index.find(h, g)
    assert found.all() and (entries["offset"] == np.arange(n) * 10).all()
    assert not index.find(h + U64(1), g ^ U64(12345))[0].any()


def test_token_files_round_trip(spark, rows):
    texts = {5: "hello world", 1: None, 3: "", 9: "x" * 5000, -2: "a b  c\n"}
    docs = rows("doc_id long, text string, start long, shard int", *((k, t, 0, 0) for k, t in texts.items()), (5, "second", 0, 0), (None, "no key", 0, 0))
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tokenfile.write(docs, path, shard_bytes=1000)
    keys = [(k, 0) for k in texts] + [(5, 1), (77, 0)]
    found = tokenfile.read(files, tokenfile.lookup(files, rows("doc_id long, ordinal long", *keys), "doc_id", "ordinal")).collect()
    got = {(r.key, r.ordinal): (r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in found}
    assert set(got) == set(keys) - {(77, 0)}
    for k, t in texts.items():
        if k != 5:
            assert got[k, 0][1] == whole("byte_bpe_50k.json", [t or ""])[0] + [0]
            assert tokenfile.get(spark, files, k).tolist() == got[k, 0][1]
    assert sorted([got[5, 0][1], got[5, 1][1]]) == sorted(x + [0] for x in whole("byte_bpe_50k.json", ["hello world", "second"]))
    assert tokenfile.get(spark, files, 77) is None
    at = len(whole("byte_bpe_50k.json", ["no key"])[0]) + 1  # the row without a key lies first
    for k in sorted(got):
        assert got[k][0] == at
        at += len(got[k][1])


def test_token_files_of_nothing_and_text_keys(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    empty = tokenfile.write(rows("doc_id long, text string"), path)
    assert tokenfile.read(empty, tokenfile.lookup(empty, rows("doc_id long", (1,)))).count() == 0
    assert tokenfile.get(spark, empty, 1) is None
    named = tokenfile.write(rows("doc_id string, text string", ("é", "one"), ("b", "two three")), path)
    assert tokenfile.get(spark, named, "é").tolist() == whole("byte_bpe_50k.json", ["one"])[0] + [0]


@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_bins_are_gapless_bounded_and_best_fit(lengths, limit):
    bins, fill, open_ = packing.Bins(50, limit), {}, {}
    for n in lengths:
        fits = {b: f for b, f in open_.items() if f >= n}
        number, offset = bins.place(n)
        assert offset == fill.get(number, 0)
        if fits:
            assert open_[number] == min(fits.values())  # the least space that suffices
        else:
            assert offset == 0
            if len(open_) >= limit and n < 50:
                open_.pop(min(open_, key=lambda b: (open_[b], b)) if list(open_.values()).count(min(open_.values())) == 1 else next(b for b in open_ if open_[b] == min(open_.values()) and b not in {x for own in bins.by_free for x in own}))
        fill[number] = offset + n
        assert fill[number] <= 50
        open_.pop(number, None)
        if fill[number] < 50:
            open_[number] = 50 - fill[number]
        assert len(open_) <= limit and bins.open == len(open_)


def test_packing_against_whole_texts(rows):
    texts = {1: None, 2: "", 3: "Hello, World! " * 900, 4: "a b c", 5: "a b c"}
    docs = rows("doc_id long, text string, length int, ids string", *((k, t, 1, "x") for k, t in texts.items()), (5, "a b c", 1, "x"))
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=512)
    from tabspark.llm.files import saved

    out = saved(out, "test-pack")
    got = out.collect()
    for k, t in texts.items():
        ids = whole("word_bpe_49k.json", [t or ""])[0] + [0]
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: (r.piece, r.sequence_id, r.offset))
        if k == 5:
            assert len(own) == 2  # the repeated row is packed twice
            own = own[:1]
        assert [i for r in own for i in r.ids] == ids
        assert [(r.piece, r.start, r.length) for r in own] == [(i, s, min(512, len(ids) - s)) for i, s in enumerate(range(0, len(ids), 512))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    whole_rows = packing.sequences(out).collect()
    assert sum(r.n_tokens for r in whole_rows) == sum(r.length for r in got)
    assert all(len(r.ids) == r.n_tokens <= 512 for r in whole_rows)
    assert packing.pack(rows("doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def thue_morse(n=2048):
    """Two words over a and b that polynomial hashes modulo 2**64 confuse, whatever the base."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse():
    from tabspark.llm.words import hash_spans

    one, two = (np.frombuffer(w.encode(), np.uint8) for w in thue_morse())
    for n in (1024, 2048):
        assert hash_spans(one, np.array([0]), np.array([n])) != hash_spans(two, np.array([0]), np.array([n]))
    for name, spaces in KINDS:
        own, texts = PieceEncoder(public_tokenizers.path(name), spaces), [*thue_morse(), "x " + thue_morse()[1]]
        assert [r.tolist() for b in blocks(pa.array(texts)) for r in own.rows(b)] == whole(name, texts)


@pytest.mark.parametrize(("name", "spaces"), KINDS)
def test_pieces_with_equal_hashes_keep_their_own_ids(name, spaces, monkeypatch):
    import tabspark.llm.encode as encode

    monkeypatch.setattr(encode, "hash_spans", lambda data, starts, ends: (ends - starts).astype(U64) % U64(3))
    texts = ["one two six ten", "two one", "a b c d " + "x" * 100 + " " + "y" * 100, "y" * 100, "", "x" * 99 + "z"]
    own = PieceEncoder(public_tokenizers.path(name), spaces)
    assert [r.tolist() for b in blocks(pa.array(texts), 30) for r in own.rows(b)] == whole(name, texts)


def test_spans_hash_alike_only_if_alike():
    from tabspark.llm.words import hash_spans

    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 4000)
    ends = starts + rng.integers(0, 200, 4000)
    of = {}
    for h, s, e in zip(hash_spans(data, starts, ends).tolist(), starts, ends):
        assert of.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    assert len(of) == len({data[s:e].tobytes() for s, e in zip(starts, ends)})
