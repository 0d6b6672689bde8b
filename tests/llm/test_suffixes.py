import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from llm_text import text_of

from tabspark.llm import suffixes

SCHEMA = "doc_id long, text string, run long, part string"


def plain(texts, width):
    """(n_bytes, n_removed, n_spans, digest, kept) of each text, by a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(rows, texts, width, **options):
    table = rows(SCHEMA, *((k, t, 1, "x") for k, t in enumerate(texts)))
    got = sorted(suffixes.remove(table, width=width, with_text=True, **options).collect())
    want = plain(texts, width)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got] == want
    return want


def shared_passages(seed):
    """Texts with passages of others in them, of many lengths about the width, some in several texts and some twice in one."""
    rng = random.Random(seed)
    passages = [text_of(500 + k, rng.randint(3, 70)) for k in range(12)]
    texts = []
    for k in range(60):
        parts = [text_of(seed * 1000 + k, rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : len(p) - rng.randint(0, len(p) // 3)], text_of(rng.randint(10000, 20000), rng.randint(0, 4))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("seed,width,run_bytes", [(1, 40, 1 << 20), (2, 200, 3000), (3, 17, 500)])
def test_equals_brute_force(rows, seed, width, run_bytes):
    want = check(rows, shared_passages(seed), width, run_bytes=run_bytes)
    assert sum(w[1] for w in want) > 0 and any(w[2] > 1 for w in want)


def test_repetitive_and_colliding_texts(rows):
    thue = "ab"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    check(rows, ["a" * 500, "b" * 199, "ab" * 150, thue, other, "é" * 120, "x" + "é" * 100, "c" * 200, "d" * 201], 200, run_bytes=700)
    check(rows, ["a" * 64, "xyz" * 30, "b" * 17], 16)


def test_copies_nulls_and_empty_texts(rows):
    one, two = text_of(1, 80), text_of(2, 80)
    texts = [one] * 30 + [None, "", two, two[:150], one + two, "short", None]
    want = check(rows, texts, 200, run_bytes=2000)
    assert want[0][1] == len(one) and want[30][:3] == (0, 0, 0) and want[33][1] == 0
    assert suffixes.remove(rows(SCHEMA)).collect() == []
    assert suffixes.remove(rows(SCHEMA, (None, None, 1, "x"), (None, one, 1, "x"), (None, one, 1, "x"))).where("n_removed > 0").count() == 2
    with pytest.raises(ValueError):
        suffixes.remove(rows(SCHEMA), width=8)


def test_segments_of_a_long_text(rows, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 100)  # cut anew in the driver only; cells of either cut meet in the finer levels
    text = suffixes.Text("", b"")
    assert len(text.anchors(200)) == 0
    check(rows, shared_passages(4), 50)


def test_strings_are_sorted_in_slices(rows, monkeypatch):
    """more strings than a slice holds are sorted slice by slice, with the same result."""
    made, slices = [], suffixes.Steps.slices
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 1000)
    monkeypatch.setattr(suffixes.Steps, "slices", lambda self, size: made.append((slices(self, size), size, self.bytes)) or made[-1][0])
    texts = shared_passages(5)
    check(rows, texts, 60, run_bytes=4000)
    assert len(made) == 3 and max(n for n, _, _ in made) > 1
    assert all(size <= n * max(whole // 2, 1000) and whole == sum(len(t.encode()) for t in texts) for n, size, whole in made)


def test_shuffle_files_go_with_their_step(rows, spark):
    """they stayed until the driver's next garbage collection, those of all levels at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"/shuffle_(\d+)_", disk.getAllFiles().mkString("\n")))
    table = rows(SCHEMA, *((k, t, 1, "x") for k, t in enumerate(shared_passages(6))))
    old = shuffles()
    assert suffixes.remove(table, width=60, run_bytes=4000).count() == 60
    end = time.monotonic() + 30
    while len(shuffles() - old) > 1 and time.monotonic() < end:
        time.sleep(0.2)
    assert len(shuffles() - old) <= 1  # that of the count
    assert spark.conf.get(name, None) == before


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 8])
def test_loser_tree_merges_and_knows_prefixes(runs):
    rng = random.Random(runs)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() * rng.randint(1, 9) for _ in range(300)]
    parts = [sorted(set(words[k::runs])) for k in range(runs)] + [[]]
    coded = []
    for p in parts:
        text, ends = suffixes.Text("", b""), np.cumsum([len(w) for w in p], dtype=np.int64)
        text.raw = b"".join(p)
        coded.append(suffixes.decoded(*suffixes.front_coded(text, np.concatenate(([0], ends))[: len(p)], ends)))
    assert [c[1] for c in coded] == parts
    got, last = [], b""
    for run, place, known in suffixes.merged(coded):
        now = parts[run][place]
        assert known == suffixes.common_prefix(last, now, 0)
        got.append(now)
        last = now
    assert got == sorted(w for p in parts for w in p)
