import hashlib
import re

import pytest
from llm_text import text_of

from tabspark.llm import bloom, exact_dedup, near_dedup


def plain_verdicts(docs):
    groups = {}
    for k, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), k))
    out = []
    for k, t in docs:
        normal = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[normal])[1]
        out.append((k, keep, len(groups[normal]), keep == k, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup_against_plain(rows):
    docs = [(k, t) for k, t in enumerate([None, "", " \n", "a b", "ab", "a  b", "a b ", "é\x0b", "é", "é\xa0", "A b", "unique", "x" * 30000, "x" * 30000])]
    docs += [(100 + k, "hot text") for k in range(300)]
    table = rows("doc_id long, text string, chars int, sha string", *((k, t, 1, "q") for k, t in docs))
    assert sorted(tuple(r) for r in exact_dedup.verdicts(table).collect()) == plain_verdicts(docs)
    kept = exact_dedup.drop_copies(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _, _, keep, _ in plain_verdicts(docs) if keep)


def test_exact_dedup_of_repeated_rows_nulls_and_nothing(rows):
    table = rows("doc_id long, text string", (1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, "c"), (None, None))
    got = sorted((tuple(r) for r in exact_dedup.verdicts(table).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (1, 1, 2, True), (1, 1, 1, True), (None, None, 2, True), (2, None, 2, False), (None, None, 1, True)], key=str)
    kept = [tuple(r) for r in exact_dedup.drop_copies(table).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (1, "b"), (None, "c"), (None, None)], key=str)
    assert exact_dedup.drop_copies(rows("doc_id long, text string")).count() == 0


def test_exact_dedup_is_native(rows):
    plan = exact_dedup.verdicts(rows("doc_id long, text string", (1, "a"), (2, "a")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_bloom_never_misses(spark):
    from pyspark.sql import functions as F

    from tabspark.llm.files import saved

    table = spark.range(5000).select(F.pmod("id", F.lit(4000)).alias("k"))
    twice = bloom.tested(table, bloom.repeated(table, F.xxhash64("k"), 5000), F.xxhash64("k"), "maybe")
    assert twice.where("k < 1000 AND NOT maybe").count() == 0
    assert twice.where("k >= 1000 AND maybe").count() < 500
    keys = saved(spark.range(0, 4000, 7).select(F.col("id").alias("k")), "test-keys")
    assert bloom.anti_join(table.distinct(), keys, "k").count() == 4000 - keys.count()


def plain_near(docs, width, percent):
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {k: k for k in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("block", [2, 500])
def test_near_dedup_against_plain(rows, block):
    docs, k = [], 0
    for seed in range(12):
        base = text_of(seed, 30 + 25 * seed).split()
        for copy in range(14):
            words = list(base)
            for j in range(copy % 7):
                words[(copy * 13 + j * 17) % len(words)] = f"new{copy}x{j}"
            docs.append((k, " ".join(words)))
            k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, " \n "), (k + 3, "one two"), (k + 4, "ONE\ttwo"), (k + 5, "one two three"), (k + 6, "one"), (k + 7, "long " * 20000)]
    table = rows("doc_id long, text string, n int, bucket string", *((a, b, 1, "z") for a, b in docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.cluster(table, width=4, block=block).collect()}
    assert got == plain_near(docs, 4, 80)
    kept = near_dedup.drop_near_copies(table, width=4)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(a for a, (_, c) in got.items() if a == c)


def test_near_dedup_of_repeated_rows_nulls_and_nothing(rows):
    text = text_of(3, 50)
    got = near_dedup.cluster(rows("doc_id long, text string", (4, text), (4, text), (2, text + " more"), (None, "x y z"), (7, None))).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(4, 2, False), (4, 2, False), (2, 2, True), (None, None, True), (7, 7, True)], key=str)
    assert near_dedup.cluster(rows("doc_id long, text string")).count() == 0
