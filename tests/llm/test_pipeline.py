import re

import public_tokenizers
from llm_text import text_of
from test_decontaminate import plain
from test_dedup import plain_near, plain_verdicts
from test_models import noisy

import corpus_pipeline
from tabspark.llm.files import saved


def test_stages_against_plain_versions(spark, rows, tmp_path):
    good = [(k, text_of(k, 40 + k)) for k in range(1, 90)]
    docs = [(k, t.capitalize() + ".") for k, t in good] + [(1000 + k, noisy(6 * k)[0]) for k in range(40)]
    docs += [(200 + k, docs[k][1].replace(" ", "  ", 1 + k)) for k in range(20)]  # equal but for white space
    docs += [(300 + k, docs[30 + k][1] + " more") for k in range(20)]  # near copies
    items = [(k, " ".join(text_of(60 + k, 100 + k).split()[5:25])) for k in range(5)]
    table = rows("doc_id long, text string, lang string, source string, n_chars long", *((k, t, "en", "s", len(t)) for k, t in docs))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows("item_id long, text string", *items).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows("doc_id long, quality int, toxic int", *((k, int(k < 1000), 0) for k, _ in docs)).write.parquet(f"{tmp_path}/labels.parquet")

    now, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(docs)
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(r.doc_id for r in now.select("doc_id").collect())
        after = saved(stage(spark, now, str(tmp_path)), "test-stage")
        ids = sorted(r.doc_id for r in after.select("doc_id").distinct().collect())
        given = [(k, texts[k]) for k in before]
        if name == "quality classifier":
            assert ids == [k for k in before if k < 1000]
        elif name == "exact dedup":
            assert ids == [k for k, _, _, keep, _ in plain_verdicts(given) if keep] and len(ids) < len(before)
        elif name == "MinHash near-dedup":
            assert ids == [k for k, (_, c) in sorted(plain_near(given, 5, 80).items()) if k == c] and len(ids) < len(before)
        elif name == "benchmark decontamination":
            assert ids == [k for k, v in sorted(plain(given, items).items()) if not v[4]] and len(ids) < len(before)
        else:
            assert ids == before
        if name != "best-fit packing":
            assert after.columns == table.columns
            assert sorted(map(tuple, after.collect())) == sorted((k, texts[k], "en", "s", len(texts[k])) for k in ids)
        now = after
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, tuple(r.ids)) for r in done) == sorted((r.doc_id, r.piece, tuple(r.ids)) for r in now.collect())


def test_rows_without_an_id_or_with_a_shared_one_are_judged_one_by_one(rows):
    from tabspark.llm import decontaminate, exact_dedup, near_dedup, quality

    def kept(stage, *docs):
        out = stage(rows("doc_id long, text string, n long", *((k, t, n) for n, (k, t) in enumerate(docs))))
        assert out.columns == ["doc_id", "text", "n"]
        return sorted(r.n for r in out.collect())

    long, other, third = text_of(1, 60), text_of(2, 60), text_of(3, 60)
    items = rows("item_id long, text string", (1, " ".join(long.split()[5:25])))
    assert kept(lambda d: decontaminate.drop_contaminated(d, items), (7, long), (7, other), (None, long), (None, third), (8, other)) == [1, 3, 4]
    # the longest original, then the smallest id, NULL first; 7 stays with its other text
    assert kept(exact_dedup.drop_copies, (7, long), (3, long), (7, other), (None, third), (None, " " + third), (9, third), (9, third), (None, None), (5, "")) == [1, 2, 4, 7]
    assert kept(near_dedup.drop_near_copies, (7, long + " more"), (3, long), (7, other), (None, third + " end"), (9, third), (9, third + " end"), (9, ""), (9, "")) == [1, 2, 3, 6, 7]
    learn = [(1000 + k, noisy(k)) for k in range(120)]
    labels = rows("doc_id long, quality int", *((k, y) for k, (_, y) in learn))
    good, bad = noisy(1)[0], noisy(6)[0]
    docs = [(k, t) for k, (t, _) in learn] + [(7, good), (7, bad), (None, bad), (None, good)]
    assert [n - 120 for n in kept(lambda d: quality.keep_good(d, labels), *docs) if n >= 120] == [0, 3]


def test_names_of_the_thirteen_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1 for n in range(1, 14)) and "pipeline" in names
    assert public_tokenizers.path("word_bpe_49k.json")
