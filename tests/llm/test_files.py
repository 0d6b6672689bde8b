import glob
import os

import public_tokenizers
import pytest
from llm_text import text_of
from test_models import noisy

from tabspark.llm import bloom, decontaminate, exact_dedup, near_dedup, packing, quality, suffixes
from tabspark.llm.files import file_rows, fresh, numbered, saved, scratch

CLASHES = "_row_number long, row_number long, bloom_hash long, bloom_maybe string, `a.b` int, number int, kept boolean, id string, component_id int, gone_key int"


def folders(spark):
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {f for f in glob.glob(f"{base}/*") if os.path.isdir(f)}


def clashing(rows, texts):
    more = (1, 2, 3, "four", 5, 6, True, "eight", 9, 10)
    return rows(f"doc_id long, text string, {CLASHES}", *((k, t, *more) for k, t in enumerate(texts)))


def stages(rows):
    labelled = [noisy(k) for k in range(120)]
    labels = rows("doc_id long, quality int", *((k, y) for k, (_, y) in enumerate(labelled)))
    long = [text_of(k, 60) for k in range(4)]
    items = rows("item_id long, text string", (1, " ".join(long[0].split()[5:25])))
    return {
        "quality": ([t for t, _ in labelled], lambda d: quality.keep_good(d, labels), sum(y for _, y in labelled)),
        "copies": (long + long[:2], exact_dedup.drop_copies, 4),
        "near": ([*long, long[1] + " more", ""], near_dedup.drop_near_copies, 5),
        "benchmark": ([*long, None], lambda d: decontaminate.drop_contaminated(d, items), 4),
    }


@pytest.mark.parametrize("stage", ["quality", "copies", "near", "benchmark"])
def test_stages_hand_on_columns_that_have_the_names_of_their_own(spark, rows, tmp_path, stage):
    texts, run, kept = stages(rows)[stage]
    docs = clashing(rows, texts)
    docs.write.parquet(f"{tmp_path}/docs")
    for source in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        before = folders(spark)
        out = run(source)
        assert out.columns == source.columns
        got = out.collect()
        given = {r.doc_id: tuple(r) for r in source.collect()}
        assert len(got) == kept and all(tuple(r) == given[r.doc_id] for r in got)
        left = {os.path.basename(f).rsplit("-", 1)[0] for f in folders(spark) - before}
        assert left <= {"numbered", "rejected", "dropped-copies", "dropped-near-copies", "contaminated", "bloom-members"}  # what the lazy result reads


def test_rows_of_files_are_numbered_without_a_copy(spark, rows, tmp_path):
    rows("x long", *((k,) for k in range(50))).repartition(7).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    before = folders(spark)
    one, name = numbered(table)
    again = numbered(spark.read.parquet(f"{tmp_path}/t").repartition(3))[0]
    assert folders(spark) - before != set() and len(folders(spark) - before) == 1  # the shuffled one is written
    assert one.select(name).distinct().count() == 50 == again.count()
    first = dict(one.select("x", name).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert dict(one.select("x", name).collect()) == first  # however the files are split
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    twice = spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t")
    assert twice.count() == 100 and file_rows(twice) is None and numbered(twice)[0].select("row_number").distinct().count() == 100
    assert file_rows(table.where("x > 3")) is None and file_rows(rows("x long", (1,))) is None
    assert numbered(rows("Row_Number long", (5,)))[1] == "row_number_" and fresh(["A", "a_"], "a") == "a__"


def test_scratch_deletes_what_does_not_outlive_it(spark, rows):
    before = folders(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        saved(rows("x long", (1,)), "lost")
        raise RuntimeError
    assert folders(spark) == before
    with scratch(spark):
        with scratch(spark):
            inner = saved(rows("x long", (1,)), "gone")
            kept = saved(inner, "kept", outlives=True)
        assert kept.count() == 1 and len(folders(spark) - before) == 1
    assert folders(spark) == before


def test_operators_leave_only_their_result(spark, rows):
    docs = rows("doc_id long, text string", *((k, text_of(k % 9, 50)) for k in range(12)))
    for run, left in ((near_dedup.cluster, {"clusters"}), (suffixes.remove, {"deduplicated"})):
        before = folders(spark)
        assert run(docs).count() == 12
        assert {os.path.basename(f).rsplit("-", 1)[0] for f in folders(spark) - before} == left


def test_filters_keep_their_rate_with_many_more_keys_than_bits(rows, spark, monkeypatch):
    """Far more keys than a part may hold: more parts, the same share of rows passed on."""
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 14)
    keys = spark.range(40_000).selectExpr("id", "id * 7919 AS other")
    h = bloom.F.xxhash64("id")
    once = bloom.repeated(keys, h, 40_000)
    assert once.parts == 40 and once.bits == 1 << 14
    passed = bloom.tested(keys, once, h, "maybe").where("maybe").count()
    assert passed < 0.05 * 40_000
    twice = bloom.tested(keys.unionAll(keys), bloom.repeated(keys.unionAll(keys), h, 80_000), h, "maybe")
    assert twice.where("maybe").count() == 80_000  # no repeated key is missed
    some = saved(keys.where("id % 10 = 0"), "some")
    maybe, rest = bloom.split(keys, some.select("id"), "id")
    assert maybe.where("id % 10 = 0").count() == 4000 and maybe.count() < 4000 + 0.05 * 36_000 and rest.columns == keys.columns
    assert bloom.anti_join(keys, some.select("id"), "id").count() == 36_000


@pytest.mark.parametrize("key", ["length", "sequence_id", "offset", "ids", "key"])
def test_packing_with_a_key_named_like_an_output_column(rows, key):
    out = packing.pack(rows(f"`{key}` long, text string, piece int", (5, "a b c", 1), (6, None, 1)), public_tokenizers.path("word_bpe_49k.json"), key=key)
    assert sorted(r[key] for r in out.collect()) == [5, 6]
    assert len(set(out.columns)) == 8 and (key == "key" or f"{key}_" in out.columns)


@pytest.mark.parametrize("parts", [1, 20, 120])
def test_sequences_do_not_depend_on_partitions(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    out = saved(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False), "test-pack")
    tokens, used = out.agg({"length": "sum"}).first()[0], out.select("sequence_id").distinct().count()
    assert used <= 1.01 * -(-tokens // 2048) + 1
    rows = out.groupBy("sequence_id").agg(bloom.F.sum("length").alias("n"), bloom.F.max(bloom.F.col("offset") + bloom.F.col("length")).alias("upto"))
    assert rows.where("n != upto OR n > 2048").count() == 0


def test_workers_drop_what_another_operator_kept_and_learn_in_small_parts(spark, monkeypatch):
    import os

    import public_tokenizers
    import pyarrow as pa

    from tabspark.llm import encode, worker
    from tabspark.llm.words import blocks

    path = public_tokenizers.path("word_bpe_49k.json")

    def fill(batches):
        encode.encoder(path, False)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()])], ["pid"])

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(worker._kept)])], ["pid", "kept"])

    one = spark.range(1).coalesce(1)
    first = one.mapInArrow(worker.lean(fill, "encoder"), "pid long").first()["pid"]
    again = one.mapInArrow(worker.lean(look, "encoder"), "pid long, kept long").first()
    other = one.mapInArrow(worker.lean(look), "pid long, kept long").first()
    assert again["kept"] == 1 or again["pid"] != first
    assert other["kept"] == 0

    sizes = []
    learn = encode.PieceEncoder.learn
    monkeypatch.setattr(encode.PieceEncoder, "learn", lambda self, h, pieces: (sizes.append(len(pieces)), learn(self, h, pieces)))
    own = encode.PieceEncoder(path, False)
    text = " ".join(f"w{k}" for k in range(3 * encode.LEARNT))
    ids = [r.tolist() for b in blocks(pa.array([text])) for r in own.rows(b)]
    assert ids == [own.tokenizer.encode(text, add_special_tokens=False).ids]
    assert len(sizes) >= 3 and max(sizes) <= encode.LEARNT
