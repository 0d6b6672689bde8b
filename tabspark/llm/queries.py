"""Registered queries of the training-data operators: one thin query an operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tabspark.llm import chat, decontaminate, exact_dedup, lattice, mining, near_dedup, packing, quality, suffixes, tokenfile, toxicity, warc, whiten
from tabspark.session import read_table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_token_files")
def op1_token_files(spark, sf_dir):
    """Every document's ids written to shard files in doc_id order, then found through the hash index and read back."""
    docs = read_table(spark, sf_dir, "documents")
    files = tokenfile.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    copies = docs.groupBy("doc_id").count().select("doc_id", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("ordinal"))
    rows = tokenfile.read(files, tokenfile.lookup(files, copies, "doc_id", "ordinal"))
    return rows.select(F.col("key").alias("doc_id"), "start", F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@register("op2_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
g AS (SELECT sha, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY sha)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM d JOIN g USING (sha)""")
def op2_exact_dedup(spark, sf_dir):
    """Each document's group of equal texts and whether it stays."""
    return exact_dedup.verdicts(read_table(spark, sf_dir, "documents"))


@register("op3_warc_archives")
def op3_warc_archives(spark, sf_dir):
    """Every page written to dictionary-compressed archives; the rows are what reading the archives gives."""
    archives = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHAT_ESCAPED = "replace(coalesce({0}, ''), '%', '%25')"
for _mark in chat.CONTROL:
    CHAT_ESCAPED = f"replace({CHAT_ESCAPED}, '{_mark}', '{chat.CODES[_mark[0]]}{_mark[1:]}')"


@register("op4_chat_format", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             sum(length('<|im_start|>' || replace({CHAT_ESCAPED.format("role")}, chr(10), '%0A') || chr(10)
                 || {CHAT_ESCAPED.format("text")} || '<|im_end|>' || chr(10))) OVER w AS upto
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op4_chat_format(spark, sf_dir):
    """Every conversation, and one that says control strings, formatted, written and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.write(rows.unionByName(extra)))


@register("op8_minhash_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
few AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT doc_id, n, g FROM e JOIN few USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id WHERE r.c < p.b),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN c ON c.id = doc_id""")
def op8_minhash_near_dedup(spark, sf_dir):
    """Components of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    docs = read_table(spark, sf_dir, "documents")
    return near_dedup.cluster(docs, width=4).select("doc_id", "n_shingles", "component_id", "kept")


@register("op10_decontaminate", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(ws)) AS n, unnest([array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(10, len(ws)) + 2)]) AS w
        FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, n, unnest([{'i': i, 'w': array_to_string(ws[i:i + n - 1], ' ')} FOR i IN range(1, len(ws) - n + 2)], recursive := true) FROM d, sizes WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, occ.n, item FROM occ JOIN win ON occ.w = win.w AND occ.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op10_decontaminate(spark, sf_dir):
    """Words of each document inside an occurrence of a benchmark window of 10 words."""
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def fold(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@register("op7_kneser_ney_toxicity")
def op7_kneser_ney_toxicity(spark, sf_dir):
    """Every document's toxicity, learnt from the labels outside fold 0 of 5."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "toxic")
    rows = toxicity.score(docs, toxicity.fit(docs, labels))
    return rows.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@register("op9_bradley_terry_quality")
def op9_bradley_terry_quality(spark, sf_dir):
    """Every document's quality, learnt from preference pairs of the labels outside fold 1 of 3."""
    table = quality.feature_table(read_table(spark, sf_dir, "documents"))
    labels = read_table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", "quality")
    rows = quality.score(table, quality.fit(table, labels))
    return rows.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


@register("op6_lattice_likelihood")
def op6_lattice_likelihood(spark, sf_dir):
    """Every document's probability under the subword lattice, learnt from the documents outside fold 2 of 7."""
    docs = read_table(spark, sf_dir, "documents")
    model = lattice.fit(docs.where(fold(7) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    rows = lattice.score(docs, model)
    return rows.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op11_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5""")
def op11_hard_negatives(spark, sf_dir):
    """Negatives of every anchor that score from 80 to 100 percent of each of its positives; every seventh label is moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine(read_table(spark, sf_dir, "embeddings"), label=moved)


@register("op13_spectrum_whitening")
def op13_spectrum_whitening(spark, sf_dir):
    """Every vector on the leading eight components of the covariance, each scaled to unit variance."""
    return whiten.whiten(read_table(spark, sf_dir, "embeddings"))


@register("op12_suffix_array_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
k AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 200 AS hi FROM k GROUP BY doc_id, span),
t AS (SELECT doc_id, hi AS from_byte, lead(lo, 1, CAST(1000000000 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY lo) AS to_byte FROM s
      UNION ALL SELECT doc_id, 0, coalesce(min(lo), 1000000000) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
o AS (SELECT doc_id, string_agg(substr(h, 2 * from_byte + 1, 2 * (to_byte - from_byte)), '' ORDER BY from_byte) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op12_suffix_array_dedup(spark, sf_dir):
    """Every document without the bytes of its 200-byte strings that also start elsewhere."""
    return suffixes.remove(read_table(spark, sf_dir, "documents"))
