"""Exact deduplication by two-pass Bloom filtering (operator 2), with DataFrame functions only.

Texts are equal when identical after white space (``[\\x20\\x09-\\x0D]``) is deleted.  The text is read
once, into a narrow table of digests.  Pass one counts which filter cells two rows hit; pass two tests
each row.  Rows that test negative are the only ones of their text and pass straight through; the
others shuffle by digest, where per-digest aggregates (combined before the shuffle, so a text that fills
a third of the rows is one row a task) name the row that stays: most code points in the original text, then
smallest id.  The join back is skew-split by adaptive execution.

Defined cases: a NULL text is empty, and all empty texts are one group; a NULL id counts as smallest;
rows repeated with the same id share a verdict, and ``drop_copies`` keeps one row of each group, whatever the ids; an empty table gives an empty
result; other columns are not read, and ``drop_copies`` hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm import bloom
from tabspark.llm.files import numbered, prepare, quoted, saved, scratch

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"


def text_digest(text: str) -> Column:
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, "")
    return F.sha2(normal.cast("binary"), 256)


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``key``, keep_id, group_size, kept, text_sha256 and the columns ``also``."""
    prepare(docs.sparkSession)
    chars = F.char_length(F.coalesce(F.col(text), F.lit("")))
    rows = saved(docs.select(F.col(key).alias("id"), chars.alias("chars"), text_digest(text).alias("sha"), *also), "digests")
    h = F.xxhash64("sha")
    marked = bloom.tested(rows, bloom.repeated(rows, h, rows.count()), h, "maybe")
    maybe = marked.where("maybe").select("id", "chars", "sha", *also)
    best = maybe.groupBy("sha").agg(F.min(F.struct((-F.col("chars")).alias("c"), "id")).alias("best"), F.count("*").alias("group_size"))
    best = saved(best.select("sha", F.col("best.id").alias("keep_id"), "group_size"), "groups")  # written, so that the join can split a large group
    found = maybe.join(best, "sha").select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha", *also)
    alone = marked.where("NOT maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *also)
    return alone.unionByName(found).select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *also)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows, number = numbered(docs)
        narrow = rows.select(*(c.alias(n) for c, n in zip(quoted([key, text, number]), ("id", "text", "number"))))
        sized = narrow.withColumn("length", F.char_length(F.coalesce(F.col("text"), F.lit(""))))
        found = verdicts(sized, "id", "text", ("number", "length")).where("group_size > 1")
        found = saved(found.select("number", "length", "kept", "text_sha256"), "copies")
        # ``kept`` holds for every row of a group that has the id of the one that stays
        best = found.where("kept").groupBy("text_sha256").agg(F.min(F.struct(-F.col("length"), "number")).alias("best"))
        one = best.select(F.col("best.number").alias("number"))
        dropped = saved(found.select("number").join(one, "number", "left_anti").withColumnRenamed("number", number), "dropped-copies", outlives=True)
    return bloom.anti_join(rows, dropped, number).select(*quoted(docs.columns))
