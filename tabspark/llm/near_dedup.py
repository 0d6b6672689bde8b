"""MinHash near-deduplication (operator 8).

A document's set holds the hashes of its runs of ``width`` consecutive words (of all its words, if it has fewer).  Documents with
equal sets are one class and go on as its smallest id.  One-permutation hashing cuts the hash range into ``bands * rows``
bins and keeps the least hash of each; an empty bin takes the value of the first full bin in a fixed random
order of its own (optimal densification).  ``rows`` bins make a band key, and documents with a common band key share a
bucket; at a similarity of 0.8 two documents share none with a probability of (1 - 0.8**6)**40 = 5e-6.

In a bucket only star edges, from one centre to the others, become candidate pairs, so there are no more of them
than bucket members.  Links are confirmed on the full sets.  A link between two members that are not centres would be
lost so, where neither is linked to the centre.  Therefore the buckets whose members are still of several components are put together by centre, and in such a
group everything outside its largest component is compared with the whole group, block by block, inside tasks (``across``).  So every two members of a
bucket end up compared or in one component; no bucket is capped, and no rows are made for pairs.

Defined cases: a NULL or empty text, or one without words, has the empty set and is linked with nothing; repeated rows and rows
with equal id are one node of the graph; a NULL id is a component of its own (NULL); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm import bloom
from tabspark.llm.components import components
from tabspark.llm.files import numbered, prepare, quoted, saved, scratch
from tabspark.llm.words import NOT_SPACE, U64, blocks, combine, hash_words, mix
from tabspark.llm.worker import lean

WIDTH, BANDS, ROWS, PERCENT = 5, 40, 6, 80
BLOCK = 500  # members that a task holds of either side when two components of a group are compared


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for block in blocks(column):
        h, _, _, first = hash_words(block, NOT_SPACE)
        runs = combine(h, width)
        for k in range(block.rows):
            lo, hi = first[k], first[k + 1]
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                yield combine(h[lo:hi], hi - lo) + U64(hi - lo)
            else:
                yield h[:0]


class MinHasher:
    """Band keys of a set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.Generator(np.random.PCG64(20))
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.int32)
        self.salt = mix(np.arange(1, bands + 1, dtype=U64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """``shingles`` sorted, not empty: bins are ranges of the hash, so a bin's first value is its least."""
        at = ((shingles >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        values = np.zeros(self.bins, dtype=U64)
        full = np.zeros(self.bins, dtype=bool)
        values[at[first]], full[at[first]] = shingles[first], True
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.order[empty]
            values[empty] = values[order[np.arange(len(empty)), np.argmax(full[order], axis=1)]]
        return values

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        values = self.signature(shingles).reshape(self.bands, self.rows)
        out = self.salt.copy()
        for k in range(self.rows):
            out = mix(out + values[:, k])
        return out.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, keys): the size, a 128-bit digest and the band keys of each document's set."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = MinHasher(bands, rows)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for own in shingle_sets(batch["text"], width):
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(hasher.keys(own) if len(own) else np.zeros(0, np.int64))
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists], ["id", "n_shingles", "set_a", "set_b", "keys"])

    return source.mapInArrow(lean(sketch), "id long, n_shingles long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, shingles): the whole set of each document."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 100) for k in range(0, batch.num_rows, 100)):
                own = list(shingle_sets(part["text"], width))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"])

    return source.mapInArrow(lean(sets), "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets' intersection is at least ``percent`` of their union."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            one, two = batch["of_a"], batch["of_b"]
            for k in range(batch.num_rows):
                x, y = (c[k].values.to_numpy(zero_copy_only=False) for c in (one, two))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(lean(overlap), "a long, b long")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: ``key``, n_shingles, class_id (smallest id of those with the same set), component_id, kept."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        return saved(_clustered(docs, key, text, width, percent, bands, rows, block), "clusters", outlives=True)


def _clustered(docs: DataFrame, key: str, text: str, width: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    sketched = saved(sketches(docs, key, text, width, bands, rows), "sketches")
    same = sketched.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    classes = saved(same, "set-classes")
    copied = saved(classes.where("copies > 1").select("set_a", "set_b", "class_id"), "copied-sets")
    maybe, alone = bloom.split(sketched.where("n_shingles > 0 AND id IS NOT NULL"), copied, ["set_a", "set_b"])
    first = maybe.join(copied, ["set_a", "set_b"], "left").where("class_id IS NULL OR class_id = id")
    ones = first.select("id", "n_shingles", "keys").unionByName(alone.select("id", "n_shingles", "keys"))

    # members of buckets that hold at least two classes; a Bloom filter leaves the other band keys unshuffled
    keyed = ones.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket"))
    shared = saved(keyed.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    members = saved(bloom.split(keyed, shared, "bucket")[0].join(shared, "bucket"), "bucket-members")
    wanted = saved(members.select("id").distinct(), "bucket-ids")
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # full sets are made anew from the texts; a row that the filter lets through without need is not joined later
    sets = saved(full_sets(bloom.split(source, wanted, "id")[0], "id", "text", width), "full-sets")

    # the centre is the member with the least hash, the same in every bucket: near copies share it in most of theirs
    centres = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id"), F.col("id"), F.col("n"))).alias("c"))
    centres = saved(centres.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    starred = saved(members.join(centres, "bucket").where("id != centre"), "stars")
    edges = starred.where(f"least(n, centre_n) * 100 >= greatest(n, centre_n) * {percent}")
    pairs = saved(edges.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "candidate-pairs")
    labels = components(saved(confirmed(pairs, sets, percent), "confirmed"))

    # buckets whose members, apart from the centre, are of several components
    now = starred.join(labels, "id", "left").select("bucket", "centre", "id", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("bucket")
    mixed = saved(mixed, "open-buckets")
    group = saved(now.join(mixed, "bucket").select("centre", "id", "component").distinct(), "open-groups")
    more = saved(across(group, sets, percent, block), "links-across").select("of_a", "of_b").distinct()
    merged = components(more.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("id").alias("of"), F.col("component").alias("becomes"))

    of_class = classes.join(labels, classes["class_id"] == labels["id"], "left").select("set_a", "set_b", "class_id", "copies", F.coalesce("component", "class_id").alias("of"))
    of_class = of_class.join(merged, "of", "left").withColumn("component", F.coalesce("becomes", "of"))
    several = saved(of_class.where("copies > 1 OR component != class_id").select("set_a", "set_b", "class_id", "component"), "resolved-classes")
    maybe, rest = bloom.split(sketched.drop("keys"), several, ["set_a", "set_b"])
    out = maybe.join(several, ["set_a", "set_b"], "left").select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = out.unionByName(rest.select("id", "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_shingles", "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def across(group: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components within groups (centre, id, component): (of_a, of_b), a link for each member and component it reaches.

    Every member outside a group's largest component meets every member of the group.  Both sides are dealt to blocks
    of about ``block`` members, and a task compares one block with another by counting, for each member of the one, how many
    shingles each member of the other has in common; pairs are never rows, and a task holds two blocks whatever the group's size."""
    per = group.groupBy("centre", "component").agg(F.count("*").alias("n"))
    info = per.groupBy("centre").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
    info = saved(info.select("centre", "size", F.col("main.component").alias("main"), (F.col("size") - F.col("main.n")).alias("outside")), "group-sizes")
    known = group.join(info, "centre")
    known = known.withColumns({"blocks": F.ceil(F.col("outside") / block), "chunks": F.ceil(F.col("size") / block)})
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = known.where("component != main").select("centre", "id", "component", F.lit(True).alias("outside"), deal(1, "blocks").alias("r"), every("chunks").alias("c"))
    inside = known.select("centre", "id", "component", F.lit(False).alias("outside"), deal(2, "chunks").alias("c"), every("blocks").alias("r"))
    rows = outside.unionByName(inside).join(sets, "id")

    def meet(table: pa.Table) -> pa.Table:
        out = table["outside"].to_numpy()
        component = table["component"].to_numpy()
        lists = table["shingles"].combine_chunks()
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        of = lambda k: flat[offs[k] : offs[k + 1]]
        these, those = np.flatnonzero(out), np.flatnonzero(~out)
        links = []
        if len(these) and len(those):
            sizes = np.array([len(of(k)) for k in these])
            owner = np.repeat(np.arange(len(these)), sizes)
            shingles = np.concatenate([of(k) for k in these])
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            for k in those:
                own = of(k)
                lo, hi = np.searchsorted(shingles, own), np.searchsorted(shingles, own, side="right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                common = np.bincount(owner[at], minlength=len(these))
                hit = (100 * common >= percent * (sizes + len(own) - common)) & (component[these] != component[k])
                links += [(int(c), int(component[k])) for c in np.unique(component[these[hit]])]
        a, b = zip(*set(links)) if links else ((), ())
        return pa.table({"of_a": pa.array(a, pa.int64()), "of_b": pa.array(b, pa.int64())})

    return rows.groupBy("centre", "r", "c").applyInArrow(meet, "of_a long, of_b long")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, of each component the one with the smallest id, with all their columns.  The nodes
    are rows here, whatever their ids; a NULL id counts as smallest, and of equal ids one row stays."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows, number = numbered(docs)
        narrow = rows.select(*(c.alias(n) for c, n in zip(quoted([key, text, number]), ("id", "text", "number"))))
        later = saved(cluster(narrow, "number", "text", **options).where("NOT kept").select("number", "component_id"), "near-copies")
        members = saved(later.unionAll(later.select(F.col("component_id").alias("number"), "component_id").distinct()), "component-members")
        ids = bloom.split(narrow.select("number", F.col("id").cast("long").alias("id")), members, "number")[0]
        named = saved(ids.join(members, "number"), "named-members")
        first = named.groupBy("component_id").agg(F.min(F.struct("id", "number")).alias("first")).select(F.col("first.number").alias("number"))
        dropped = named.select("number").join(first, "number", "left_anti").withColumnRenamed("number", number)
        dropped = saved(dropped, "dropped-near-copies", outlives=True)
    return bloom.anti_join(rows, dropped, number).select(*quoted(docs.columns))
