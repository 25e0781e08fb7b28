"""Near-duplicate detection by b-bit MinHash.

Each text's shingle set gives minima under many hash functions. Bands of full minima make the
candidates; of the signature only the low bits of each minimum are kept, packed, and the share of
equal bits, corrected for chance collisions, estimates the similarity of a candidate pair. Pairs
that pass are confirmed on their full shingle sets, so every link is exact.

Texts with equal shingle sets are one class from the start. In a bucket of a band, classes are
first compared with the most central class of the bucket only, and then one class of each component;
classes of one component need no more comparisons. In the last round what is outside a bucket's largest component is
compared with all of the bucket, which is dealt over many tasks. So a large group of near copies
costs about its size, times the number of classes that resemble it but don't belong, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import ASCII_LOWER, ASCII_SPACE, Scratch, drop_written, join_keys, mix64, salted_join, shingle_hashes, table, word_hashes, written
from dutyframe.llm.components import components

#: A pair at the threshold of 0.8 shares no band with a probability of (1 - 0.8**5)**32, 3 in a million.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Low bits kept of each minimum.
BITS = 8
PER_LONG = 64 // BITS
THRESHOLD_PERCENT = 80
#: Estimates below this aren't confirmed: 0.8 less six standard deviations (0.032) of the estimate.
ESTIMATE_CUT = 0.608
#: Up to so many text hashes are broadcast to read their texts; beyond it the texts are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Classes of a bucket that are compared in one task; larger buckets are dealt over tasks in such parts.
PART = 512

_RNG = np.random.Generator(np.random.PCG64(816))
_FACTORS = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles (A-Z lower-cased)."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "replace").translate(ASCII_LOWER), ASCII_SPACE), width))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of a non-empty set under each hash function."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[k : k + 1024, None] * _FACTORS + _OFFSETS).min(0), out=out)
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, packed into 64-bit words. The minima are mixed first, as minima have few free high bits."""
    low = (mix64(values) & np.uint64((1 << BITS) - 1)).reshape(-1, PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), 1)


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, bands, packed = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                if len(shingles):
                    values = minima(shingles)
                    ids.append(set_id(shingles))
                    keys = values.reshape(BANDS, ROWS)
                    band = np.arange(BANDS, dtype=np.uint64)
                    for row in range(ROWS):
                        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + keys[:, row])
                    bands.append(band.view(np.int64))
                    packed.append(pack(values).view(np.int64))
                else:
                    ids.append(None)
                    bands.append(None)
                    packed.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                ["key", "hash", "id", "n", "bands", "sig"],
            )

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal BITS-wide fields, corrected for fields equal by chance."""
    lowest = sum(1 << k for k in range(0, 64, BITS))
    unequal = F.lit(0)
    for k in range(HASHES // PER_LONG):
        x, width = a[k].bitwiseXOR(b[k]), BITS
        while width > 1:  # any set bit of a field moves down to its lowest
            width //= 2
            x = x.bitwiseOR(F.shiftrightunsigned(x, width))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(lowest)))
    chance = 1 / (1 << BITS)
    return (1 - unequal / HASHES - chance) / (1 - chance)


def _sizes_allow(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD_PERCENT


def _compared(width: int, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes, np.ndarray] = {}

            def of(key: bytes, text: str, sets=sets) -> np.ndarray:
                if key not in sets:
                    sets[key] = shingle_set(text, width)
                return sets[key]

            common, total, masks = [], [], []
            for u, v, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = of(u, a), of(v, b)
                inside = np.isin(x, y, assume_unique=True)
                common.append(int(inside.sum()))
                total.append(len(x) + len(y) - common[-1])
                masks.append(np.packbits(np.pad(inside, (0, -len(x) % 64))).view(np.int64) if masked else None)
            columns = [pa.array(common, pa.int64()), pa.array(total, pa.int64()), pa.array(masks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["u", "v", "common", "total", "mask"])

    return run


class _Confirm:
    """Confirms candidate pairs of classes on the full shingle sets of their texts."""

    def __init__(self, df: DataFrame, text: str, classes: DataFrame, width: int):
        self.texts = df.select(F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
        self.classes, self.width = classes, width

    def __call__(self, pairs: DataFrame, masked: bool = False) -> DataFrame:
        """pairs (u, v), a written table, with the sizes of the intersection and the union of their full sets.

        masked: and a bit for each shingle of u, in hash order, that says whether v has it.
        """
        needed = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        needed = written(needed.join(self.classes.select("id", "hash"), "id"), "needed")
        few = needed.count() <= BROADCAST_KEYS
        width = self.width

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # other texts may have an equal hash
            for batch in batches:
                yield batch.filter(pa.array([set_id(shingle_set(t, width)) == i for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_()))

        # beyond the broadcast copies of a text are counted as one before they are shuffled
        texts = self.texts.join(F.broadcast(needed), "hash") if few else self.texts.distinct().join(needed, "hash")
        texts = texts.select("id", "text").mapInArrow(own, "id binary, text string").dropDuplicates(["id"])
        texts = written(texts, "texts")
        both = salted_join(pairs, texts.select(F.col("id").alias("u"), F.col("text").alias("a")), ["u"], "v").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
        compared = written(both.select("u", "v", "a", "b").mapInArrow(_compared(width, masked), "u binary, v binary, common long, total long, mask array<long>"), "compared")
        drop_written(texts)
        drop_written(needed)
        return compared


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("common") * 100 >= F.col("total") * THRESHOLD_PERCENT).select("u", "v")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """key, n_shingles, component_id, kept, text_hash, first for every row.

    Rows are linked if their sets of distinct word shingles have a Jaccard similarity of 0.8 or
    more; a component is named by its smallest key, which alone is kept. A text with fewer than
    `width` words is one shingle; a null or empty text, or one without words, has none and is
    linked with nothing. Repeated rows share a component and its kept key. A null key is never the
    name of a component that has other keys. An empty table gives an empty result.

    kept goes by the key alone. A key that repeats with different texts may stand in several
    components, or name several; first says whether the row's key and text_hash are the smallest of
    its own component (always, without words).
    """
    scratch = Scratch()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    kind = rows.schema["key"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signatures(width), f"key {kind}, hash long, id binary, n long, bands array<long>, sig array<long>"), "signatures")
    # equal sets are one class, counted together before the shuffle
    first_row = F.min(F.struct(F.col("key").isNull(), "key", "hash", "n", "bands", "sig")).alias("s")
    classes = signed.filter("n > 0").groupBy("id").agg(first_row, F.count(F.lit(1)).alias("copies"))
    classes = scratch.written(classes.select("id", "s.key", "s.hash", "s.n", "s.bands", "s.sig", "copies"), "classes")
    n_classes = classes.count()
    in_bands = classes.select("id", F.explode("bands").alias("bucket"))
    sizes = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("times", F.col("size"))
    shared = scratch.written(join_keys(in_bands, sizes, "bucket", "times", n_classes * BANDS), "shared")
    # a class that meets many others is likely the one that near copies were made from
    central = shared.groupBy("id").agg(F.sum("size").alias("meets"))
    ranked = scratch.written(shared.join(central, "id"), "ranked")
    hubs = ranked.groupBy("bucket").agg(F.max_by("id", F.struct("meets", "id")).alias("hub"), F.count(F.lit(1)).alias("times"))
    members = scratch.written(join_keys(ranked, hubs, "bucket", "times", ranked.count()).select("id", "bucket", "hub", "meets", "size"), "buckets")
    signs = classes.select("id", "n", "sig", "bands")
    left, right = (signs.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "uv")

    def likely(pairs: DataFrame) -> DataFrame:
        found = salted_join(scratch.written(pairs, "pairs"), left, ["u"], "v").join(right, "v").filter(_sizes_allow("n_u", "n_v"))
        return scratch.written(found.filter(estimate(F.col("sig_u"), F.col("sig_v")) >= ESTIMATE_CUT).select("u", "v"), "likely")

    def linked(links: DataFrame) -> DataFrame:
        scratch.made.append(components(links))
        return scratch.made[-1]

    def rooted(tree: DataFrame) -> DataFrame:
        labels = tree.select(F.col("u").alias("id"), F.col("v").alias("root"))
        return members.select("id", "bucket", "meets", "size").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))

    confirm = _Confirm(df, text, classes, width)
    # first round: each class with the hub of most of its buckets
    votes = members.filter("id != hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.max_by("hub", F.struct("n", "hub")).alias("u")).select("u", F.col("id").alias("v"))
    first = confirm(likely(best), masked=True)
    scratch.made.append(first)
    beside = first.select(F.col("v").alias("id"), F.col("u").alias("near"), "common", "mask")
    # a class that links with its hub has the hub's name for now; chains of hubs come together in the components below
    tree = _links(first).select(F.col("v").alias("u"), F.col("u").alias("v"))
    # second round: one class of each component of a bucket with the most central one there
    firsts = scratch.written(rooted(tree).groupBy("bucket", "root").agg(F.max(F.struct("meets", "id")).alias("top")).select("bucket", "top"), "firsts")
    middle = firsts.groupBy("bucket").agg(F.max("top").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "u", "n")
    across = join_keys(firsts, middle, "bucket", "n", firsts.count()).filter("u != top").select("u.id", F.col("top.id").alias("v")).select(F.col("id").alias("u"), "v").distinct()
    second = confirm(likely(across))
    scratch.made.append(second)
    tree = linked(tree.unionByName(_links(second)))
    # last round: in buckets that still hold several components, pairs across them, in the first band the two share. Classes
    # of other components than the bucket's largest meet all of it; those of the largest never meet each other
    labelled = scratch.written(rooted(tree), "labelled")
    per_root = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = per_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("times"), (F.sum("n") - F.max("n")).alias("few")).filter("few > 0")
    held = join_keys(labelled, open_buckets.withColumn("all", F.col("times")), "bucket", "times", labelled.count())
    held = held.join(signs, "id").join(beside, "id", "left").withColumn("before", F.slice("bands", F.lit(1), F.array_position("bands", F.col("bucket")).cast("int") - 1))
    own = ["id", "root", "n", "sig", "before", "near", "common", "mask"]
    held = scratch.written(held.select("bucket", "top", "all", "few", *own), "open")
    # both sides are cut in parts of PART classes; a class goes to each part of the other side
    parts = lambda c: F.ceil(F.col(c) / PART).cast("int")
    place = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "id"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    side = lambda df, c: df.select("bucket", "x", "y", *(F.col(o).alias(f"{o}_{c}") for o in own), F.col("top").alias(f"top_{c}"))
    a = side(held.filter("root != top").withColumns({"x": place(1, "few"), "y": every("all")}), "u")
    b = side(held.withColumn("x", every("few")).withColumn("y", place(2, "all")), "v")
    wanted = (F.col("root_u") != F.col("root_v")) & ((F.col("id_u") < F.col("id_v")) | (F.col("root_v") == F.col("top_v"))) & _sizes_allow("n_u", "n_v") & (estimate(F.col("sig_u"), F.col("sig_v")) >= ESTIMATE_CUT)
    # of two classes compared with the same hub, the common shingles inside the hub are known, and outside it bounded
    inside = F.aggregate(F.zip_with("mask_u", "mask_v", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, k: n + k)
    most = inside + F.least(F.col("n_u") - F.col("common_u"), F.col("n_v") - F.col("common_v"))
    far = F.coalesce((F.col("near_u") == F.col("near_v")) & (most * 100 < (F.col("n_u") + F.col("n_v") - most) * THRESHOLD_PERCENT), F.lit(False))
    same_cell = (a["bucket"] == b["bucket"]) & (a["x"] == b["x"]) & (a["y"] == b["y"])
    # a pair may meet as (u, v) in one bucket and as (v, u) in another: its smaller id comes first
    rest = a.join(b, same_cell & wanted & ~far & ~F.arrays_overlap("before_u", "before_v")).select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).distinct()
    rest = scratch.written(rest, "rest")
    if not rest.isEmpty():
        third = confirm(rest)
        scratch.made.append(third)
        tree = linked(tree.unionByName(_links(third)))
    roots = tree.select(F.col("u").alias("id"), F.col("v").alias("root"))
    named = scratch.written(classes.select("id", "key", "hash", "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    names = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "hash")).alias("s"), F.count(F.lit(1)).alias("times"))
    names = names.select("root", F.col("s.key").alias("component_id"), F.col("s.hash").alias("first_hash"), "times")
    by_class = written(join_keys(named, names, "root", "times", n_classes).select("id", "component_id", "first_hash", "copies"), "by-class")
    scratch.clear()
    shown = signed.select("key", "hash", "id", "n")
    worded = join_keys(shown.filter("n > 0"), by_class, "id", "copies", signed.count()).drop("id")
    bare = shown.filter("n = 0").select("key", "hash", "n", F.col("key").alias("component_id"), F.col("hash").alias("first_hash"))
    out = worded.unionByName(bare)
    kept = F.col("key").eqNullSafe(F.col("component_id"))
    first = kept & (F.col("hash") == F.col("first_hash"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), F.col("hash").alias("text_hash"), first.alias("first"))


def keep_one(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component that near_duplicates found, all columns as they are.

    Rows are told apart by key and text: the first pair of each component is kept, whatever becomes
    of other rows with its key. A row without words is kept, and so is one with a null key. Kept
    rows with equal keys and texts are one row from then on.
    """

    def by_row(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("__key"), F.col("text_hash").alias("__found"))

    def same(other: DataFrame) -> Column:
        return (hashed[key] == other["__key"]) & (hashed["__hash"] == other["__found"])

    keyed = found.filter(F.col(key).isNotNull())
    hashed = df.withColumn("__hash", F.xxhash64(text))
    gone = by_row(keyed.filter("not first")).distinct()
    repeated = by_row(keyed.filter("first")).groupBy("__key", "__found").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    hashed = hashed.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return hashed.drop("__hash")
    first = hashed.join(repeated, same(repeated), "left_semi")
    rest = hashed.join(repeated, same(repeated), "left_anti")
    return rest.unionByName(first.dropDuplicates([key, "__hash"])).drop("__hash")


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: Sets as lists, equal sets as one class; pairs by an inverted index, components by a closure.
ORACLE = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS sh FROM d),
c AS (SELECT min(rid) AS cid, min(doc_id) AS least, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT cid, n, unnest(sh) AS token FROM c),
p AS (SELECT a.cid AS u, b.cid AS v, count(*) AS k, any_value(a.n + b.n) AS total FROM t a JOIN t b ON a.token = b.token AND a.cid < b.cid AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
e AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (total - k)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT cid AS u, cid AS v FROM c UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
m AS (SELECT r.u AS cid, min(c.least) AS component FROM r JOIN c ON c.cid = r.v GROUP BY r.u)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.cid = c.cid
"""
