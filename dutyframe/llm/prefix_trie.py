"""The trie of conversation prefixes by prefix doubling.

Every turn gets a dense name. In round k two neighbouring blocks of 2**(k-1) turns with names a and b make a
block of 2**k turns whose name stands for (a, b); so equal blocks have equal names after a logarithmic number of
joins, whatever their length. A prefix of d turns is made of one block for each binary digit of d,
the longest first: its name stands for (name of the prefix without the last block, name of that block). Equal
prefix names are one node of the trie. Sums of words are put together along with the names.

No step needs a conversation, or a node's conversations, in one task: turns are numbered by a range sort, names
and sums are aggregates with map-side combine, and names go back to the rows by joins that broadcast hot keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.chat_format import turn_digest
from dutyframe.llm.common import Scratch, table, text_or_empty, word_count
from dutyframe.llm.lookup import lookup
from dutyframe.operators.resolve import dense_ids

#: Conversations of one group of so many ids share the beginning of the group's first one, at most BORROWED - 1 turns of it.
GROUP, BORROWED = 20, 4
#: Ids that meet in one piece of a node's list: those of a range of so many numbers.
CHUNK = 256


def named(rows: DataFrame, keys: list[str], name: str, base: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(rows with a dense name for each value of keys: base, base + 1, ...; the first name that is free). rows: a written table."""
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__row", F.monotonically_increasing_id())
    told = scratch.written(told, "trie-names")
    ids = dense_ids(told, "__row", name, base - 1)
    return lookup(rows, ids, keys, "__n", rows.count()), base + told.count()


def numbered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns with their place in the conversation: conv_id, pos from 1, digest, words; conversations: conv_id, n).

    Places come from a range sort of all turns and the dense number of each row; a conversation's first number
    gives its turns theirs. Order: turn, null first, then turn_digest. Rows of a null conv_id are left out.
    """
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(turn_digest(role, text)).alias("digest"), word_count(text).alias("words"), F.monotonically_increasing_id().alias("__tie"))
    ordered = rows.sort("conv_id", F.col("turn").asc_nulls_first(), "digest", "__tie").drop("turn", "__tie")
    ordered = scratch.written(ordered.withColumn("__row", F.monotonically_increasing_id()), "trie-turns")
    dense = scratch.written(dense_ids(ordered, "__row", "row", 0), "trie-rows")
    convs = scratch.written(dense.groupBy("conv_id").agg(F.min("row").alias("__first"), F.count(F.lit(1)).alias("n")), "trie-convs")
    placed = lookup(dense, convs.select("conv_id", "__first", F.col("n").alias("__n")), ["conv_id"], "__n", dense.count())
    return placed.select("conv_id", (F.col("row") - F.col("__first") + 1).alias("pos"), "digest", "words"), convs.select("conv_id", "n")


def rebuilt(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns and conversations (conv_id, n, with turnless ones) after the borrowing of beginnings).

    A conversation c borrows the first h = crc32(c) % 4 turns of c - c % 20, or all it has, and goes on with its own after the first h.
    Remainders have the sign of c, as in SQL. A group lends 3 turns to 39 conversations at most.
    """
    c = F.col("conv_id")
    lender = convs.select(c.alias("lender"), F.col("n").alias("lent"))
    plan = convs.withColumns({"lender": c - c % GROUP, "h": F.crc32(c.cast("string").cast("binary")) % BORROWED})
    plan = plan.join(lender, "lender", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    plan = scratch.written(plan.select("conv_id", "lender", "n", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    own = lookup(turns, plan.select("conv_id", "h", "taken", F.col("n").alias("__n")), ["conv_id"], "__n", turns.count()).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words")
    first = turns.filter(F.col("pos") < BORROWED).select(F.col("conv_id").alias("lender"), "pos", "name", "words")
    borrowed = plan.filter("taken > 0").select("conv_id", "lender", "taken").join(first, "lender").filter("pos <= taken")
    return own.unionByName(borrowed.select("conv_id", "pos", "name", "words")), plan.select("conv_id", F.col("length").alias("n"))


def prefixes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, node, total, last: every prefix of every conversation, the empty one (node 0) included.

    turns: conv_id, pos from 1 without gaps, name, words; convs: conv_id, n. node: one number for each different sequence of
    names. total: words of the prefix; last: words of its last turn.
    """
    longest = convs.agg(F.max("n")).first()[0] or 0
    levels = [scratch.written(turns.select("conv_id", (F.col("pos") - 1).alias("at"), "name", "words", F.col("words").alias("last")), "trie-blocks")]
    for _ in range(1, max(longest, 1).bit_length()):
        odd = F.col("at") % 2 == 1
        half = lambda c, right: F.max(F.when(odd if right else ~odd, F.col(c)))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(half("name", False).alias("a"), half("name", True).alias("b"), F.sum("words").alias("words"), half("last", True).alias("last"))
        pairs = scratch.written(pairs.filter("a is not null and b is not null"), "trie-pairs")
        levels.append(scratch.written(named(pairs, ["a", "b"], "name", 0, scratch)[0].drop("a", "b"), "trie-blocks"))
    zero = F.lit(0).cast("long")
    found = convs.select("conv_id", zero.alias("depth"), zero.alias("node"), zero.alias("total"), zero.alias("last"))
    free = 1
    for k in range(len(levels) - 1, -1, -1):
        # blocks at an even place end a prefix whose lowest digit is theirs
        block = levels[k].filter(F.col("at") % 2 == 0).select("conv_id", F.shiftleft("at", k).alias("depth"), "name", "words", F.col("last").alias("__last"))
        longer = found.join(block, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), F.col("node").alias("a"), F.col("name").alias("b"), (F.col("total") + F.col("words")).alias("total"), F.col("__last").alias("last"))
        made, free = named(scratch.written(longer, "trie-pairs"), ["a", "b"], "node", free, scratch)
        found = found.unionByName(scratch.written(made.drop("a", "b"), "trie-prefixes"))
    return found


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 from rows (node, text) in order: the digest of a node's texts, comma-joined; never a node's texts at once."""
    now, done = None, []
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now is None or now[0] != node:
                if now is not None:
                    done.append((now[0], now[1].hexdigest()))
                now = (node, hashlib.sha256(text.encode()))
            else:
                now[1].update(b"," + text.encode())
    if now is not None:
        done.append((now[0], now[1].hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])


def nodes(found: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node of the trie of prefixes(): see op12_prefix_trie. convs: conv_id, n.

    A conversation c is the smallest member of the nodes of its prefixes from some depth s on, and of none before. So
    the words that sharing saves below a node are, summed over its members, those of the turns from the node's depth to s - 1:
    an aggregate over prefixes, without pairs of a node and its descendants.
    """
    rows = found.count()
    own = scratch.written(found.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("total").alias("before"))
    linked = scratch.written(own.join(above, ["conv_id", "depth"], "left"), "trie-linked")
    kids = scratch.written(linked.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "trie-kids")
    starts = linked.groupBy("conv_id").agg(F.min_by(F.coalesce("before", F.lit(0)), "depth").alias("start"))
    leaves = linked.join(kids, "node", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    totals = found.groupBy("conv_id").agg(F.max("total").alias("all"), F.count(F.lit(1)).alias("__n"))
    about = totals.join(starts, "conv_id", "left").join(leaves, "conv_id", "left").join(convs, "conv_id")
    about = scratch.written(about.select("conv_id", F.coalesce("start", "all").alias("start"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "n", "__n"), "trie-about")
    told = lookup(found, about, ["conv_id"], "__n", rows)
    sums = told.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("start") - F.col("total") + F.col("last"), F.lit(0))).alias("saved_tokens"))
    ends = told.filter("depth = n").groupBy("node", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    hashed = ends.repartition("node").sortWithinPartitions("node", "chunk").select("node", "text").mapInArrow(_hash_lists, "node long, ends_sha256 string")
    first = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(kids.select(F.col("node").alias("parent"), F.col("n_children").alias("__n")), "parent")
    out = lookup(linked, first, ["parent"], "__n", linked.count())
    for more in (kids, sums, hashed):
        out = out.join(more, "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, scratch: Scratch, borrow: bool = False) -> DataFrame:
    """The trie of all conversations (conv_id, turn, role, text; other columns are never read), a row for each node.

    conv_id: the node's smallest member; depth; parent_conv_id: the parent's (root: null); n_convs: members; n_children;
    n_leaves: childless nodes below, itself included; saved_tokens: words that needn't be computed again below, each
    node's (members - 1) times the words of its last text; ends_sha256: digest of the conversations that end there.
    borrow: beginnings are borrowed first, see rebuilt(). Null role or text: empty. Turns tied in turn are in the order of their
    digest; repeated rows are turns of their own. Rows of a null conv_id are no conversation. No rows give no rows.
    """
    placed, convs = numbered(turns, scratch)
    placed = scratch.written(named(scratch.written(placed, "trie-placed"), ["digest"], "name", 0, scratch)[0].drop("digest"), "trie-named")
    if borrow:
        placed, convs = rebuilt(placed, convs, scratch)
    return nodes(prefixes(placed, convs, scratch), convs, scratch)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"), Scratch(), borrow=True)


#: DuckDB has no crc32, so the digits are folded through the table of the reflected polynomial. A prefix is known by its turns' digests.
ORACLE = r"""
WITH bits AS (SELECT list(v ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, array_agg({'d': d, 'w': w} ORDER BY turn NULLS FIRST, d) AS ts FROM t GROUP BY conv_id),
hashed AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, y: xor(crc_table[CAST(xor(c & 255, y) + 1 AS INT)], c // 256)), 4294967295) % 4 AS h FROM o, bits),
r AS (SELECT a.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, CAST(h AS INT)), list_slice(a.ts, CAST(h AS INT) + 1, len(a.ts))) AS ts FROM hashed a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, depth, array_to_string(list_transform(list_slice(ts, 1, depth), lambda x: x.d), ' ') AS path, array_to_string(list_transform(list_slice(ts, 1, depth - 1), lambda x: x.d), ' ') AS up,
    CASE WHEN depth = 0 THEN 0 ELSE ts[depth].w END AS w, len(ts) = depth AS ends FROM r, LATERAL (SELECT unnest(range(len(ts) + 1)) AS depth)),
n AS (SELECT depth, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
below AS (SELECT a.depth, a.path, sum(b.saved) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM own a JOIN (SELECT *, unnest(range(depth + 1)) AS above FROM own) b ON b.above = a.depth AND left(b.path, greatest(a.depth * 65 - 1, 0)) = a.path GROUP BY ALL)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, own.n_convs, CAST(own.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN below USING (depth, path) LEFT JOIN own m ON m.depth = own.depth - 1 AND m.path = own.up
"""
