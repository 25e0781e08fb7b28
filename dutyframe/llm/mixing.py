"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target share p = target / source size is to be taken p times. The
whole part is taken outright; the fractions of one source are rounded against each other: two
documents exchange words at random until one of the two fractions is 0 or 1, which keeps the sum
of words exactly and every expectation. Blocks of documents are rounded in parallel, each leaves
one fractional document at most, and those are combined level by level in a reduction tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.llm.common import join_keys, table, word_count, written

BLOCK_ROWS = 8192
#: Copies of one row that a task unfolds.
UNFOLD = 10_000
FAN_IN = 256
SEED = 20240229
#: Documents above this many times the mean size of their block are rounded among themselves first.
LARGE = 2
CAP = 3
#: Sources up to this number are broadcast (one short row each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def pivotal(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round all but one of the fractions p to 0 or 1; sum(sizes * p) and expectations stay."""
    p = p.copy()
    held = -1
    draws = rng.random(len(p))
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if held < 0:
            held = k
            continue
        up = min((1 - p[held]) * sizes[held], p[k] * sizes[k])  # words that can move from k to held
        down = min(p[held] * sizes[held], (1 - p[k]) * sizes[k])
        if draws[k] * (up + down) < down:
            full = (1 - p[held]) * sizes[held] <= p[k] * sizes[k]
            p[k] = max(0.0, p[k] - up / sizes[k]) if full else 0.0
            p[held] = 1.0 if full else min(1.0, p[held] + up / sizes[held])
        else:
            empty = p[held] * sizes[held] <= (1 - p[k]) * sizes[k]
            p[k] = min(1.0, p[k] + down / sizes[k]) if empty else 1.0
            p[held] = 0.0 if empty else max(0.0, p[held] - down / sizes[held])
        if not 0 < p[held] < 1:
            held = k if 0 < p[k] < 1 else -1
    return p


def settle_large(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the large documents in pairs, and the one that is left against the smaller ones as a bundle.

    No single small document has room for what the last large one must give or take. The bundle
    exchanges words in equal shares of all its members, until the large document or a member is
    integral, so the sum of words and every expectation stay as in a transfer between two.
    """
    p = p.copy()
    large = (sizes > LARGE * sizes.mean()) & (p > 0) & (p < 1)
    p[large] = pivotal(sizes[large], p[large], rng)
    for k in np.flatnonzero(large & (p > 0) & (p < 1)):
        while 0 < p[k] < 1:
            bundle = ~large & (p > 0) & (p < 1)
            total = sizes[bundle].sum()
            if total <= 0:
                break
            up = min((1 - p[k]) * sizes[k], p[bundle].min() * total)  # words that can move from the bundle to k
            down = min(p[k] * sizes[k], (1 - p[bundle].max()) * total)
            gain = up if rng.random() * (up + down) < down else -down
            p[bundle] -= gain / total
            p[k] += gain / sizes[k]
            p[np.abs(p) < 1e-9], p[np.abs(p - 1) < 1e-9] = 0.0, 1.0
    return p


def repair(sizes: np.ndarray, whole: np.ndarray, p: np.ndarray, words: float, rng: np.random.Generator) -> np.ndarray:
    """p, all integral, with some documents once more or once less, in a drawn order, so that sizes * p comes near words.

    A document that is larger than all the words to be dealt can't be taken in part; where it is taken, or left out, others
    make up for it, within 0 to CAP copies. No document is changed twice, and none beyond what is amiss.
    """
    p = p.copy()
    amiss = float((sizes * p).sum() - words)
    for k in rng.permutation(len(p)):
        if sizes[k] <= abs(amiss):
            step = -1.0 if amiss > 0 else 1.0
            if 0 <= whole[k] + p[k] + step <= CAP:
                p[k] += step
                amiss += step * sizes[k]
    return p


def _round_group(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "leaf"], ascending=[False, True, True], kind="stable")  # large ones first, so that a small one is left over
        rng = np.random.default_rng([SEED, level, int(rows["sid"].iloc[0]), int(rows["block"].iloc[0])])
        sizes, p = rows["size"].to_numpy(np.float64), rows["p"].to_numpy()
        words = float((sizes * p).sum())
        p = pivotal(sizes, settle_large(sizes, p, rng), rng)
        if last or rows["alone"].iloc[0]:
            p = np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)
            p = repair(sizes, rows["whole"].to_numpy(np.float64), p, words, rng)
        return rows.assign(p=p)

    return run


def one_by_one(df: DataFrame) -> DataFrame:
    """The rows of df with copy, a number for each of equal rows; these are counted before the shuffle and dealt over tasks."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(UNFOLD).cast("long"))
    few = counted.filter(F.col("__n") <= UNFOLD).withColumn("__from", F.lit(0).cast("long"))
    many = counted.filter(F.col("__n") > UNFOLD).withColumn("__from", F.explode(parts)).repartition("__from", *df.columns)
    to = F.least(F.col("__from") + UNFOLD, F.col("__n")) - 1
    return few.unionByName(many).select(*df.columns, F.explode(F.sequence(F.col("__from"), to)).alias("copy"))


def source_targets(rows: DataFrame) -> DataFrame:
    """sid, source, source_size, n_rows, target of each source; rows: source, size.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all
    sizes by weight, but stop at CAP times the source's size; the excess is shared again. With
    sources in order of CAP x size / weight the capped ones come first, so running sums over one
    row per source give the shares in closed form.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("sid", F.row_number().over(by_name).cast("long")).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
    sources = sources.withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sources = sources.withColumn("share", left / weights).withColumn("capped", F.col("cap") <= F.col("share") * F.col("weight"))
    open_share = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("share")))).over(everything)["share"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(open_share * F.col("weight"))
    return sources.select("sid", "source", "source_size", "n_rows", F.least(target, F.col("cap")).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target, copies, taken for every row.

    size: words of the whole text (null or empty: 0); such rows are taken 0 times, as size 0 adds
    no words. A null source is a source of its own. Repeated rows are rounded one by one, and are
    numbered, so that a key that holds very many rows is dealt over blocks like any other rows. A target
    is off by one document's size at most, and where other documents can make up for it by far less (see repair). Draws are seeded and rows are ordered by size and the
    hash of key, size and number, so reruns agree. An empty table gives an empty result.
    """
    rows = written(one_by_one(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))), "mix-sizes")
    sources = written(source_targets(rows), "mix-sources")
    shape = sources.agg(F.count(F.lit(1)), F.max("n_rows")).first()
    small = F.broadcast if shape[0] <= BROADCAST_SOURCES else lambda x: x
    joined = rows.join(small(sources), rows["source"].eqNullSafe(sources["source"]), "inner").select(
        "key", rows["source"], "size", "sid", "source_size", "target", "n_rows", F.xxhash64(F.col("key").cast("string"), "size", "copy").alias("tie")
    )
    share = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(CAP)))).otherwise(0.0)
    joined = joined.withColumn("share", share).withColumn("whole", F.floor("share")).withColumn("p", F.col("share") - F.col("whole"))
    blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    joined = joined.withColumn("block", F.pmod("tie", F.greatest(blocks, F.lit(1))).cast("long")).withColumn("leaf", F.col("block"))
    joined = joined.withColumn("alone", blocks <= 1)  # the block is all of its source
    columns = ["key", "source", "size", "sid", "source_size", "target", "whole", "tie", "block", "leaf", "alone", "p"]
    open_rows = joined.filter("p > 0 and p < 1").select(columns)
    schema = open_rows.schema
    leaves = max(1, math.ceil((shape[1] or 0) / BLOCK_ROWS))
    levels = 1
    while FAN_IN ** (levels - 1) < leaves:
        levels += 1
    # a node of the tree is (sid, block); its children's leftovers are the rows of the next level
    state = written(open_rows.groupBy("sid", "block").applyInPandas(_round_group(0, levels == 1), schema), "mix-level")
    settled = [joined.filter("not (p > 0 and p < 1)").select(columns), state.filter("not (p > 0 and p < 1)")]
    for level in range(1, levels):
        waiting = state.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
        state = written(waiting.groupBy("sid", "block").applyInPandas(_round_group(level, level == levels - 1), schema), "mix-level")
        settled.append(state.filter("not (p > 0 and p < 1)"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(0).cast("int")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's rows as often as the mix takes them (0 to CAP times), all columns as they are.

    Rows are told apart by key, source and text hash. Rows that repeat all three are rounded one by
    one and share their copies: each is repeated by its even part, and what is over goes to the
    first ones. Nulls in any of the three are values of their own. Names of columns that begin with two underscores are
    used on the way; df must have none.
    """
    mark = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(source, text).cast("string"))
    marked = df.withColumn("__mark", mark).withColumn("__at", F.spark_partition_id())
    totals = F.sum("copies").cast("int").alias("__copies"), F.count(F.lit(1)).cast("int").alias("__rows"), F.count(F.lit(1)).alias("__times")
    wanted = mix(marked, "__mark", text, source).groupBy("__mark").agg(*totals).filter("__copies > 0")
    rows = join_keys(marked, wanted, "__mark", "__times", df.count())
    once = rows.filter("__rows = 1").withColumn("__own", F.col("__copies"))
    # repeated rows are written, as the partition that they were read in must be the same for both uses, and numbered within it
    repeated = written(rows.filter("__rows > 1"), "mix-repeated")
    before = Window.partitionBy("__mark").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = repeated.groupBy("__mark", "__at").agg(F.count(F.lit(1)).alias("__n")).select("__mark", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    turn = F.row_number().over(Window.partitionBy("__mark", "__at").orderBy("__mark")) + F.col("__start")
    more = repeated.join(starts, ["__mark", "__at"])
    more = more.withColumn("__own", F.floor(F.col("__copies") / F.col("__rows")).cast("int") + F.when(turn <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)).drop("__start")
    both = once.unionByName(more).filter("__own > 0")
    return both.withColumn("__own", F.explode(F.sequence(F.lit(1), "__own"))).select(*df.columns)


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
