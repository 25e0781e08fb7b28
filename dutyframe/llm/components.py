"""Connected components of a link table, by alternating star contraction; a small table is walked by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyframe.llm.common import drop_written, join_keys, written

#: Up to so many links, all neighbours of a hub (a pair of ids each) may meet in one task; beyond it they stay where they are.
ONE_TASK = 1_000_000
#: Up to so many links (some 50 MB with their names) one task walks all of them; that spares the rounds, not the memory.
WALKED = 200_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find; a component is named by its smallest node."""
    above: dict = {}

    def top(x):
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            above.setdefault(u, u)
            above.setdefault(v, v)
            if a != b:
                above[max(a, b)] = min(a, b)
    found = [(u, r) for u in above if (r := top(u)) != u]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["u", "v"])


def _downward(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) for every linked node u but the smallest of its component, v being that smallest node.

    links: columns u and v of any orderable type, in any direction and number. Each round hangs a
    node's neighbours on the smallest of them, first those above the node, then those below; the
    rounds grow with the logarithm of the number of nodes. State is a table in the shared folder. In
    a large table a node with very many neighbours meets them where they are, not in one task. No links give no rows.
    """
    now = written(_downward(links), "links")
    seen = _state(now)
    if seen[0] <= WALKED:
        walked = written(now.coalesce(1).mapInArrow(_walk, now.schema), "links")
        drop_written(now)
        return walked

    def met(big: DataFrame, keyed: DataFrame, rows: int) -> DataFrame:
        return join_keys(big, keyed, "u", "n", rows) if rows > ONE_TASK else big.join(keyed.drop("n"), "u")

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = met(both, least, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = written(large.distinct(), "links")
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = met(large, below, large.count()).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        after = written(_downward(small), "links")
        drop_written(now)
        drop_written(large)
        now, before = after, seen
        seen = _state(now)
        if seen == before:
            return now
