"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space (Java and Python regex syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode alone an own one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="dutyframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    The written files survive lost executors, and readers prune columns of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dutyframe/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/dutyframe/" in str(path):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written on the way to one result, to be deleted once no later plan reads them."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        self.made.append(written(df, what))
        return self.made[-1]

    def clear(self) -> None:
        for df in self.made:
            drop_written(df)
        self.made = []


#: A key with more than 1 / HOT_SHARE of a table's rows (and more than HOT_ROWS) is hot; so there are at most HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1000, 1000


def hot_limit(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_SHARE)


def join_keys(big: DataFrame, keyed: DataFrame, on: str, count: str, rows: int, how: str = "inner") -> DataFrame:
    """big joined with keyed, which has one row for each value of `on` and in `count` its number of rows in big.

    rows: the rows of big. Hot keys, HOT_SHARE at most, are broadcast, so that their rows of big stay
    where they are; all other keys are joined as usual. how: inner or left_semi. A null key meets nothing.
    """
    hot = F.col(count) > hot_limit(rows)
    few, many = keyed.filter(hot), keyed.filter(~hot)
    kept = big.join(F.broadcast(few.drop(count)), on, how)
    rest = big.join(F.broadcast(few.select(on)), on, "left_anti").join(many.drop(count), on, how)
    return kept.unionByName(rest)


def salted_join(big: DataFrame, keyed: DataFrame, on: list[str], spread: str, counts: DataFrame | None = None) -> DataFrame:
    """big (a written table) joined with keyed, which has one row for each value of `on`.

    Rows of a hot key are dealt over several tasks by the hash of `spread`, each of which gets a copy
    of the key's row of keyed: 2 x HOT_SHARE copies at most in all, whatever the rows of big. A null key meets nothing.
    counts: `on` and n, the rows of big for each value, where they are known.
    """
    rows = big.count()
    if rows <= HOT_ROWS:
        return big.join(keyed, on)
    limit = hot_limit(rows)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.filter(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = big.join(F.broadcast(hot), on, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = keyed.join(F.broadcast(hot), on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("__parts").join(right.drop("__parts"), [*on, "__part"]).drop("__part")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def word_count(col: Column) -> Column:
    """Number of words of a text (null: none)."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and odd multipliers, for numpy hashing inside tasks.
BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: A-Z to a-z, all other bytes as they are.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every bit of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def word_hashes(data: bytes, separators: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of the bytes; separators: which of the 256 byte values separate words."""
    if not data:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separators[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:-1], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Space and \t \n \v \f \r.
ASCII_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of width words; with fewer words, one for the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : n - width + 1 + k]
        out ^= out >> np.uint64(29)
    return mix64(out + np.uint64(width))
