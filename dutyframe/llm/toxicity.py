"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained on ordinary text; the toxic one goes on with
segments trained on what is peculiar to toxic text. A window of words that the toxic dictionary
compresses to fewer bytes than the ordinary one speaks for toxicity. Thresholds on these gains,
and their weights in a document's score, are calibrated on labelled documents that trained
neither dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import drop_written, table, written
from dutyframe.llm.language_id import held_out

#: Words of a window, and of one step to the next.
WINDOW, STEP = 8, 7
#: About so many labelled documents of each kind are fitted on, with all windows of each.
TOXIC_ROWS, ORDINARY_ROWS = 2400, 5000
BASE_BYTES, TOXIC_BYTES = 250_000, 4096
#: A word is peculiar to toxic text if it stands between so many different pairs of neighbours there,
#: at a rate of so many times that of ordinary text.
LEAST_CONTEXTS, LEAST_RATIO = 4, 8.0
#: Lengths in bytes of the beginnings of words that are looked at besides whole words.
BEGINNINGS = (7, 6, 5)
GAINS = (2, 3, 4, 5, 6)
TOXIC_WEIGHT = 2.0

_NO_WORD = re.compile(r"[\W_]+")


def windows(text: str) -> list[bytes]:
    """The overlapping word windows of a whole text, lower-cased."""
    words = _NO_WORD.sub(" ", text.lower()).split()
    return [f" {' '.join(words[k : k + WINDOW])} ".encode("utf-8", "replace") for k in range(0, max(1, len(words) - (WINDOW - STEP)), STEP)] if words else []


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """The content of a trained dictionary; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Compressors:
    """The two compressors of a model, one pair per task."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        size = (BASE_BYTES + TOXIC_BYTES).bit_length() + 1
        parameters = z.ZstdCompressionParameters.from_level(
            3, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=6, window_log=size, hash_log=size, chain_log=size
        )
        self.pair = [z.ZstdCompressor(compression_params=parameters, dict_data=z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_RAWCONTENT)) for x in (ordinary or b" " * 8, toxic or b" " * 8)]

    def gains(self, some: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        sizes = []
        for compressor in self.pair:
            found = compressor.multi_compress_to_buffer(some, threads=1)
            sizes.append(np.fromiter((len(found[k]) for k in range(len(some))), np.int32, len(some)))
        return sizes[0] - sizes[1]


def features(gains: np.ndarray) -> np.ndarray:
    """What a document's score is made of: its best gain, and the windows beyond each threshold, as numbers and as rates."""
    n = max(1, len(gains))
    over = [np.count_nonzero(gains >= g) for g in GAINS]
    best = gains.max() if len(gains) else 0
    second = np.partition(gains, -2)[-2] if len(gains) > 1 else 0
    return np.array([best, second, *np.log1p(over), *np.sqrt(np.array(over) / n)], np.float64)


def _feature_batches(ordinary: bytes, toxic: bytes, texts: list[str | None]) -> np.ndarray:
    """Features of each text; the windows of several texts share one call of the compressor."""
    pair = Compressors(ordinary, toxic)
    out, waiting, ends = [], [], []

    def flush() -> None:
        gains = pair.gains(waiting) if waiting else np.zeros(0, np.int32)
        out.extend(features(g) for g in np.split(gains, ends[:-1]))
        waiting.clear()
        ends.clear()

    for text in texts:
        waiting += windows(text or "")
        ends.append(len(waiting))
        if len(waiting) > 5000:
            flush()
    if ends:
        flush()
    return np.array(out).reshape(len(texts), 2 + 2 * len(GAINS))


def _feature_rows(parts, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic = parts.value
        for batch in batches:
            found = _feature_batches(ordinary, toxic, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], [name, "features"])

    return run


def _all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(windows(text), pa.binary())], ["w"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of each window, with its neighbours there (none at the window's ends)."""
    for batch in batches:
        for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before, word, after = [], [], []
            for w in windows(text):
                words = w.split()
                before += [b"", *words[:-1]]
                word += words
                after += [*words[1:], b""]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(word), pa.int32()), *(pa.array(x, pa.binary()) for x in (before, word, after))], ["toxic", "before", "word", "after"])


def units(word: Column) -> Column:
    """The word between spaces, and its beginnings after a space."""
    space = F.lit(b" ")
    beginnings = [F.when(F.octet_length(word) > n, F.concat(space, F.substring(word, 1, n))) for n in BEGINNINGS]
    return F.array_compact(F.array(F.concat(space, word, space), *beginnings))


def peculiar_units(sample: DataFrame) -> list[tuple[bytes, int]]:
    """Words, and beginnings of words, with many different neighbours in toxic texts and few in ordinary ones, and how often they stand in toxic ones.

    sample: columns toxic and t. Counting pairs of neighbours instead of occurrences keeps out
    words that only copies repeat. Everything is counted before the peculiar units alone are collected.
    """
    words = sample.select("toxic", "t").mapInArrow(_contexts, "toxic int, before binary, word binary, after binary")
    found = words.groupBy("toxic", "word", F.xxhash64("before", F.lit(0), "after").alias("context")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.substring("unit", -1, 1) == F.lit(b" ")
    found = found.select("toxic", "context", "n", F.explode(units(F.col("word"))).alias("unit")).groupBy("unit", "toxic", "context").agg(F.sum("n").alias("n"))
    toxic = F.col("toxic") == 1
    counted = found.groupBy("unit").agg(F.count_if(toxic).alias("there"), F.count_if(~toxic).alias("here"), F.sum(F.when(toxic, F.col("n"))).alias("n"))
    counted = written(counted, "units")
    total = counted.filter(whole).agg(F.sum("there"), F.sum("here")).first()
    there, here = (max(1, n or 0) for n in total)
    peculiar = (F.col("there") >= LEAST_CONTEXTS) & (F.col("there") / there > LEAST_RATIO * (F.col("here") + 0.5) / here)
    rows = counted.filter(peculiar).select("unit", "n").collect()
    drop_written(counted)
    return sorted((bytes(r["unit"]), r["n"]) for r in rows)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton steps with a ridge; toxic rows count TOXIC_WEIGHT times."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    counts, beta = np.where(y == 1, TOXIC_WEIGHT, 1.0), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (counts * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (counts * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta[:-1], float(beta[-1])


def _collected(texts: DataFrame) -> list[bytes]:
    """All windows of some thousand texts, in an order of their own."""
    return sorted(texts.mapInArrow(_all_windows, "w binary").toArrow()["w"].to_pylist())


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit dictionaries and thresholds on about TOXIC_ROWS + ORDINARY_ROWS labelled rows picked by key hash.

    Labels are 1 or 0; null labels, null texts and labels without a document teach nothing; a key
    labelled both ways counts as toxic. Without a toxic and an ordinary row there is nothing to
    learn, and every score is 0.
    """
    spark = documents.sparkSession
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    span = 1 << 31
    limits = {kind: min(span, span * most // max(1, count.get(kind, 0)) + 1) for kind, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))}
    h = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(span))
    picked = rows.filter(h < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0])).withColumn("calibrate", F.pmod(F.xxhash64(F.lit("c"), F.col("k").cast("string")), F.lit(3)) == 0)
    # the bound above is that of the sample: some thousand short rows
    found = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(picked), "k")
    sample = found.filter("not calibrate")
    toxic, ordinary = (sample.filter(F.col("toxic") == kind).select("t") for kind in (1, 0))
    ordinary = _collected(ordinary)
    if not ordinary or toxic.mapInArrow(_all_windows, "w binary").isEmpty():
        width = 2 + 2 * len(GAINS)
        return Model(b"", b"", np.zeros(width), np.ones(width), np.zeros(width), -30.0)
    rng = np.random.default_rng(7)
    own = [unit for unit, n in peculiar_units(sample) for _ in range(n)] or _collected(toxic)
    own = [own[k] for k in rng.permutation(len(own))]
    own = [b"".join(own[k : k + 8]) for k in range(0, len(own), 8)]
    plain = [ordinary[k] for k in rng.permutation(len(ordinary))]
    base = _dictionary(BASE_BYTES, plain, 24)
    model = Model(base, base + _dictionary(TOXIC_BYTES, own, 32), np.zeros(0), np.ones(0), np.zeros(0), 0.0)
    parts = spark.sparkContext.broadcast((model.ordinary, model.toxic))
    held = found.filter("calibrate").select("toxic", "t").mapInArrow(_feature_rows(parts, "toxic"), "toxic int, features array<double>").collect()
    y = np.array([r["toxic"] for r in held], float)
    if len(set(y)) < 2:
        held = found.select("toxic", "t").mapInArrow(_feature_rows(parts, "toxic"), "toxic int, features array<double>").collect()
        y = np.array([r["toxic"] for r in held], float)
    order = sorted(range(len(held)), key=lambda k: (held[k]["toxic"], held[k]["features"]))  # sums don't depend on the rows' order
    model.mean, model.scale, model.weights, model.bias = _fit_logistic(np.array([held[k]["features"] for k in order]), y[order])
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted for every row, from all windows of the whole text alone.

    A null text scores as an empty one: no window, no gain. Equal texts score equal; repeated rows
    and null keys stay as they are; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = m.score(_feature_batches(m.ordinary, m.toxic, batch.column(1).to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def keep_ordinary(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df whose text isn't predicted toxic, all columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                scores = m.score(_feature_batches(m.ordinary, m.toxic, batch.column(at).to_pylist()))
                yield batch.filter(pa.array(scores < 0.5))

    return df.mapInArrow(run, df.schema)


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents.filter(~held_out("doc_id", 5, 0)), labels.filter(~held_out("doc_id", 5, 0)))
    return score(documents, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
