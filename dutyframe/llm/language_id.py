"""Language identification by error-correcting output codes.

Every learned language has a codeword; one binary n-gram classifier predicts each bit of it.
Decoding adds up the logistic losses of the bits against each codeword, weighted by how well the
bit separates that language, and takes the codeword of least loss. A small lead over the second
codeword marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import table

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
#: One unit of a document's n-gram shares, as an integer, so that sums don't depend on their order.
UNIT = 10_000_000
SMOOTHING = 2e-6
SHARPNESS = 2.0
AMBIGUOUS_LEAD = 0.2
UNDETERMINED = "und"
MOST_LANGUAGES = 1000

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def gram_shares(text: str) -> np.ndarray:
    """The shares of the hashed 1- to 3-grams of the text's lower-case letters."""
    raw = _LETTERS[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    kept = raw != 32
    kept[1:] |= raw[:-1] != 32  # one space for a run
    letters = raw[kept].astype(np.uint32)
    if not len(letters):
        return np.zeros(BUCKETS)
    shift, factor = np.uint32(32 - BUCKET_BITS), np.uint32(0x9E3779B1)
    two = (letters[:-1] << np.uint32(8)) | letters[1:]
    three = (two[:-1] << np.uint32(8)) | letters[2:]
    counts = np.zeros(BUCKETS)
    for salt, grams in ((0x51ED27, letters), (0xA3000000, two), (0, three)):
        counts += np.bincount(((grams ^ np.uint32(salt)) * factor) >> shift, minlength=BUCKETS)
    return counts / counts.sum()


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class, far apart from each other.

    Up to six classes: all splits into two sides. More: the best of seeded random codes.
    """
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 6:
        columns = [[1 if k == 0 or not (n >> (k - 1)) & 1 else -1 for k in range(classes)] for n in range(1, 1 << (classes - 1))]
        return np.array(columns, np.int8).T
    bits, best, most = int(np.ceil(10 * np.log2(classes))), None, -1
    for seed in range(40):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (classes, bits))
        apart = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        np.fill_diagonal(apart, bits)
        if (code.min(0) != code.max(0)).all() and apart.min() > most:
            best, most = code, int(apart.min())
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    centre: np.ndarray
    scale: np.ndarray
    trust: np.ndarray  # languages x bits, each row sums to 1

    def decode(self, shares: np.ndarray) -> tuple[str, float, bool, str | None]:
        """Language, score, ambiguous, runner-up."""
        z = (shares @ self.weights - self.centre) / self.scale
        loss = (self.trust * np.logaddexp(0, -SHARPNESS * self.code * z)).sum(1)
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0, False, None
        odds = np.exp(-4 * (loss - loss[order[0]]))
        lead = loss[order[1]] - loss[order[0]]
        return self.languages[order[0]], float(1 / odds.sum()), bool(lead < AMBIGUOUS_LEAD), self.languages[order[1]]


def _class_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, units) sums of the batches; languages are flushed before they fill memory."""
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, units in sums.items():
            at = np.flatnonzero(units)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(units[at], rows[lang]), pa.int64())],
                ["lang", "bucket", "units"],
            )
        sums.clear()
        rows.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shares = gram_shares(text)
            if not shares.any():
                continue
            if lang not in sums:
                if len(sums) >= 256:
                    yield from flush()
                sums[lang], rows[lang] = np.zeros(BUCKETS, np.int64), 0
            sums[lang] += np.rint(shares * UNIT).astype(np.int64)
            rows[lang] += 1
    yield from flush()


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 4000) -> Model:
    """Fit the bit classifiers on about rows_per_language rows of each language.

    The rows are those with the smallest hash of the key, so reruns take the same ones. Rows with
    a null text or language teach nothing. Languages are the classes of the model, a short list
    that the driver holds together with one share vector for each; more than MOST_LANGUAGES are an error.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the model holds a list of weights for each")
    if not counts:
        return Model([], codewords(0), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1), np.zeros((0, 1)))
    span = 1 << 31
    limits = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, min(span, span * rows_per_language // n + 1))])
    sample = rows.filter(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(span)) < limits[F.col("l")]).select("l", "t")
    sums = sample.mapInArrow(_class_shares, "lang string, bucket int, units long").groupBy("lang", "bucket").agg(F.sum("units").alias("units")).collect()
    languages = sorted({r["lang"] for r in sums})
    means, seen = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
    for r in sums:
        if r["bucket"] < 0:
            seen[languages.index(r["lang"])] = r["units"]
        else:
            means[languages.index(r["lang"]), r["bucket"]] = r["units"] / UNIT
    means /= seen[:, None]
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        sides = [means[code[:, bit] == side].mean(0) if (code[:, bit] == side).any() else np.full(BUCKETS, 1 / BUCKETS) for side in (1, -1)]
        weights[:, bit] = np.log((sides[0] + SMOOTHING) / (sides[1] + SMOOTHING))
    margins = means @ weights  # of each language's mean document, as shares are linear
    low = np.where(code > 0, margins, np.inf).min(0)
    high = np.where(code < 0, margins, -np.inf).max(0)
    high = np.where(np.isfinite(high), high, low - 1)
    centre, scale = (low + high) / 2, np.maximum((low - high) / 2, 1e-3)
    trust = np.clip(code * (margins - centre) / scale, 0.1, 3)
    return Model(languages, code, weights, centre, scale, trust / trust.sum(1, keepdims=True))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, ambiguous, runner_up for every row, from the whole text alone.

    A null or empty text, or one without a letter, is `und` with score 0; so is every text if the
    model has learned no language. Rows with equal texts get equal results; repeated rows and null
    keys stay as they are; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [
                m.decode(gram_shares(t)) if m.languages and t is not None and any(map(str.isalpha, t)) else (UNDETERMINED, 0.0, False, None)
                for t in batch.column(1).to_pylist()
            ]
            columns = [list(c) for c in zip(*found, strict=True)] or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "lang_pred", "score", "ambiguous", "runner_up"])

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double, ambiguous boolean, runner_up string")


def held_out(key: str, parts: int, part: int):
    """Whether crc32 of the key's text leaves the remainder that is kept out of training."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.filter(~held_out("doc_id", 3, 1)))
    return identify(documents, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up")
