"""Token counts without token ids: pieces are counted once per distinct pre-token.

A document's tokens are the sum over its pre-tokens of frequency x pieces. The pieces of a
bounded list of common pre-tokens are broadcast and summed where the text is read; all other
pre-tokens go, with their frequency in the document, through a join with the pieces of each
distinct pre-token. The list changes how much is shuffled, never a count.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import table, written

#: Rows read for the list of common pre-tokens, its length, and the longest pre-token in it (characters).
SAMPLE_ROWS, COMMON, COMMON_LENGTH = 2000, 150_000, 48
TOKEN_LIMIT = 2048
#: Texts above this many characters are scanned match by match instead of as one list.
LONG_TEXT = 2_000_000

# The tokenizer's own split pattern, for texts within Latin-1 and for all others.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")

#: Ranges in which all Unicode versions agree on letters and numbers.
_SETTLED = "[\x00-\u0377\u0384-\u052f\u05d0-\u05ea\u0620-\u064a\u1e00-\u1eff\u2000-\u2027\u2030-\u205e\u20a0-\u20bd\u2190-\u23ff\u3001-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"

#: The normalizers and pre-tokenizers that the patterns above stand for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS, _PRE_TOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

_CACHE: dict[int, PreTokens] = {}


def check_tokenizer(json_text: str) -> None:
    """An error for a tokenizer whose texts are normalized or split in another way than this module does."""
    file = json.loads(json_text)
    normalizers = (file.get("normalizer") or {}).get("normalizers", [])
    splitters = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    same = [n["type"] for n in normalizers] == _NORMALIZERS and [s["type"] for s in splitters] == _PRE_TOKENIZERS
    same = same and normalizers[1]["pattern"] == {"Regex": r"\s+"} and splitters[0]["pattern"] == {"Regex": _PATTERN}
    if not same or file["model"]["type"] != "BPE":
        raise ValueError("this tokenizer normalizes or splits texts in another way than the counts here assume")


class PreTokens:
    """The tokenizer of a JSON file, split into its pre-tokenizing and its piece-counting part."""

    def __init__(self, json_text: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(json_text)
        self.any_text = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
        self.settled = re.compile(_SETTLED)
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False)

    @classmethod
    def of(cls, json_text: str) -> PreTokens:
        """One per worker process."""
        key = hash(json_text)
        if key not in _CACHE:
            _CACHE[key] = cls(json_text)
        return _CACHE[key]

    def split(self, text: str) -> tuple[int, Counter]:
        """(special tokens, frequency of each pre-token) of a whole text."""
        if self.specials and "<|" in text and self.specials.search(text):
            parts = self.specials.split(text)
            total: Counter = Counter()
            for part in parts:
                total.update(self._plain(part))
            return len(parts) - 1, total
        return 0, self._plain(text)

    def _plain(self, text: str) -> Counter:
        try:
            text.encode("latin-1")  # is it Latin-1? Then lower() equals the tokenizer's normalizer
            text, pattern = text.lower(), _LATIN
        except UnicodeEncodeError:
            text, pattern = self.tokenizer.normalizer.normalize_str(text), self.any_text
            if not self.settled.fullmatch(text):  # letters of newer Unicode versions than the tokenizer's
                return Counter(text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        if len(text) > LONG_TEXT:
            return Counter(m.group() for m in pattern.finditer(text))
        return Counter(pattern.findall(text))

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(self.bytes_as_text.pre_tokenize_str(pre_token)[0][0]))


def _pieces(json_text):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens.of(json_text.value)
        for batch in batches:
            names = batch.column(0)
            yield pa.RecordBatch.from_arrays([names, pa.array([pre.pieces(x) for x in names.to_pylist()], pa.int32())], ["pre_token", "pieces"])

    return run


def common_pre_tokens(df: DataFrame, json_text, key: str, text: str) -> dict[str, int]:
    """Pieces of up to COMMON pre-tokens, the most frequent ones of SAMPLE_ROWS rows picked by key hash."""
    picked = df.select(F.col(key).alias("k")).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(F.col("k").cast("string"))).limit(SAMPLE_ROWS)
    texts = df.join(F.broadcast(picked), df[key] == picked["k"], "left_semi").select(F.col(text).alias("t")).filter("t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens.of(json_text.value)
        for batch in batches:
            total: Counter = Counter()
            for t in batch.column(0).to_pylist():
                total.update(pre.split(t)[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pre_token", "n"])

    counted = texts.mapInArrow(count, "pre_token string, n long").filter(F.length("pre_token") <= COMMON_LENGTH)
    top = counted.groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(COMMON).select("pre_token")
    return {r["pre_token"]: r["pieces"] for r in top.mapInArrow(_pieces(json_text), "pre_token string, pieces int").collect()}


def count_tokens(df: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row, over the whole text.

    A null text counts as empty: 0 bytes and 0 tokens. No begin, end or other added special
    tokens; the strings of special tokens inside a text are one token each, as the library's
    default has it. A tokenizer of another kind is refused (check_tokenizer). Repeated rows and null keys get one result row each. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        file = f.read()
    check_tokenizer(file)
    json_text = spark.sparkContext.broadcast(file)
    common = spark.sparkContext.broadcast(common_pre_tokens(df, json_text, key, text))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pre, known, part, row = PreTokens.of(json_text.value), common.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                ids, sizes, sums, ends, names, freqs = [], [], [], [0], [], []
                for t in some.column(1).to_pylist():
                    t = t or ""
                    total, counts = pre.split(t)
                    for name, n in counts.items():
                        pieces = known.get(name)
                        if pieces is None:
                            names.append(name)
                            freqs.append(n)
                        else:
                            total += pieces * n
                    ids.append((part << 40) + row)
                    row += 1
                    sizes.append(len(t.encode("utf-8")))
                    sums.append(total)
                    ends.append(len(names))
                rare = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(freqs, pa.int64())], ["pre_token", "n"])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), rare)],
                    ["k", "row", "n_bytes", "known", "rare"],
                )

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    read = written(rows.mapInArrow(split, f"k {kind}, row long, n_bytes long, known long, rare array<struct<pre_token: string, n: long>>"), "token-rows")
    rare = read.select("row", F.explode("rare").alias("r")).select("row", "r.pre_token", "r.n")
    pieces = rare.select("pre_token").distinct().mapInArrow(_pieces(json_text), "pre_token string, pieces int")
    rest = rare.join(pieces, "pre_token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    n_tokens = F.col("known") + F.coalesce("rest", F.lit(0))
    return read.select("k", "row", "n_bytes", "known").join(rest, "row", "left").select(F.col("k").alias(key), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
