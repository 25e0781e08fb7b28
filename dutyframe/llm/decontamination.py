"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A benchmark item is searched in windows of its own number of words. Word shingles vote on a 64-bit
fingerprint of each window; block tables give every item whose fingerprint lies within the Hamming
radius (if two fingerprints differ in at most RADIUS bits, one of the blocks differs in at most
RADIUS // BLOCKS); the candidates are confirmed by the exact weighted Jaccard similarity of their
shingle counts. Windows that hold no shingle of any item have similarity 0 and aren't fingerprinted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import shingle_hashes, table, word_hashes

WIDTH = 5
THRESHOLD = 0.8
#: Similarity 0.8 flips 10 of 64 bits on average, with a deviation of 3.
RADIUS = 23
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
#: Text bytes of the benchmark that one pass over the documents holds (its index, some six times that, is broadcast); more takes more passes.
PASS_BYTES = 16_000_000
_FILTER_BITS = 20

#: All ASCII bytes but letters and digits separate words.
SEPARATORS = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])


def words_of(text: str) -> np.ndarray:
    return word_hashes(text.lower().encode("utf-8", "replace"), SEPARATORS)


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of `length` shingles: the bits that more than half of them set."""
    ones = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(_bits(shingles), axis=0, dtype=np.int32, out=ones[1:])
    votes = 2 * (ones[starts + length] - ones[starts]) > length
    return np.packbits(votes, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """The items of one pass: shingles, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.lengths, self.widths, self.shingles, self.counts = [], [], [], [], []
        prints = []
        for item, text in items:
            words = words_of(text)
            if not len(words):
                continue
            shingles = shingle_hashes(words, WIDTH)
            values, counts = np.unique(shingles, return_counts=True)
            self.ids.append(item)
            self.lengths.append(len(words))
            self.widths.append(min(WIDTH, len(words)))
            self.shingles.append(values)
            self.counts.append(counts)
            prints.append(fingerprints(shingles, np.zeros(1, np.int64), len(shingles))[0])
        self.prints = np.array(prints, np.uint64)
        self.lengths, self.widths = np.array(self.lengths, np.int64), np.array(self.widths, np.int64)
        n = len(self.ids)
        owners = np.repeat(np.arange(n), [len(s) for s in self.shingles]) if n else np.empty(0, int)
        everything = np.concatenate(self.shingles) if n else np.empty(0, np.uint64)
        order = np.argsort(everything, kind="stable")
        self.all, self.owners = everything[order], owners[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.all >> np.uint64(64 - _FILTER_BITS)] = True
        self.tables = self._tables(n)

    def _tables(self, n: int) -> list[list[np.ndarray]]:
        """For each block and each value of it, the items whose block differs in RADIUS // BLOCKS bits at most."""
        flips = [sum(1 << b for b in some) for k in range(RADIUS // BLOCKS + 1) for some in combinations(range(BLOCK_BITS), k)]
        out = []
        for block in range(BLOCKS):
            own = (self.prints >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            lists: list[list[int]] = [[] for _ in range(1 << BLOCK_BITS)]
            for item in range(n):
                for flip in flips:
                    lists[own[item] ^ flip].append(item)
            out.append([np.array(x, np.int64) for x in lists])
        return out

    def within_radius(self, fingerprint: np.uint64) -> np.ndarray:
        """All items within RADIUS of the fingerprint."""
        f = int(fingerprint)
        near = np.unique(np.concatenate([self.tables[b][(f >> (b * BLOCK_BITS)) & ((1 << BLOCK_BITS) - 1)] for b in range(BLOCKS)]))
        return near[np.bitwise_count(self.prints[near] ^ fingerprint) <= RADIUS]

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window of every item found in the whole text."""
        words = words_of(text) if text else np.empty(0, np.uint64)
        best: dict[int, tuple[float, int, int]] = {}
        for width in np.unique(self.widths).tolist() if len(words) else ():
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            hits = np.flatnonzero(self.filter[shingles >> np.uint64(64 - _FILTER_BITS)])
            at = np.searchsorted(self.all, shingles[hits])
            hits = hits[(at < len(self.all)) & (self.all[np.minimum(at, len(self.all) - 1)] == shingles[hits])] if len(self.all) else hits[:0]
            if not len(hits):
                continue
            first, last = (np.searchsorted(self.all, shingles[hits], side) for side in ("left", "right"))
            owners = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(first, last, strict=True)]))
            for length in np.unique(self.lengths[owners[self.widths[owners] == width]]).tolist():
                self._windows(shingles, hits, len(words), width, length, best)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]

    def _windows(self, shingles: np.ndarray, hits: np.ndarray, n_words: int, width: int, length: int, best: dict) -> None:
        length = min(length, n_words)
        many = length - width + 1
        covered = np.zeros(n_words - length + 2, np.int32)  # starts of windows that hold a hit
        np.add.at(covered, np.maximum(hits - many + 1, 0).clip(0, n_words - length), 1)
        np.add.at(covered, np.minimum(hits, n_words - length) + 1, -1)
        starts = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > many) + 1):  # one stretch of the text after the other
            if not len(part):
                continue
            low = part[0]
            stretch = shingles[low : part[-1] + many]
            near = [self.within_radius(f) for f in fingerprints(stretch, part - low, many)]
            window, item = np.repeat(part, [len(x) for x in near]), np.concatenate(near)
            wanted = (np.minimum(self.lengths[item], n_words) == length) & (self.widths[item] == width)
            window, item = window[wanted], item[wanted]
            for k in np.unique(item):
                self._confirm(int(k), stretch, low, window[item == k], many, length, best)

    def _confirm(self, k: int, stretch: np.ndarray, low: int, starts: np.ndarray, many: int, length: int, best: dict) -> None:
        """The exact similarity of item k with the windows at starts, those with the most shingles of the item first."""
        values, counts = self.shingles[k], self.counts[k]
        at = np.searchsorted(values, stretch).clip(max=len(values) - 1)
        inside = values[at] == stretch
        held = np.concatenate([[0], np.cumsum(inside)])
        most = held[starts - low + many] - held[starts - low]  # common shingles, if none is too many
        bound = most / (many + counts.sum() - most)
        for j in np.lexsort((starts, -bound)):
            if bound[j] < max(THRESHOLD, best[k][0] if k in best else 0.0):
                break
            part = slice(starts[j] - low, starts[j] - low + many)
            common = np.minimum(np.bincount(at[part][inside[part]], minlength=len(values)), counts).sum()
            likeness = common / (many + counts.sum() - common)
            if likeness >= THRESHOLD and (k not in best or (likeness, -starts[j]) > (best[k][0], -best[k][1])):
                best[k] = (float(likeness), int(starts[j]), int(length))


def passes(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The benchmark in as many parts, by hash, as PASS_BYTES asks for."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PASS_BYTES))
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


def _index(part: DataFrame):
    return part.sparkSession.sparkContext.broadcast(Index(sorted((r["item"], r["text"]) for r in part.collect())))


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, similarity, first_word, n_words: the best window of each item that a row's whole text holds.

    An item is held if the weighted Jaccard similarity of the 5-word shingles of a window of its
    number of words (the whole text, if shorter) is 0.8 or more; words are runs of letters and digits,
    lower-cased. An item of fewer words is one shingle. Null or empty texts hold nothing, and
    null or wordless items are held by nothing; of equal similarities the first window counts.
    Repeated rows give repeated results; an empty table on either side gives none.
    """
    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    found = []
    for part in passes(benchmark, item, item_text):
        index = _index(part)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                at, out = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    for hit in own.find(t):
                        at.append(k)
                        out.append(hit)
                columns = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, item, "similarity", "first_word", "n_words"])

        found.append(rows.mapInArrow(run, f"`{key}` {kind}, `{item}` long, similarity double, first_word long, n_words long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df that hold no item of the benchmark, all columns as they are."""
    at = df.columns.index(text)
    for part in passes(benchmark, item, item_text):
        index = _index(part)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
