"""Removal of repeated 200-byte strings, by a common-prefix-aware merge sort of suffixes.

Suffixes are taken at anchors: every 200-byte window is assigned the leftmost of its 64-byte grams
with the least hash, so equal windows have equal anchors at equal places. Anchors whose gram occurs
once can't belong to a repeated window and are dropped. At each remaining anchor, the suffix from
its first window is sorted: tasks sort runs and front-code them (length shared with the string
before, and the rest), the runs are exchanged, and a loser tree merges them; it keeps for each
contestant the length it shares with the last winner, and compares bytes only beyond that. The
longest prefix that a suffix shares with a neighbour says how many of its windows are repeated.
Windows further on at an anchor may be repeated with another partner; they are settled by their
hashes among the suffixes of the same anchor gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.llm.common import BYTE_VALUE, Scratch, _powers, drop_written, join_keys, mix64, salted_join, table, text_or_empty, written

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1  # grams of a window
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
#: Suffixes of one sorted run, and of one merge.
RUN_ROWS, MERGE_ROWS = 50_000, 20_000
#: Spans up to so many bytes in all are broadcast to the texts; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32_000_000


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: those of any two equally long parts can be compared (see part_hashes)."""
    up, _ = _powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:-1], out=out[1:])
    return out


def part_hashes(prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    _, down = _powers(len(prefix) - 1)
    return mix64((prefix[starts + length] - prefix[starts]) * down[starts])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window, anchor) for each anchor of the bytes."""
    found = []
    for low in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        part = raw[low : low + CHUNK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        grams = part_hashes(prefix_hashes(part), np.arange(len(part) - GRAM + 1), GRAM)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        found.append((grams[at[first]], first + low, last + low, at[first] + low))
    if not found:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["g", "t0", "t1", "at"]
    for batch in batches:
        parts, many = [], 0
        for t0, t1, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            gram, first, last, at = anchors(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
            n = len(gram)
            parts.append((gram.view(np.int64), np.full(n, t0), np.full(n, t1), (first << 16) | ((last - first) << 8) | (at - last)))
            many += n
            if many > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)
                parts, many = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], names)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t0, t1, at, g, suffix): the bytes of all windows of each kept anchor."""
    names = ["t0", "t1", "start", "windows", "offset", "g", "suffix"]
    for batch in batches:
        rows: list[tuple] = []
        for t0, t1, text, kept in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data = text.encode("utf-8", "replace")
            for one in kept:
                at = one["at"]
                start, windows, after = at >> 16, ((at >> 8) & 255) + 1, at & 255
                rows.append((t0, t1, start, windows, after + windows - 1, one["g"], data[start : start + windows - 1 + LENGTH]))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which are known to share `known` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step, low = 16, known
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    while step > 1:  # the first difference is in the next `step` bytes
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """For each of the sorted strings, the length shared with the one before, and the rest."""
    lengths, rests, before = np.zeros(len(strings), np.int32), [], b""
    for k, s in enumerate(strings):
        lengths[k] = n = shared_length(before, s)
        rests.append(s[n:])
        before = s
    return lengths, rests


class Run:
    """A front-coded run, decoded string by string."""

    __slots__ = ("lengths", "rests", "ids", "k", "now", "shared")

    def __init__(self, lengths: list[int], rests: list[bytes], ids: list[tuple[int, int]]):
        self.lengths, self.rests, self.ids, self.k = lengths, rests, ids, 0
        self.now: bytes | None = rests[0] if rests else None
        self.shared = 0  # with the last winner of the tree

    def advance(self) -> None:
        """The next string; what it shares with the one before, the winner just taken, is known."""
        self.k += 1
        if self.k < len(self.rests):
            self.shared = self.lengths[self.k]
            self.now = self.now[: self.shared] + self.rests[self.k]
        else:
            self.now = None


def merge(runs: list[Run]) -> Iterator[tuple[tuple[int, int], bytes, int]]:
    """(id, string, length shared with the string before) of all runs in order, by a loser tree.

    Every contestant carries the length it shares with the last winner. Of two, the one that
    shares more is smaller, without a comparison; only on a tie are bytes compared, from there on,
    and the loser then carries the length it shares with the new winner.
    """
    n = len(runs)
    losers = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = runs[a], runs[b]
        if x.now is None or y.now is None:
            return (b, a) if x.now is None else (a, b)
        if x.shared != y.shared:
            return (a, b) if x.shared > y.shared else (b, a)
        same = shared_length(x.now, y.now, x.shared)
        if (x.now[same : same + 1], a) <= (y.now[same : same + 1], b):
            y.shared = same
            return a, b
        x.shared = same
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if n > 1 else 0
    while runs[winner].now is not None:
        run = runs[winner]
        yield run.ids[run.k], run.now, run.shared
        run.advance()
        node = (winner + n) // 2
        while node >= 1 and n > 1:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _coded_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of the task in runs; a row is the part of a run that goes to one bucket."""

    def coded(rows: list[tuple[int, bytes, int, int]]) -> pa.RecordBatch:
        rows.sort()
        out, low = [], 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][0] != rows[low][0]:
                part = rows[low:k]
                lengths, rests = front_code([r[1] for r in part])
                out.append((part[0][0], lengths.astype(np.uint16).tobytes(), np.array([len(r) for r in rests], np.uint16).tobytes(), b"".join(rests), np.array([r[2:] for r in part], np.int64).tobytes()))
                low = k
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["bucket", "lengths", "sizes", "rests", "ids"])

    rows: list[tuple[int, bytes, int, int]] = []
    for batch in batches:
        rows += zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
        if len(rows) >= RUN_ROWS:
            yield coded(rows)
            rows = []
    if rows:
        yield coded(rows)


def _decoded(lengths: bytes, sizes: bytes, rests: bytes, ids: bytes) -> Run:
    ends = np.cumsum(np.frombuffer(sizes, np.uint16).astype(np.int64))
    parts = [rests[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return Run(np.frombuffer(lengths, np.uint16).tolist(), parts, [tuple(x) for x in np.frombuffer(ids, np.int64).reshape(-1, 2).tolist()])


def _merged_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s0, s1, best): the longest prefix each suffix shares with a neighbour in its bucket."""

    def merged(runs: list[Run]) -> pa.RecordBatch:
        ids, shared = [], []
        for name, _, n in merge(runs):
            ids.append(name)
            shared.append(n)
        ahead = np.array([*shared[1:], 0], np.int64)
        both = np.array(ids, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.maximum(np.array(shared, np.int64), ahead))], ["s0", "s1", "best"])

    bucket, runs = None, []
    for batch in batches:  # rows are sorted by bucket
        for own, *coded in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if own != bucket and runs:
                yield merged(runs)
                runs = []
            bucket = own
            runs.append(_decoded(*coded))
    if runs:
        yield merged(runs)


def longest_shared(suffixes: DataFrame) -> DataFrame:
    """s0, s1, best for distinct suffixes (columns s0, s1, suffix): the longest prefix shared with another.

    Suffixes that share LENGTH bytes meet in one bucket, and shorter prefixes don't matter here. A
    prefix that very many suffixes share is dealt over several buckets; best may then be too
    small, but never below LENGTH, as each of them has a partner in its bucket.
    """
    marked = suffixes.select("s0", "s1", "suffix", F.xxhash64(F.substring("suffix", 1, LENGTH)).alias("prefix"))
    total = suffixes.count()
    buckets = max(1, -(-total // MERGE_ROWS))
    hot = marked.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MERGE_ROWS)
    dealt = marked.join(hot, "prefix", "left")
    salt = F.when(F.col("n").isNotNull(), F.pmod("s0", F.floor(F.col("n") / MERGE_ROWS) + 1)).otherwise(0)
    bucket = F.when(F.col("n").isNull(), F.pmod("prefix", F.lit(buckets))).otherwise(-1 - F.pmod(F.xxhash64("prefix", salt), F.lit(1 << 40)))
    runs = dealt.select(bucket.cast("long").alias("bucket"), "suffix", "s0", "s1").mapInArrow(_coded_runs, "bucket long, lengths binary, sizes binary, rests binary, ids binary")
    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged_buckets, "s0 long, s1 long, best long")


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """The bytes covered by the flagged windows, as maximal (start, end) pairs."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(at, new)]


def _window_keys(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every window of rows (s0, s1, g, offset, windows, suffix); equal keys: equal windows of one gram and place."""
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    sizes = np.array([len(r[5]) for r in rows])
    windows = np.array([r[4] for r in rows])
    row = np.repeat(np.arange(len(rows)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
    keys = part_hashes(prefix_hashes(data), starts, LENGTH)
    place = np.array([r[3] for r in rows])[row] - inside
    return mix64(keys ^ mix64(np.array([r[2] for r in rows], np.int64).view(np.uint64)[row] + place.astype(np.uint64))), row


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s0, s1, spans) of suffixes with repeated windows; rows are sorted by g, groups are bounded."""

    def settled(rows: list[tuple]) -> pa.RecordBatch:
        keys, row = _window_keys(rows)
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        flags = np.split(counts[back] > 1, np.cumsum(np.array([r[4] for r in rows]))[:-1])
        out = [(r[0], r[1], [x for s in _spans(f) for x in s]) for r, f in zip(rows, flags, strict=True) if f.any()]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["s0", "s1", "spans"])

    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
        if len(rows) > 4000:
            cut = len(rows) - 1
            while cut > 0 and rows[cut - 1][2] == rows[-1][2]:
                cut -= 1
            if cut:
                yield settled(rows[:cut])
                rows = rows[cut:]
    if rows:
        yield settled(rows)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, key, s0, s1, window): a row for each window, for grams too frequent for one group."""
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
        for low in range(0, len(rows), 2000):
            some = rows[low : low + 2000]
            keys, row = _window_keys(some)
            first = np.cumsum([r[4] for r in some]) - [r[4] for r in some]
            names = np.array([r[:3] for r in some], np.int64)[row]
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 2]), pa.array(keys.view(np.int64)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array((np.arange(len(row)) - first[row]).astype(np.int64))], ["g", "key", "s0", "s1", "window"])


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t0, t1, spans) with spans that overlap or touch made one; there are few left of the one per anchor."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            both = np.array(spans, np.int64).reshape(-1, 2)
            both = both[np.argsort(both[:, 0], kind="stable")]
            reach = np.maximum.accumulate(both[:, 1])
            new = np.flatnonzero(np.append(True, both[1:, 0] > reach[:-1]))
            out.append(np.column_stack([both[new, 0], reach[np.append(new[1:], len(both)) - 1]]).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["t0", "t1", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) from (key, text, copied, spans)."""
    for batch in batches:
        out = []
        for text, copied, spans in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
            data = text.encode("utf-8", "replace")
            if copied and len(data) >= LENGTH:
                spans = [0, len(data)]
            ends, kept, removed, runs = 0, hashlib.sha256(), 0, 0
            for a, b in sorted(zip((spans or [])[::2], (spans or [])[1::2], strict=True)):
                if a > ends or not runs:
                    kept.update(data[ends:a])
                    runs += 1
                    ends = a
                removed += max(0, b - ends)
                ends = max(ends, b)
            kept.update(data[ends:])
            out.append((len(data), removed, runs, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """t0, t1, spans (array of start, end, start, end, ...): repeated bytes of each distinct text that has some.

    texts: t0, t1 (a text's hashes) and t. Whole texts that occur twice aren't
    told by this alone, as equal texts are one here. The result is a table in the shared folder.
    """
    scratch = Scratch()
    found = scratch.written(texts.mapInArrow(_anchor_rows, "g long, t0 long, t1 long, at long"), "anchors")
    ends = found.groupBy("g").agg(F.count(F.lit(1)).alias("times"), *[f(c).alias(f"{n}_{c}") for c in ("t0", "at") for n, f in (("min", F.min), ("max", F.max))])
    again = ends.filter("min_t0 != max_t0 or min_at != max_at").select("g", "times")
    again = join_keys(found, again, "g", "times", found.count(), "left_semi")
    kept = again.groupBy("t0", "t1").agg(F.collect_set(F.struct("at", "g")).alias("kept"))
    one = Window.partitionBy("t0", "t1").orderBy("t0")
    whole = texts.withColumn("copy", F.row_number().over(one)).filter("copy = 1").select("t0", "t1", "t")
    rows = whole.join(kept, ["t0", "t1"]).select("t0", "t1", "t", "kept").mapInArrow(_suffix_rows, "t0 long, t1 long, start long, windows long, offset long, g long, suffix binary")
    rows = scratch.written(rows.withColumns({"s0": F.xxhash64("suffix"), "s1": F.xxhash64(F.lit("s"), "suffix")}), "suffixes")
    drop_written(found)
    distinct = scratch.written(rows.groupBy("s0", "s1").agg(F.count(F.lit(1)).alias("places"), F.first("g").alias("g"), F.first("offset").alias("offset"), F.first("windows").alias("windows"), F.first("suffix").alias("suffix")), "distinct")
    best = longest_shared(distinct.select("s0", "s1", "suffix"))
    size = F.col("windows") + (LENGTH - 1)
    done = F.when(F.col("places") > 1, size).otherwise(F.coalesce("best", F.lit(0)))
    sorted_out = scratch.written(distinct.drop("suffix").join(best, ["s0", "s1"], "left").withColumn("done", done), "sorted")
    # windows that the sort left open, among all suffixes of the same gram
    open_grams = sorted_out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("done") < size).alias("open")).filter("open and n > 1").select("g", "n", F.col("n").alias("times"))
    open_rows = join_keys(distinct, open_grams, "g", "times", distinct.count())
    open_rows = scratch.written(open_rows.select("s0", "s1", "g", "offset", "windows", "suffix", "n"), "open")
    columns = ["s0", "s1", "g", "offset", "windows", "suffix"]
    small = open_rows.filter(F.col("n") <= MERGE_ROWS).select(*columns).repartition("g").sortWithinPartitions("g").mapInArrow(_repeated_windows, "s0 long, s1 long, spans array<long>")
    single = open_rows.filter(F.col("n") > MERGE_ROWS).select(*columns).mapInArrow(_single_windows, "g long, key long, s0 long, s1 long, window long")
    single = scratch.written(single, "windows")
    twice = single.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "key")
    large = single.join(twice, ["g", "key"], "left_semi").groupBy("s0", "s1").agg(F.flatten(F.collect_set(F.array("window", F.col("window") + LENGTH))).alias("spans"))
    settled = small.unionByName(large)
    straight = sorted_out.filter(F.col("done") >= LENGTH).select("s0", "s1", F.array(F.lit(0).cast("long"), F.col("done").cast("long")).alias("spans"))
    covered = straight.unionByName(settled).groupBy("s0", "s1").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    places = distinct.select("s0", "s1", F.col("places").alias("n"))
    placed = salted_join(rows.select("t0", "t1", "start", "s0", "s1"), covered, ["s0", "s1"], "t0", places)
    shifted = placed.select("t0", "t1", F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
    together = shifted.groupBy("t0", "t1").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = written(together.mapInArrow(_merged_spans, "t0 long, t1 long, spans array<long>"), "spans")
    scratch.clear()
    return spans


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Every byte covered by a 200-byte string that also starts anywhere else in the texts, the same
    one included, is removed; strings are judged on the input. A null text counts as empty. Texts
    under 200 bytes lose nothing. Repeated rows repeat each other, so they lose all bytes. Null
    keys stay as they are; an empty table gives an empty result.
    """
    value = text_or_empty(F.col(text))
    rows = df.select(F.col(key).alias("key"), value.alias("t"), F.xxhash64(value).alias("t0"), F.xxhash64(F.lit("t"), value).alias("t1"))
    spans = repeated_spans(rows.select("t0", "t1", "t"))
    copied = rows.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t0", "t1", F.lit(True).alias("copied"))
    marks = written(spans.join(copied, ["t0", "t1"], "full").select("t0", "t1", "copied", F.when(F.col("copied").isNull(), F.col("spans")).alias("spans")), "marks")
    drop_written(spans)
    volume = marks.agg(F.sum(24 + 8 * F.coalesce(F.size("spans"), F.lit(0)))).first()[0] or 0
    small = F.broadcast if volume <= BROADCAST_BYTES else lambda x: x
    kind = rows.schema["key"].dataType.simpleString()
    marked = rows.join(small(marks), ["t0", "t1"], "left").select("key", "t", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    cut = marked.mapInArrow(_cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumnRenamed("key", key)


def op8_lcp_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every 200-byte string by its md5, the bytes of those that start twice as islands, what is left hashed together.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT rid, k, md5(b[k:k + 199]) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS k FROM d WHERE octet_length(b) >= 200)),
r AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
i AS (SELECT rid, k, sum(CASE WHEN before IS NULL OR k - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS g FROM (SELECT rid, k, lag(k) OVER (PARTITION BY rid ORDER BY k) AS before FROM r)),
g AS (SELECT rid, g, min(k) AS a, max(k) + 199 AS z FROM i GROUP BY rid, g),
o AS (SELECT rid, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM g GROUP BY rid)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(list_reduce(list_transform(range(n_spans + 1), lambda j: b[(CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END):(CASE WHEN j = n_spans THEN octet_length(b) ELSE a[j + 1] - 1 END)]), lambda x, y: x || y)) END AS kept_sha256
FROM d LEFT JOIN o USING (rid)
"""
