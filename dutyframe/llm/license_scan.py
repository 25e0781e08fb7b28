"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Templates are short license notices, blocks the lines of a text and, as a notice may be wrapped
anywhere, the stretches of words across line ends that are as long as the template. Lines without
words are passed over. A block holds a template if it has at least THRESHOLD of the template's distinct words. With the words in order of their
frequency in the whole corpus, rarest first, such a block and the template share one of the first
|T| - a + 1 words of the template and one of the first |B| - a + 1 of the block, where a is the
number of common words needed; the places of that word bound how many more can be shared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import table, text_or_empty, written

THRESHOLD = 0.8
# The phrases and labels of the base, and the notices that the join looks for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
]
#: Bytes of templates in all that the driver and each task may hold.
TEMPLATE_BYTES = 1_000_000
#: A word once A-Z is lower-cased; on a text as it is, upper-case letters are words' letters too.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def templates_from(rows: DataFrame, label: str = "label", text: str = "text") -> list[tuple[str, str]]:
    """The templates of a table, whole license texts for instance, for scan(); rows with nulls or without words are none.

    A table of more than TEMPLATE_BYTES is refused, as templates go to every task.
    """
    if (rows.agg(F.sum(F.octet_length(text))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"the templates have more than {TEMPLATE_BYTES} bytes")
    found = rows.select(F.col(label).alias("l"), F.array_join(words_of(F.col(text)), " ").alias("t")).filter("l is not null and t != ''")
    return sorted({(r["l"], r["t"]) for r in found.collect()})


def places(words: Column, phrase: str) -> Column:
    """The starts of all places where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(k: Column) -> Column:
        found = F.get(words, k) == parts[0]
        for n, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, k + n) == part)
        return found

    many = F.size(words) - len(parts)
    return F.when(many >= 0, F.filter(F.sequence(F.lit(0), F.greatest(many, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def holds_word(text: Column, words: list[str]) -> Column:
    """Whether the text has one of the words; ASCII letters in any case."""
    return text.rlike(r"(?i)(?:^|" + GAP + ")(?:" + "|".join(words) + ")(?:$|" + GAP + ")")


def word_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in all texts (column t); the result has that many rows."""
    words = texts.select(F.explode(F.split(F.lower("t"), GAP)).alias("w")).filter(F.col("w").isin(vocabulary))
    counted = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def template_matches(texts: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """k, h, label, block, containment: every template that a line of a text (columns k, h, t), or a stretch of words across its end, holds."""
    sets = [sorted(set(text.split())) for _, text in templates]
    vocabulary = sorted({w for s in sets for w in s})
    counts = word_frequencies(texts, vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts[w], w)))}
    spark = texts.sparkSession
    rows = []
    for k, s in enumerate(sets):
        ordered = sorted(rank[w] for w in s)
        need = math.ceil(threshold * len(s) - 1e-9)
        rows += [(token, k, at, len(s), need, ordered, templates[k][0], len(templates[k][1].split())) for at, token in enumerate(ordered[: len(s) - need + 1])]
    index = spark.createDataFrame(rows, "token int, template int, at int, size int, need int, tokens array<int>, label string, words int")
    rare = sorted({vocabulary_word for vocabulary_word, r in rank.items() if r in {row[0] for row in rows}})
    longest, least = max(row[-1] for row in rows), min(row[4] for row in rows)
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])

    def line_ranks(line: Column) -> Column:
        own = F.transform(words_of(line), lambda w: F.coalesce(ranks[w], F.lit(-1)))
        return F.struct(F.size(own).alias("n"), own.alias("own"))

    def across(at: Column) -> Column:
        """The last words of a line and the first of those after it; each of the latter has a word, which bounds their number."""
        last = F.get("lines", at)["own"]
        first = F.flatten(F.transform(F.slice("lines", at + 2, longest), lambda line: F.slice(line["own"], 1, longest)))
        return F.concat(F.slice(last, F.greatest(F.size(last) - longest + 1, F.lit(1)), longest), F.slice(first, 1, longest))

    def distinct(own: Column) -> Column:
        return F.array_sort(F.filter(F.array_distinct(own), lambda r: r >= 0))

    lines = texts.filter(holds_word(F.col("t"), rare)).select("k", "h", F.filter(F.transform(F.split("t", r"\n"), line_ranks), lambda line: line["n"] > 0).alias("lines"))
    own = F.transform("lines", lambda line: F.struct(distinct(line["own"]).alias("own"), F.lit(None).cast("array<int>").alias("stretch")))
    ends = F.transform(F.filter(F.transform("lines", lambda _, at: at), lambda at: at < F.size("lines") - 1), lambda at: across(at))
    wrapped = F.transform(ends, lambda x: F.struct(distinct(x).alias("own"), x.alias("stretch")))
    blocks = lines.select("k", "h", F.posexplode(F.concat(own, wrapped)).alias("block", "b")).select("k", "h", "block", "b.own", "b.stretch").filter(F.size("own") >= least)
    # the index has a row for each template and prefix word, a fixed list
    tokens = blocks.select("k", "h", "block", "stretch", "own", F.posexplode("own").alias("place", "token"))
    met = tokens.join(F.broadcast(index), "token").filter(F.size("own") >= F.col("need"))  # length
    met = met.filter(F.col("place") <= F.size("own") - F.col("need"))  # the block's own prefix
    left = F.least(F.col("size") - F.col("at"), F.size("own") - F.col("place"))
    met = met.filter(left + F.least("at", "place") >= F.col("need"))  # position: what can stand before and after
    met = met.select("k", "h", "block", "template", "label", "own", "stretch", "words", "tokens", "size", "need").dropDuplicates(["k", "h", "block", "template"])
    starts = F.sequence(F.lit(1), F.greatest(F.size("stretch") - F.col("words") + 1, F.lit(1)))
    windows = F.transform(starts, lambda at: F.size(F.array_intersect(F.slice("stretch", at, F.col("words")), "tokens")))
    met = met.withColumn("common", F.when(F.col("stretch").isNull(), F.size(F.array_intersect("own", "tokens"))).otherwise(F.array_max(windows)))
    common = F.col("common")
    return met.filter(common >= F.col("need")).select("k", "h", "block", "label", (common / F.col("size")).alias("containment"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score is 1 where a base phrase stands, else the best containment of a template (0: none). A
    null text counts as empty: no words, no labels (empty text), score 0. Repeated rows and null
    keys get one result row each. An empty table gives an empty result.
    """
    value = text_or_empty(F.col(text))
    rows = df.select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.xxhash64(value).alias("h"), value.alias("t"))
    matches = template_matches(rows.select("k", "h", "t"), templates or TEMPLATES, threshold)
    by_text = written(matches.groupBy("k", "h").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")), "matches")
    ends = sorted({p.split()[-1] for p in PHRASES})
    words = words_of(F.col("t"))
    suspect = holds_word(F.col("t"), ends)
    found = F.transform(F.array(*[F.struct(places(F.col("words"), p).alias("at"), F.lit(label).alias("label")) for p, label in PHRASES.items()]), lambda s: s)
    base = rows.withColumn("words", F.when(suspect, words))
    base = base.withColumn("found", F.when(F.col("words").isNotNull(), F.filter(found, lambda s: F.size(s["at"]) > 0)).otherwise(F.array().cast("array<struct<at:array<int>,label:string>>")))
    base = base.withColumn("starts", F.flatten(F.transform("found", lambda s: s["at"])))
    base = base.select(
        key,
        "k",
        "h",
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("found", lambda s: s["label"]))).alias("base"),
    )
    joined = base.join(by_text, ["k", "h"], "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        key,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', '{t}')" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{gap}'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT * FROM (VALUES {phrases}) v(phrase, label)),
b AS (
  SELECT rid, label, k - 1 AS pos FROM w, p, unnest(range(1, len(ws) + 1)) r(k)
  WHERE contains(t, split_part(phrase, ' ', 1)) AND list_slice(ws, k, k + len(string_split(phrase, ' ')) - 1) = string_split(phrase, ' ')),
lines AS (SELECT DISTINCT rid, unnest(string_split(t, chr(10))) AS line FROM d WHERE contains(t, 'licen') OR contains(t, 'permi') OR contains(t, 'redis')),
sets AS (SELECT rid, list_distinct(string_split_regex(line, '{gap}')) AS ws FROM lines),
tpl AS (SELECT id, label, list_distinct(string_split(body, ' ')) AS ts FROM (VALUES {templates}) v(id, label, body)),
m AS (
  SELECT rid, label, len(list_intersect(ws, ts)) / len(ts) AS c FROM sets, tpl
  WHERE len(list_intersect(ws, ts)) >= ceil({THRESHOLD} * len(ts) - 1e-9)),
bb AS (SELECT rid, count(*) AS n, min(pos) AS f, max(pos) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY rid),
mm AS (SELECT rid, max(c) AS best FROM m GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(bb.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN bb USING (rid) LEFT JOIN mm USING (rid) LEFT JOIN al USING (rid)
"""


ORACLE = _oracle()
