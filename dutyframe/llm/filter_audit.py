"""How filters interact: every order of them, applied along the trie of their permutations.

The orders of n filters are the paths of a trie; what survives a set of filters doesn't depend on their
order, so all nodes with one unordered set share one state. The trie is walked depth first: a state's
survivors are a persisted DataFrame made from its parent's by one more filter, the removals at each of
its edges are counted there, and a state that was met before is taken from the memo, not made again.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm.common import WORD, Scratch, table, text_or_empty, word_count
from dutyframe.llm.lookup import counted, lookup

#: n filters have 2**n states, each of which is a Spark job, and n! orders.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of one text that need no other rows: too short, repetitive, shouting, symbols.

    Words are case-sensitive; a text without words isn't repetitive, an empty one isn't shouting.
    """
    words = word_count(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))))
    return {
        "A": words < 100,
        "B": 100 * distinct < 80 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(documents: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "lang") -> DataFrame:
    """A short row for each document (a written table): part, a boolean for each of the filters A to E, good and toxic.

    E: some row of the whole table with a smaller doc_id has the same text, removed or not. Texts are compared
    by SHA-256; a null text is empty. A null doc_id is neither smaller nor larger than another. part: null is
    the empty string. A document is good (toxic) if any label row of its doc_id has quality (toxic) 1; one without labels is
    neither. Repeated rows count each. Other columns are never read.
    """
    text = text_or_empty(F.col("text"))
    own = [c.alias(name) for name, c in text_filters(text).items()]
    first = documents.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *own)
    base = scratch.written(first, "audit-texts")
    rows = base.count()
    groups = base.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
    told = scratch.written(lookup(base, groups, ["digest"], "n", rows).drop("digest"), "audit-copies")
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    labelled = lookup(told, counted(told, marks, ["doc_id"], rows), ["doc_id"], "__n", rows)
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return scratch.written(labelled.select("part", "A", "B", "C", "D", copy.alias("E"), yes("good"), yes("toxic")), "audit-verdicts")


def walk(root: DataFrame, filters: Mapping[str, Column], keys: list[str], counts: Mapping[str, Column], scratch: Scratch) -> DataFrame:
    """A row for each keys, state and filter not in it (an edge of the trie): survivors of the state, and of those that the filter removes the counts.

    filters: failure conditions by name, one letter each. state: the letters of the filters applied, sorted. Only the path from
    the root is persisted at a time: a state's survivors are let go once all states below it are counted.
    The counts of a state are written before its children are walked, so a lost executor costs the recount of one
    state, from the survivors above it, whose own lineage is filters over a written table.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have 2**{len(filters)} states; at most {MOST_FILTERS} are walked")
    memo: dict[frozenset, DataFrame] = {}

    def visit(applied: frozenset, survivors: DataFrame) -> None:
        survivors.persist()
        try:
            edges = []
            for name in filters:
                if name not in applied:
                    fails = filters[name]
                    edges += [F.count_if(fails).alias(f"{name}_removed"), *[F.count_if(fails & c).alias(f"{name}_{what}") for what, c in counts.items()]]
            told = survivors.groupBy(*keys).agg(F.count(F.lit(1)).alias("survivors"), *edges)
            memo[applied] = scratch.written(told, "audit-state")
            for name in filters:
                if name not in applied and applied | {name} not in memo:
                    visit(applied | {name}, survivors.filter(~filters[name]))
        finally:
            survivors.unpersist()

    visit(frozenset(), root)
    out = None
    for applied, told in memo.items():
        state = F.lit("".join(sorted(applied))).alias("state")
        open_ = [n for n in filters if n not in applied]
        at = lambda n: F.struct(F.lit(n).alias("filter"), F.col(f"{n}_removed").alias("removed"), *[F.col(f"{n}_{w}").alias(w) for w in counts])
        end = F.struct(F.lit(None).cast("string").alias("filter"), *[F.lit(None).cast("long").alias(w) for w in ("removed", *counts)])
        edges = told.select(*keys, state, "survivors", F.explode(F.array(*[at(n) for n in open_]) if open_ else F.array(end)).alias("e")).select(*keys, "state", "survivors", "e.*")
        out = edges if out is None else out.unionByName(edges)
    return out


def orders(parts: DataFrame, names: str) -> DataFrame:
    """parts with a row for each order of the filters and step in it: filter_order, step, filter, and the states before and after."""
    every = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in itertools.permutations(names)])))
    every = every.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    state = lambda n: F.array_join(F.array_sort(F.split(F.substring(F.col("filter_order"), F.lit(1), n), "")), "")
    return every.withColumns({"filter": F.substring(F.col("filter_order"), F.col("step"), F.lit(1)), "state": state(F.col("step") - 1), "after": state(F.col("step"))})


def audit(root: DataFrame, scratch: Scratch, names: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step, zeros included: what the filter removes there, and what it shares with the others.

    root: rows with part, a boolean for each name (true: it fails that filter), good and toxic.
    kept: left after the step; removed: removed by it; redundant: failing its filter but removed before;
    unique_fails: failing its filter only, which are those that it removes when it comes last; good_lost,
    toxic_lost: labelled ones among the removed; shapley: the removals of its filter summed over all orders.
    An empty root gives an empty result. Parts are grouped by partial counts, so a part may hold any share of the rows.
    """
    filters = {n: F.col(n) for n in names}
    edges = scratch.written(walk(root, filters, ["part"], {"good": F.col("good"), "toxic": F.col("toxic")}, scratch), "audit-edges")
    moves = edges.filter("filter is not null").drop("survivors")
    failing = moves.filter("state = ''").select("part", "filter", F.col("removed").alias("failing"))
    before = F.length("state")
    alone = moves.filter(before == len(names) - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    # an edge lies on as many orders as there are ways to come to its state and to go on from it
    ways = F.factorial(before) * F.factorial(F.lit(len(names) - 1) - before)
    value = moves.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    left = edges.groupBy("part", F.col("state").alias("after")).agg(F.max("survivors").alias("kept"))
    full = orders(edges.select("part").distinct(), names)
    # a part that a state has emptied has no row there: its counts are zero
    for more, on in ((moves, ["part", "state", "filter"]), (left, ["part", "after"]), (failing, ["part", "filter"]), (alone, ["part", "filter"]), (value, ["part", "filter"])):
        full = full.join(more, on, "left")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    removed = F.coalesce("removed", F.lit(0))
    return full.select(
        "part", "filter_order", "step", zero("kept", "kept"), zero("removed", "removed"), (F.coalesce("failing", F.lit(0)) - removed).cast("long").alias("redundant"),
        zero("unique_fails", "unique_fails"), zero("good", "good_lost"), zero("toxic", "toxic_lost"), zero("shapley", "shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the filters A to E over all documents, by language."""
    scratch = Scratch()
    return audit(verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch), scratch)


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {{
    'A': len({_WORDS}) < 100, 'B': 100 * len(list_distinct({_WORDS})) < 80 * len({_WORDS}),
    'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first_id < doc_id, false)}} AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, letters WHERE NOT contains(filter_order, f)),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step:step] AS f, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
per_row AS (SELECT part, filter_order, step, f, good, toxic, fails[f] AS failing,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND coalesce(fails[x], false))) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AS only_one FROM v, steps),
counts AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
    count(*) FILTER (failing AND only_one) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost FROM per_row GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counts
"""
