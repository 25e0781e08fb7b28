from __future__ import annotations

import random

import pytest

from dutyframe.operators import resolve, scan

DRAFT = "source_id string, local_id string, kind string, name_folded string, identity string, at int, name string"


def one_by_one(drafts, entities, keys, aliases):
    """Each draft in turn against what is known by then; new entities are numbered as they come."""
    kinds = dict((e, k) for e, k, _ in entities)
    by_key, by_name, by_alias = {}, {}, {}
    keep = lambda d, k, v: d.__setitem__(k, min(v, d.get(k, v)))
    for e, k, n in entities:
        keep(by_name, (k, n), e)
    for e, s, v in keys:
        keep(by_key, (s, v, kinds[e]), e)
    for e, a in aliases:
        keep(by_alias, (kinds[e], a), e)
    out, free = [], max([e for e, _, _ in entities], default=0) + 1
    for s, v, k, n, identity, *_ in drafts:
        found = by_key.get((s, v, k))
        if found is None and identity == "name":
            found = by_name.get((k, n), by_alias.get((k, n)))
        made = found is None
        if made:
            found, free = free, free + 1
        by_key.setdefault((s, v, k), found)
        keep(by_name, (k, n), found)  # whoever is called so from now on, the first made counts
        out.append((found, made))
    return out


def draw(seed, n):
    r = random.Random(seed)
    entities = [(e, r.choice("hp"), f"N{r.randrange(12)}") for e in range(1, 9)]
    keys = [(e, "s", f"k{r.randrange(30)}") for e in range(1, 9)]
    keys = list({(s, v): (e, s, v) for e, s, v in keys}.values())
    aliases = [(r.randrange(1, 9), f"N{r.randrange(20)}") for _ in range(9)]
    rows = [(r.choice(["s", "s", "t", None]), r.choice([f"k{r.randrange(30)}", None]), r.choice("hp"), r.choice([f"N{r.randrange(20)}", "N1", None]), r.choice(["name", "name", "source_key", None]), k, "x") for k in range(n)]
    return rows, entities, keys, aliases


@pytest.mark.parametrize(("seed", "n", "most"), [(1, 60, 10**6), (2, 160, 10**6), (3, 120, 4), (4, 0, 10**6)])
def test_a_batch_equals_one_by_one(spark, monkeypatch, seed, n, most):
    """Nulls in keys and names, names passed on from key to key; the third time common names are cut into segments."""
    monkeypatch.setattr(scan, "ROWS_IN_A_TASK", most)
    rows, entities, keys, aliases = draw(seed, n)
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    shuffled = random.Random(seed).sample(rows, len(rows))
    found = resolve.settle(
        frame(shuffled, DRAFT), frame(keys, "entity_id long, scheme string, value string"), frame(entities, "id long, kind string, name_folded string"), frame(aliases, "entity_id long, alias_folded string"), 8, ["at"]
    ).orderBy("at")
    assert [(r["entity_id"], r["is_new"]) for r in found.collect()] == one_by_one(rows, entities, keys, aliases)


def test_a_name_finds_what_a_key_has_made(spark):
    """Without stored state: a keyed draft makes an entity, a named one finds it, and the named one's key leads there from then on."""
    rows = [("s", "1", "h", "A", "source_key", 0, ""), ("s", "2", "h", "A", "name", 1, ""), ("s", "2", "h", "B", "name", 2, ""), ("s", "3", "h", "B", "name", 3, ""), ("s", "4", "h", "A", "source_key", 4, ""), ("s", "5", "p", "A", "name", 5, "")]
    none = lambda schema: spark.createDataFrame([], schema)
    found = resolve.settle(spark.createDataFrame(rows, DRAFT), none("entity_id long, scheme string, value string"), none("id long, kind string, name_folded string"), none("entity_id long, alias_folded string"), 0, ["at"])
    assert [(r["entity_id"], r["is_new"]) for r in found.orderBy("at").collect()] == [(1, True), (1, False), (1, False), (1, False), (2, True), (3, True)]


def test_rounds_are_one_pass_each(spark, monkeypatch):
    """A name handed on through nine keys: a round writes its labels alone, rows of numbers that no key or name is part of; what is large was counted before."""
    tables, counts, kept, cut = [], [], resolve.written, scan.Segments.__init__
    monkeypatch.setattr(resolve, "written", lambda df, name: (tables.append((name, {t for _, t in df.dtypes})), kept(df, name))[1])
    monkeypatch.setattr(scan.Segments, "__init__", lambda self, *a, **k: (counts.append(k.get("within") is None), cut(self, *a, **k))[1])
    rows = [("s", "0", "h", "N0", "source_key", 0, "")]
    for k in range(1, 10):
        rows += [("s", f"{k}", "h", f"N{k - 1}", "name", 2 * k, ""), ("s", f"{k}", "h", f"N{k}", "name", 2 * k + 1, "")]
    none = lambda schema: spark.createDataFrame([], schema)
    found = resolve.settle(spark.createDataFrame(rows, DRAFT), none("entity_id long, scheme string, value string"), none("id long, kind string, name_folded string"), none("entity_id long, alias_folded string"), 0, ["at"])
    assert [(r["entity_id"], r["is_new"]) for r in found.orderBy("at").collect()] == [(1, True)] + [(1, False)] * 18
    rounds = [kinds for name, kinds in tables if name == "labels" and "boolean" in kinds]
    assert len(rounds) == 10 and all(kinds == {"bigint", "boolean"} for kinds in rounds) and "told" not in {name for name, _ in tables} and counts.count(True) == 1
