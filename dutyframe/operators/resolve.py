"""Entity resolution: one entity for the spellings and keys that mean the same.

Lookups are joins against stored state; within a batch, labels are handed from earlier drafts to later
ones, so that a draft finds the entity an earlier one made, without a sequential pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.functions.text import matching_key
from dutyframe.operators.scan import Segments
from dutyframe.operators.tables import large, written


def match(drafts: DataFrame, external_ids: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """drafts with entity_id: by foreign key, else (identity `name` only) by name, else by alias; null for new ones.

    drafts: source_id, local_id, kind, name_folded, identity. Keys match within a kind. Where
    several entities match, the smallest id is taken.
    """
    by_key, by_name, by_alias = _stored(external_ids, entities, aliases)
    found = drafts.join(by_key, ["source_id", "local_id", "kind"], "left").join(by_name, ["kind", "name_folded"], "left").join(by_alias, ["kind", "name_folded"], "left")
    loose = F.when(F.col("identity") == "name", F.coalesce("id_by_name", "id_by_alias"))
    return found.withColumn("entity_id", F.coalesce("id_by_key", loose)).drop("id_by_key", "id_by_name", "id_by_alias")


def _stored(external_ids: DataFrame, entities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The smallest stored id for each key, name and alias."""
    kinds = entities.select(F.col("id").alias("entity_id"), F.col("kind").alias("key_kind"))
    by_key = external_ids.join(large(kinds), "entity_id").groupBy(F.col("scheme").alias("source_id"), F.col("value").alias("local_id"), F.col("key_kind").alias("kind")).agg(F.min("entity_id").alias("id_by_key"))
    by_name = entities.groupBy("kind", "name_folded").agg(F.min("id").alias("id_by_name"))
    named = aliases.join(large(kinds), "entity_id")
    by_alias = named.groupBy(F.col("key_kind").alias("kind"), F.col("alias_folded").alias("name_folded")).agg(F.min("entity_id").alias("id_by_alias"))
    return by_key, by_name, by_alias


def with_new_ids(matched: DataFrame, base: int) -> DataFrame:
    """matched with an entity_id everywhere, and is_new: drafts of one identity share a new id above base.

    An identity is (kind, folded name) where names identify, else (source, local id). Ids follow the
    order of the identities; groups are numbered within ranges, whose sizes give each its start.
    """
    identity = F.when(F.col("identity") == "name", F.concat_ws("\x1f", F.lit("n"), "kind", "name_folded")).otherwise(F.concat_ws("\x1f", F.lit("k"), "kind", "source_id", "local_id"))
    rows = matched.withColumn("__who", identity)
    fresh = rows.filter("entity_id is null").groupBy("__who").agg(F.count(F.lit(1)).alias("__n"))
    ranged = fresh.select("__who").sort("__who").withColumn("__row", F.monotonically_increasing_id())
    ids = dense_ids(ranged, "__row", "__new", base)
    joined = rows.join(ids, "__who", "left")
    return joined.withColumn("is_new", F.col("entity_id").isNull()).withColumn("entity_id", F.coalesce("entity_id", "__new")).drop("__who", "__new")


#: Labels of stored entities lie below those of new ones, which are the places of the drafts that make them.
_STORED = 1 << 62


def settle(drafts: DataFrame, external_ids: DataFrame, entities: DataFrame, aliases: DataFrame, base: int, order: list[str]) -> DataFrame:
    """drafts with entity_id, is_new (the draft that makes its entity) and __order, as if they had come one after the other.

    drafts: source_id, local_id, kind, name_folded, identity; order: columns that tell which comes first (rows that
    tie are taken in the order of the others). A draft finds its entity

    1. by its key (source, local id, kind), stored or of an earlier draft;
    2. else, where names identify, by its name: of the stored entities of that name and those that an earlier draft
       of the batch has called so, whatever its identity, the one made first;
    3. else by a stored alias (the smallest id).

    If it finds none it makes one; new ids follow base in the order of the drafts that make them. A null in key or name
    is a value like others. So a key's first draft decides for all of them, and the entity of a first draft is that of an earlier key or its own: labels are handed
    down from earlier keys to later ones in rounds, as many as names are passed on from key to key. One name's keys are a
    running minimum in the order of their first use, which is cut where a name is very common.
    """
    key, name = ["source_id", "local_id", "kind"], ["kind", "name_folded"]
    others = [c for c in (*key, "name_folded", "identity", "snapshot_id", "payload", "name") if c in drafts.columns and c not in order]
    placed = written(drafts.sort(*order, *others).withColumn("__order", F.monotonically_increasing_id()), "drafts")
    by_key, by_name, by_alias = _stored(external_ids, entities, aliases)

    def left(rows: DataFrame, more: DataFrame, on: list[str], kept: list[str]) -> DataFrame:
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in on]
        return rows.alias("d").join(large(more).alias("o"), same, "left").select("d.*", *[F.col(f"o.{c}") for c in kept])

    said = written(placed.groupBy(*key, "name_folded", "identity").agg(F.min("__order").alias("__use")), "said")
    # from here on a key is the place of its first draft, a name that of its first use
    first = said.groupBy(*key).agg(F.min_by(F.struct("name_folded", "identity", F.col("__use").alias("__key")), "__use").alias("f")).select(*key, "f.*")
    known = left(left(left(first, by_key, key, ["id_by_key"]), by_name, name, ["id_by_name"]), by_alias, name, ["id_by_alias"])
    label = lambda c: F.col(c) - _STORED
    own = F.when(F.col("id_by_key").isNotNull(), label("id_by_key")).when(F.coalesce(F.col("identity") != "name", F.lit(True)), F.col("__key"))
    keyed = known.select(*key, "__key", own.isNotNull().alias("settled"), own.alias("label"), label("id_by_name").alias("named"), F.coalesce(label("id_by_alias"), F.col("__key")).alias("otherwise"))
    keyed = written(keyed, "keys")
    # a key counts for a name from its first draft of that name on
    uses = left(said.groupBy(*key, "name_folded").agg(F.min("__use").alias("__use")), keyed, key, ["__key"])
    uses = written(left(uses, said.groupBy(*name).agg(F.min("__use").alias("__name")), name, ["__name"]).select("__key", "__name", "__use"), "uses")
    known, cuts = keyed.drop(*key), Segments(uses, ["__name"], ["__use"])  # which names are cut is the same in all rounds
    while True:
        told = uses.join(large(known), "__key")
        rows = Segments(written(told, "told") if cuts.cut else told, ["__name"], ["__use"], within=cuts)
        before = rows.scan("__earlier", F.col("label"), "min", before=True).scan("__any", F.lit(1), "max", before=True).rows()
        seen = before.filter("__use = __key")  # what a key's first draft finds
        by_use = F.when(F.col("__any").isNull(), F.coalesce("named", "otherwise")).otherwise(F.least("__earlier", "named"))
        after = seen.withColumns({"__was": F.col("label"), "label": F.when(F.col("settled"), F.col("label")).otherwise(by_use)})
        after = written(after.drop("__name", "__use", "__earlier", "__any"), "labels")
        known = after.drop("__was")
        if after.filter(~F.col("label").eqNullSafe(F.col("__was"))).isEmpty():
            break
    fresh = known.filter("label >= 0").select("label").distinct().sort("label").withColumn("__row", F.monotonically_increasing_id())
    ids = dense_ids(written(fresh, "labels"), "__row", "__id", base)
    final = left(keyed.select(*key, "__key").join(large(known.select("__key", "label")), "__key"), ids.select("label", "__id"), ["label"], ["__id"])
    final = final.select(*key, "label", F.coalesce("__id", F.col("label") + _STORED).alias("entity_id"))
    out = left(placed, final, key, ["label", "entity_id"])
    return written(out.withColumn("is_new", F.col("label") == F.col("__order")).drop("label"), "settled")


def dense_ids(rows: DataFrame, running: str, name: str, base: int) -> DataFrame:
    """rows with name instead of running, a monotonically increasing id: base + 1, base + 2, ... in its order.

    The sizes of the partitions that such an id tells give each its start; no task sees more than its own rows.
    """
    part = F.shiftrightunsigned(running, 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    placed = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.lit(base) + 1 + F.col("__start") + F.col(running) % (1 << 33)).drop(running, "__part", "__start")


def upsert(entities: DataFrame, batch: DataFrame, fill: list[str], order: str) -> DataFrame:
    """entities after a batch (columns id, name, the fill columns, and an order of arrival).

    The last name is taken; of every other column the last known value, and a known value is never
    overwritten by null. Other columns of stored rows stay.
    """
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(f"__{c}") for c in ["name", *fill]]
    grouped = batch.groupBy("id").agg(*last)
    joined = entities.join(grouped, "id", "full")
    changed = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in ["name", *fill]}
    return joined.withColumns(changed).withColumn("name_folded", matching_key(F.col("name"))).select(*entities.columns)


def first_aliases(found: DataFrame) -> DataFrame:
    """entity_id, alias, alias_folded: of the spellings with one folded form the first by `seq` is kept."""
    folded = found.withColumn("alias_folded", matching_key(F.col("alias")))
    return folded.groupBy("entity_id", "alias_folded").agg(F.min_by("alias", F.struct("seq", "alias")).alias("alias")).select("entity_id", "alias", "alias_folded")
