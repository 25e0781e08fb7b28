"""Strict matching of names to candidates with coordinates: one candidate or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyframe.functions.geo import in_attica, point_of_wkt
from dutyframe.functions.text import fold
from dutyframe.operators.tables import written

LEAST_LETTERS = 4
RESPONSE = "struct<results:struct<bindings:array<struct<item:struct<value:string>,label:struct<value:string>,alias:struct<value:string>,coord:struct<value:string>>>>>"


def distinctive_words(name: Column) -> Column:
    """array<struct<word, abbreviated>> of the words in guillemets; null under four letters or without them.

    A word before a full stop is an abbreviation, which matches by its beginning.
    """
    inside = F.regexp_extract(name, "«([^»]*)»", 1)
    parts = F.filter(F.split(inside, r"\s+"), lambda p: fold(p) != "")

    def words(part: Column) -> Column:
        own = F.split(fold(part), " ")
        return F.transform(own, lambda w, k: F.struct(w.alias("word"), (part.endswith(".") & (k == F.size(own) - 1)).alias("abbreviated")))

    found = F.flatten(F.transform(parts, words))
    letters = F.aggregate(found, F.lit(0), lambda n, w: n + F.length(w["word"]))
    return F.when((inside != "") & (letters >= LEAST_LETTERS), found)


def holds_all(wanted: Column, known: Column) -> Column:
    """Whether every wanted word is among the known ones, an abbreviation as the beginning of one."""
    return F.forall(wanted, lambda w: F.exists(known, lambda k: F.when(w["abbreviated"], k.startswith(w["word"])).otherwise(k == w["word"])))


def candidates(responses: DataFrame, column: str = "json") -> DataFrame:
    """qid, names, lat, lon from query responses: a row per item, its first readable point, its names in order."""
    rows = responses.select(F.posexplode(F.from_json(column, RESPONSE)["results"]["bindings"]).alias("pos", "b"))
    rows = rows.select("pos", F.regexp_extract("b.item.value", "([^/]*)$", 1).alias("qid"), F.array_compact(F.array("b.label.value", "b.alias.value")).alias("names"), point_of_wkt(F.col("b.coord.value")).alias("point")).filter("point is not null")
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "names"))), lambda r: r["names"]))
    return rows.groupBy("qid").agg(F.array_distinct(lists).alias("names"), F.min_by("point", "pos").alias("p")).select("qid", "names", "p.lat", "p.lon")


def match_places(entities: DataFrame, places: DataFrame, region: bool = True) -> DataFrame:
    """id, outcome (located, ambiguous, unmatched), qid, lat, lon for entities (id, name).

    A place counts if all distinctive words of the name are among the words of one of its names.
    Words that stand whole are looked up by equality, abbreviated ones through the first letters of words; each name by its rarest
    word alone, and equal names once.
    """
    if region:
        places = places.filter(in_attica(F.col("lat"), F.col("lon")))
    named = written(entities.select("id", distinctive_words(F.col("name")).alias("wanted")), "named")
    # equal names are looked for once, and equal names of places are one that tells its least and its greatest place
    asked = written(named.filter("wanted is not null").select("wanted").distinct().withColumn("ask", F.monotonically_increasing_id()), "asked")
    words = places.select("qid", "lat", "lon", F.explode("names").alias("name")).select("qid", "lat", "lon", F.array_sort(F.array_distinct(F.split(fold(F.col("name")), " "))).alias("known"))
    known = written(words.groupBy("known").agg(F.min(F.struct("qid", "lat", "lon")).alias("p"), F.max("qid").alias("last")).withColumn("spelling", F.monotonically_increasing_id()), "known")
    # of the words of a name the one that fewest spellings hold is the key of the lookup; one that none holds settles it
    keyed = asked.select("ask", F.explode(F.array_distinct("wanted")).alias("w")).select("ask", F.when(F.col("w.abbreviated"), F.length("w.word")).otherwise(F.lit(-1)).alias("size"), "w.word")
    whole = known.select("spelling", F.explode("known").alias("word")).withColumn("size", F.lit(-1))
    # beginnings only as long as one that is looked for; lengths of words are few, and one row holds them
    lengths = keyed.filter("size > 0").agg(F.collect_set("size").alias("sizes"))
    begun = known.select("spelling", F.explode("known").alias("w")).join(F.broadcast(lengths), F.lit(True)).withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("w"))))
    begun = begun.withColumn("word", F.expr("substring(w, 1, size)")).drop("w", "sizes").distinct()
    lookup = written(whole.unionByName(begun, allowMissingColumns=True), "words")
    held = lookup.groupBy("size", "word").agg(F.count(F.lit(1)).alias("held"))
    rarest = keyed.join(held, ["size", "word"], "left").groupBy("ask").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "size", "word")).alias("k")).filter("k.held > 0")
    pairs = rarest.select("ask", "k.size", "k.word").join(lookup, ["size", "word"]).select("ask", "spelling")
    met = pairs.join(asked, "ask").join(known, "spelling").filter(holds_all(F.col("wanted"), F.col("known")))
    counted = met.groupBy("ask").agg(F.min("p").alias("p"), F.max("last").alias("last")).withColumn("n", F.when(F.col("p.qid") == F.col("last"), 1).otherwise(2))
    found = written(asked.join(counted, "ask").select("wanted", "n", "p"), "found")
    joined = named.join(found, "wanted", "left")
    one = F.col("n") == 1
    outcome = F.when(one, "located").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return joined.select("id", outcome.alias("outcome"), *[F.when(one, F.col(f"p.{c}")).alias(c) for c in ("qid", "lat", "lon")])


def lacking_place(entities: DataFrame, kind: str = "hospital") -> DataFrame:
    return entities.filter((F.col("kind") == kind) & (F.col("lat").isNull() | F.col("lon").isNull()))


def set_places(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """entities with the matched places and where they come from; known coordinates stay."""
    found = matches.filter("outcome = 'located'").select("id", F.col("qid").alias("__qid"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    joined = entities.join(found, "id", "left")
    new = F.col("__qid").isNotNull() & (F.col("lat").isNull() | F.col("lon").isNull())
    return joined.withColumns({"lat": F.when(new, F.col("__lat")).otherwise(F.col("lat")), "lon": F.when(new, F.col("__lon")).otherwise(F.col("lon")), "location_source": F.when(new, F.concat(F.lit("wikidata:"), "__qid")).otherwise(F.col("location_source"))}).drop("__qid", "__lat", "__lon")


def locate_report(matches: DataFrame) -> DataFrame:
    return matches.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
