"""Entity resolution by normalized keys, aliases, hierarchy, dictionary linking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, text
from .joins import incident

MAX_NAME = 80
FAMILY_RELATIONS = ("subsidiary_of", "brand_of", "product_line_of", "part_of")


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame, name: str = "name", hint: str = "type_hint", order: str = "seq") -> DataFrame:
    """``norm_key, entity_id, how`` for every usable key among ``names``: an entity's own key, an alias, else a new entity.

    A new entity has the type of its first name in order; keys under two characters are left out.
    """
    keyed = names.filter(F.length(name) <= MAX_NAME).withColumn("norm_key", text.entity_key(F.col(name))).filter(F.length("norm_key") >= 2)
    first = keyed.groupBy("norm_key").agg(F.min_by(F.struct(F.coalesce(F.col(hint), text.entity_type(F.col(name))).alias("type"), F.col(name).alias("name")), order).alias("x"))
    own = entities.select("norm_key", F.col("entity_id").alias("own_id"))
    other = aliases.groupBy("norm_key").agg(F.min("entity_id").alias("alias_id"))
    found = first.join(own, "norm_key", "left").join(other, "norm_key", "left")
    new_id = ids.uuid5("ent", F.col("x.type"), F.col("norm_key"))
    how = F.when(F.col("own_id").isNotNull(), "entity").when(F.col("alias_id").isNotNull(), "alias").otherwise("new")
    return found.select("norm_key", F.coalesce("own_id", "alias_id", new_id).alias("entity_id"), how.alias("how"), F.col("x.type").alias("type"), F.col("x.name").alias("name"))


def bind(mentions: DataFrame, keys: DataFrame, key: str, names: str) -> DataFrame:
    """``key, entity_ids``: the names of each mention as entity ids, in their order, unresolved ones dropped."""
    rows = mentions.select(key, F.posexplode(names).alias("pos", "name")).withColumn("norm_key", text.entity_key(F.col("name")))
    bound = rows.join(keys.select("norm_key", "entity_id"), "norm_key")
    return bound.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]).alias("entity_ids"))


def seed_edges(pairs: DataFrame, keys: DataFrame, relation: str = "part_of") -> DataFrame:
    """Hierarchy rows (child, parent) by name as edges between entity ids; a missing end drops the row."""
    k = keys.select("norm_key", "entity_id")
    child = pairs.withColumn("norm_key", text.entity_key(F.col("child"))).join(k, "norm_key").withColumnRenamed("entity_id", "src").drop("norm_key")
    both = child.withColumn("norm_key", text.entity_key(F.col("parent"))).join(k, "norm_key").withColumnRenamed("entity_id", "dst")
    return both.filter("src <> dst").select("src", "dst", F.lit(relation).alias("relation")).distinct()


#: Names that are looked for in a text one by one; larger dictionaries join its grams.
FEW_NAMES = 256


def link_dictionary(queries: DataFrame, entities: DataFrame, query: str, key: str, least: int = 2, most: int = 5) -> DataFrame:
    """Entities whose key occurs in the query text, the longest first, at most ``most`` of a query.

    A dictionary of up to ``FEW_NAMES`` travels to the texts. Beyond that they are cut into all grams of its key lengths,
    so that the dictionary joins by equality.
    """
    ranked = lambda hits: hits.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("norm_key")), "entity_id"))).filter(F.col("rn") <= most).select(key, "entity_id", "norm_key", "rn")
    names = entities.select("norm_key", "entity_id").filter(F.length("norm_key") >= least)
    if names.count() <= FEW_NAMES:
        bodies = queries.select(key, text.loose_key(F.col(query)).alias("_body"))
        return ranked(bodies.join(F.broadcast(names), F.contains("_body", "norm_key")).select(key, "entity_id", "norm_key"))
    lengths = sorted(r[0] for r in entities.select(F.length("norm_key").alias("n")).distinct().collect())  # a few numbers
    # characters in an array: a place in a string is found from its start, a slice of an array is not
    cut = queries.select(key, F.split(text.loose_key(F.col(query)), "").alias("_chars"))
    grams = lambda n: F.when(F.size("_chars") >= n, F.transform(F.sequence(F.lit(1), F.size("_chars") - n + 1), lambda i: F.array_join(F.slice(F.col("_chars"), i, n), "")))
    parts = [F.coalesce(grams(n), F.array().cast("array<string>")) for n in lengths if n >= least]
    if not parts:
        return queries.select(key).limit(0).crossJoin(entities.select("entity_id").limit(0))
    rows = cut.select(key, F.explode(F.array_distinct(F.concat(*parts))).alias("norm_key"))
    hits = rows.join(entities.select("norm_key", "entity_id"), "norm_key")
    return ranked(hits)


def family(edges: DataFrame, members: DataFrame, node: str = "entity_id", relations: tuple[str, ...] = FAMILY_RELATIONS) -> DataFrame:
    """``members`` and everything one hop away in either direction over the family relations."""
    near = incident(edges.filter(F.col("relation").isin(*relations)).select("src", "dst"), members.select(F.col(node).alias("node")))
    return members.select(node).union(near.select("src")).union(near.select("dst")).distinct()
