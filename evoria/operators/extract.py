"""Validation and merging of extracted mentions; the extraction itself is an input column or a scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .vectors import in_blocks

MAX_MENTIONS = 12


def flatten_chunks(chunks: DataFrame, key: str, chunk: str, mentions: str) -> DataFrame:
    """One row for each mention with its place in the document's chunks."""
    rows = chunks.select(key, chunk, F.posexplode(mentions).alias("place", "mention"))
    return rows.withColumn("pos", F.struct(chunk, "place"))


def merge_in_document(mentions: DataFrame, key: str, pos: str, kind: Column, action: Column, subject: Column, evidence: str, most: int = MAX_MENTIONS) -> DataFrame:
    """Mentions of a document that agree loosely in kind, action and first object become the first one with all evidence."""
    merged = mentions.withColumn("merge_key", F.concat_ws("|", *(text.loose_key(c) for c in (kind, action, subject)))).groupBy(key, "merge_key").agg(F.min(pos).alias("pos"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(pos, evidence))), lambda x: x[evidence])).alias(evidence))
    return merged.withColumn("mention_no", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("mention_no") <= most)


def validity(action: Column, quotes: Column, body: Column) -> Column:
    """Null for a valid mention, else the reason: no action, no evidence, or no quote that the text has."""
    located = F.exists(quotes, lambda q: text.quote_span(body, q).isNotNull())
    return F.when(F.coalesce(F.trim(action), F.lit("")) == "", "missing_action").when(F.coalesce(F.size(quotes), F.lit(0)) < 1, "missing_evidence").when(~F.coalesce(located, F.lit(False)), "evidence_not_found")


def clean_names(names: Column, default_type: str) -> Column:
    """array<struct<name, type>>: names trimmed, empty ones dropped, a default type filled in."""
    filled = F.transform(names, lambda n: F.struct(F.trim(n["name"]).alias("name"), F.coalesce(n["type"], F.lit(default_type)).alias("type")))
    return F.filter(filled, lambda n: F.coalesce(n["name"], F.lit("")) != "")


def clean_scope(scope: Column) -> Column:
    return F.map_filter(scope, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


#: Characters of the grams that documents and quotes are joined by, and how far apart a document's grams stand.
GRAM, STEP = 12, 16


def find_quotes(docs: DataFrame, quotes: DataFrame, key: str, body: str, item: str, quote: str, least: int = 6, middle: int = 40) -> DataFrame:
    """``item, key, span``: where quotes occur in documents, as ``text.quote_span`` has it.

    A match holds the quote's middle (a short quote's whole) in one piece. A document gives the gram at every ``STEP``-th
    character of its match form, a piece of ``GRAM + STEP - 1`` characters those at its first ``STEP`` places, so each
    match shares one, and only pairs that do are looked at. Shorter pieces meet every document, in blocks of quotes.
    """
    d = docs.select(key, F.col(body).alias("_body"), text.match_form(F.col(body)).alias("_t"))
    q = quotes.select(item, F.col(quote).alias("_quote"), text.match_form(F.col(quote)).alias("_q")).withColumn("_n", F.length("_q"))
    half = F.floor(F.col("_n") / 2).cast("int") - middle // 2
    piece = F.when(F.col("_n") > middle, F.substring(F.col("_q"), half + 1, F.lit(middle))).otherwise(F.col("_q"))
    q = q.filter(F.col("_n") >= least).withColumn("_piece", piece)
    joins_by_gram = F.length("_piece") >= GRAM + STEP - 1
    of_quote = q.filter(joins_by_gram).select(item, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(STEP)), lambda i: F.substring(F.col("_piece"), i, F.lit(GRAM))))).alias("_gram"))
    of_doc = d.select(key, F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(f"(?s)(.{{{GRAM}}}).{{0,{STEP - GRAM}}}"), F.lit(1)))).alias("_gram"))
    pairs = of_doc.join(of_quote, "_gram").select(key, item).distinct()
    near = d.join(pairs, key).join(q.select(item, "_quote"), item).select(item, key, "_body", "_quote")
    short = in_blocks(q.filter(~joins_by_gram), F.struct(item, "_quote"))
    far = d.join(short).withColumn("_x", F.explode("all")).select(F.col(f"_x.{item}").alias(item), key, "_body", "_x._quote")
    found = near.unionByName(far).select(item, key, text.quote_span(F.col("_body"), F.col("_quote"), least, middle).alias("span"))
    return found.filter("span IS NOT NULL")
