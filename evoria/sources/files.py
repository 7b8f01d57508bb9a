"""Readers and writers: corpus JSON, clean layer, JSON lines, review CSV, content-addressed objects, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

ITEM = "url string, title string, published_at string, fetched_at string, source_name string, language string, content string"


def read_corpus(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(items, quarantined files) of JSON files that hold an array of items or an object with ``items``.

    Items carry ``file`` and their place; files that are no JSON are quarantined, not dropped.
    """
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    both = text.withColumns({"bare": F.from_json("value", f"array<struct<{ITEM.replace(' string', ': string')}>>"), "wrapped": F.from_json("value", f"struct<items: array<struct<{ITEM.replace(' string', ': string')}>>>")["items"]})
    is_array = F.ltrim("value").startswith("[")
    chosen = both.withColumn("items", F.when(is_array, F.col("bare")).otherwise(F.col("wrapped")))
    items = chosen.select("file", F.posexplode("items").alias("place", "item")).select("file", "place", "item.*")
    return items, chosen.filter("items IS NULL").select("file", F.substring("value", 1, 200).alias("head"))


def write_corpus(items: DataFrame, path: str, source: str, key: str, item: Column, part_bytes: int = 32 << 20) -> None:
    """JSON files that hold an array of items of one source, as ``read_corpus`` reads them.

    A source's items are dealt by a hash of the key over as many arrays as keep one near ``part_bytes``, so no array grows
    with its source.
    """
    body = F.to_json(item)
    sized = items.select(F.col(source).alias("source"), F.xxhash64(key).alias("h"), item.alias("item"), F.octet_length(body).alias("size"))
    parts = sized.groupBy("source").agg(F.ceil(F.sum("size") / part_bytes).cast("int").alias("parts"))
    dealt = sized.join(parts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("part", F.pmod("h", F.greatest("parts", F.lit(1))))
    arrays = dealt.groupBy("source", "part").agg(F.to_json(F.collect_list("item")).alias("value"))
    arrays.write.partitionBy("source", "part").text(path)


def in_publish_order(items: DataFrame) -> DataFrame:
    """Adds ``seq_key``: items sort by it as an online run would meet them (file, publish time, URL)."""
    return items.withColumn("seq_key", F.struct("file", F.coalesce("published_at", F.lit("")), F.coalesce("url", F.lit("")), "place"))


def write_clean(items: DataFrame, path: str, company: str = "company", month: str = "month") -> DataFrame:
    """Items as Parquet by company and month; returns the manifest (company, month, n)."""
    items.write.mode("overwrite").partitionBy(company, month).parquet(path)
    return items.sparkSession.read.parquet(path).groupBy(company, month).agg(F.count(F.lit(1)).alias("n"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Values come back as they were: blanks at their ends stay, and no character but the quote is special.
_REVIEW = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_review(df: DataFrame, path: str) -> None:
    r"""CSV for reviewers; quotes are doubled, nulls are empty. A null string is \N, as an empty one is a value too (a text \N gets one more backslash)."""
    marked = {c: F.coalesce(F.when(F.col(c).rlike(r"\A\\+N\z"), F.concat(F.lit("\\"), c)).otherwise(F.col(c)), F.lit("\\N")) for c, kind in df.dtypes if kind == "string"}
    df.withColumns(marked).write.mode("overwrite").options(**_REVIEW).option("quoteAll", True).csv(path)


def read_review(spark: SparkSession, path: str, schema: str, label: str, least: float = 0.8) -> tuple[DataFrame, str]:
    """(rows, standing): ``human`` where enough rows carry a label, else ``partial``."""
    rows = spark.read.schema(schema).options(**_REVIEW).option("multiLine", True).csv(path)
    rows = rows.withColumns({c: F.when(F.col(c).isNull(), "").when(F.col(c) != "\\N", F.when(F.col(c).rlike(r"\A\\+N\z"), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(c))) for c, kind in rows.dtypes if kind == "string"})
    share = rows.agg(F.avg(F.col(label).isNotNull().cast("int"))).first()[0] or 0.0
    return rows, "human" if share >= least else "partial"


def put_objects(contents: DataFrame, value: str) -> DataFrame:
    """``hash, path, bytes, content`` once for each distinct content: what a content-addressed store holds."""
    h = F.sha2(F.col(value).cast("binary"), 256)
    keyed = contents.select(h.alias("hash"), F.col(value).alias("content")).dropDuplicates(["hash"])
    return keyed.select("hash", F.concat_ws("/", F.substring("hash", 1, 2), F.substring("hash", 3, 2), "hash").alias("path"), F.octet_length("content").alias("bytes"), "content")


def corpus_fingerprint(files: DataFrame, name: str, value: str) -> DataFrame:
    """One hash over the sorted ``name:hash`` of all files. One short string for each file reaches one task."""
    line = F.concat(F.col(name).cast("string"), F.lit(":"), ids.short_hash(F.col(value)))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


def table_fingerprint(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Content hash that does not depend on row order, without volatile columns."""
    return df.agg(*ids.table_fingerprint([c for c in df.columns if c not in skip]))
