"""Readers and writers of the file formats that sales data, documents and indexes come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.texts import deep_urls
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str], separator: str = ";") -> DataFrame:
    """All-string rows: quotes doubled inside quotes, line feeds in values, a byte order mark, short
    rows. Missing cells are empty strings; blank rows are left out. row_idx keeps file order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, sep=separator, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE", enforceSchema=True)
    df = df.withColumn("row_idx", F.monotonically_increasing_id()).fillna("", columns)
    return df.filter(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in columns]) != "")


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """Arrays joined by a bar; committed as a whole by Spark's protocol."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, sep=separator, header=True, quote='"', escape='"')


def read_documents(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines of {doc_id, doc_type, searchable_text, payload or metadata}; where both are given
    payload wins, key by key. Files whose names are in skip are left out."""
    schema = "doc_id string, doc_type string, searchable_text string, metadata map<string,string>, payload map<string,string>"
    df = spark.read.schema(schema).json(path).withColumn("_file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    keep = df.filter(~F.col("_file").isin(*skip)) if skip else df
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("metadata", empty), F.coalesce("payload", empty)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return keep.select("doc_id", "doc_type", "searchable_text", merged.alias("payload"))


def write_documents(docs: DataFrame, path: str) -> dict[str, int]:
    """JSON lines by type; returns how many documents of each type were written."""
    docs.write.mode("overwrite").partitionBy("doc_type").json(path)
    written = docs.sparkSession.read.schema(docs.schema).json(path)
    return {r.doc_type: r["count"] for r in written.groupBy("doc_type").count().collect()}


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def write_index(docs: DataFrame, path: str, previous: str | None = None, most: int = 4000) -> None:
    """Index rows {doc_id, doc_type, dense, payload} with texts cut to ``most`` characters. With a
    previous index the newer row of each id stays (there is no merge on Parquet)."""
    rows = docs.withColumn("searchable_text", F.substring("searchable_text", 1, most)).withColumn("_new", F.lit(1))
    if previous:
        old = docs.sparkSession.read.parquet(previous).withColumn("_new", F.lit(0))
        both = rows.unionByName(old, allowMissingColumns=True)
        best = both.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "_new").alias("r"))
        rows = best.select("doc_id", "r.*")
    rows.drop("_new").write.mode("overwrite").partitionBy("doc_type").parquet(path)


#: Parts of paths that are no product pages (fixed values).
NO_PRODUCTS = ["about", "cabinet", "design", "search", "contacts", "clients", "accounts", "edit", "blog", "news", "faq", "bilboard"]


def read_sitemap(spark: SparkSession, path: str, least: int = 3, without: list[str] | None = None) -> DataFrame:
    """(url, path, depth, file) of the pages that sitemaps in a folder name, each once.

    A page is kept if its path has ``least`` parts and none of ``without`` (NO_PRODUCTS where not given).
    Files are read by Spark in splits; entries without a location are left out. Of pages that several
    files name, the file that comes first is given.
    """
    entries = spark.read.format("xml").schema("loc string").option("rowTag", "url").option("ignoreNamespace", "true").load(path)
    rows = entries.select(F.trim("loc").alias("url"), F.input_file_name().alias("file")).filter("url <> ''")
    rows = rows.groupBy("url").agg(F.min("file").alias("file"))
    return deep_urls(rows, least, NO_PRODUCTS if without is None else without).select("url", "path", "depth", "file")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(url) of the sitemaps that index files in a folder name, each once."""
    entries = spark.read.format("xml").schema("loc string").option("rowTag", "sitemap").option("ignoreNamespace", "true").load(path)
    return entries.select(F.trim("loc").alias("url")).filter("url <> ''").distinct()


#: The namespace of names in UUIDs that stand for URLs (a fixed value of RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ID_BUCKETS = 256


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID (version 5, by SHA-1) of a string, as text; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(h, at, n)
    return F.when(h.isNotNull(), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.substring(variant, -1, 1), part(18, 3)), part(21, 12)))


def upsert_index(rows: DataFrame, path: str, key: str, order: str, buckets: int = ID_BUCKETS) -> int:
    """Insert or replace rows of a keyed table, which is partitioned by a hash of the key.

    Only the buckets that hold a key of rows are read and written (dynamic partition overwrite); all
    other files stay as they are. Of rows that repeat a key the one with the greatest ``order`` stays,
    an older one never replaces a newer one in the table. Rows without a key are left out. Run again after a
    failure it ends the same. Returns the number of buckets written. ``buckets`` must not change.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    new = rows.filter(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
    if exists and touched:
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        new = old.unionByName(new, allowMissingColumns=True)
    best = new.groupBy("bucket", key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("bucket", key)]), F.col(order)).alias("r"))
    best = best.select(key, "r.*", "bucket").repartition("bucket")
    if touched or not exists:
        best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def read_checked(spark: SparkSession, path: str, rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table that must have the given columns and at least so many rows."""
    df = spark.read.parquet(path)
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    if rows is not None and (n := df.count()) < rows:
        raise ValueError(f"{path} has {n} rows, fewer than {rows}")
    return df


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
