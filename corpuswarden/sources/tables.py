"""Sources and sinks: the given tables as sources, trees of files, baselines and suppressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension

MOST_BYTES = 1_500_000
PRESENCE = "(?i)^(robots\\.txt|sitemap[A-Za-z0-9_-]*\\.xml|package\\.json|package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One small file is a single task: rows of less files than cores are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def described(df: DataFrame, most: int | None = MOST_BYTES) -> DataFrame:
    """site_id, path, text with name, ext, size_bytes and skipped_reason; text over the limit (if there is one) or
    binary is not read."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    reason = F.when(F.col("text").isNull(), "unreadable").when(F.lit(False) if most is None else size > most, "large").when(F.contains("text", F.lit("\x00")), "binary")
    rows = df.select("site_id", "path", base_name("path").alias("name"), extension("path").alias("ext"), size.alias("size_bytes"), "text", reason.alias("skipped_reason"))
    return rows.withColumn("text", F.when(F.col("skipped_reason").isNull(), F.col("text")))


def document_sources(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Documents as sources, of any length: their source is the site, their id the path."""
    return described(table(spark, sf_dir, "documents").select(F.col("source").alias("site_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), "text"), most)


def conversation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("site_id"), F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("path"), "text"), None)


def browser_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user's pages are the route."""
    return table(spark, sf_dir, "events").select(F.lit("events").alias("site_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), "event_type", F.col("event_id").alias("at"), F.col("event_id").cast("string").alias("detail"))


def inventory(sources: DataFrame) -> DataFrame:
    """Coverage of each site: files, bytes, skipped files by reason, and whether all were read."""
    reasons = [F.count_if(F.col("skipped_reason") == r).alias(r) for r in ("large", "binary", "unreadable")]
    counts = sources.groupBy("site_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"), *reasons)
    return counts.withColumn("status", F.when(F.col("large") + F.col("binary") + F.col("unreadable") > 0, "partial").otherwise("completed"))


def read_tree(spark: SparkSession, root: str, site_id: str, pattern: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """Text files below a folder; one file a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^.*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.rstrip("/").split("://")[-1]) + "/", "")
    text = F.when(F.col("length") <= most, F.decode("content", "UTF-8"))
    rows = files.select(F.lit(site_id).alias("site_id"), path.alias("path"), text.alias("text"), F.col("length"))
    return described(rows, most).drop("skipped_reason").join(rows.select("path", F.when(F.col("length") > most, "large").alias("skipped_reason"), F.col("length").alias("_n")), "path").withColumn("size_bytes", F.col("_n")).drop("_n")


def read_assets(spark: SparkSession, root: str, site_id: str) -> DataFrame:
    """Path and size of files below a folder; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select(F.lit(site_id).alias("site_id"), F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), extension("path").alias("ext"), F.col("length").alias("size_bytes"))


def presence_only(sources: DataFrame) -> DataFrame:
    """Unread crawl files, manifests and lockfiles stay as rows without text; other unread files go."""
    return sources.where(F.col("skipped_reason").isNull() | F.col("name").rlike(PRESENCE))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline: the folder that ``write_baseline`` makes, or one JSON object with a list of entries."""
    if not path.endswith(".json"):
        return spark.read.parquet(path).select("site_id", "mode", "fingerprint", "rule_id", "severity", "path")
    schema = "kind string, modes array<string>, entries array<struct<site_id:string,mode:string,fingerprint:string,rule_id:string,severity:string,path:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).selectExpr("inline(entries)")


def write_baseline(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").partitionBy("mode").parquet(path)


def read_suppressions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid suppressions with their order, and rejected rows. One JSON object with a list ``suppressions``."""
    schema = "suppressions array<struct<rule:string,path:string,reason:string,expires:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("suppressions").alias("ord", "s")).select("ord", "s.*")
    day = F.try_to_date("expires", "yyyy-MM-dd")
    good = (F.coalesce(F.trim("rule"), F.lit("")) != "") & F.length(F.coalesce("reason", F.lit(""))).between(8, 1000) & (F.col("expires").isNull() | day.isNotNull())
    return rows.where(good).withColumn("expires", day), rows.where(~good)


def write_documents(pieces: DataFrame, path: str) -> None:
    """Write the pieces of ``findings.documents``: below a folder for each site and mode, files in the order of their
    names are the document. A site of any size is dealt to several tasks by range."""
    parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = pieces.repartitionByRange(parts, "site_id", "mode", "part", "key").sortWithinPartitions("site_id", "mode", "part", "key")
    ordered.select("site_id", "mode", "value").write.mode("overwrite").partitionBy("site_id", "mode").text(path)
