"""Files in and out: manifests, registration by content, rule documents, exports. Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "url string, title string, commission string, order_date string, sha256 string"


def read_manifest(spark: SparkSession, paths: list[str], schema: str = MANIFEST) -> DataFrame:
    """Several JSON lists as one, each row with the place of its list; a URL counts where it is listed first."""
    lists = [spark.read.schema(schema).json(p, multiLine=True).withColumn("listing", F.lit(i)) for i, p in enumerate(paths)]
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    first = F.row_number().over(Window.partitionBy("url").orderBy("listing", "title"))
    return out.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def register(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """Files whose content no known row (``sha256``) has: path, length, sha256; of equal files the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))
    own = files.groupBy("sha256").agg(F.min_by(F.struct("path", "length"), "path").alias("f")).select("f.path", "f.length", "sha256")
    return own.join(known.select("sha256"), "sha256", "left_anti")


def inbox(files: DataFrame, known: DataFrame) -> DataFrame:
    """All files with whether their content is registered."""
    return files.join(known.select("sha256", F.lit(True).alias("registered")).distinct(), "sha256", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


def newest_documents(documents: DataFrame, commission: str, fallback: str, version: int | None = None) -> DataFrame:
    """Of versioned documents ``(commission, version, doc)`` the highest (or a given) version; the fallback's where there is none."""
    wanted = documents if version is None else documents.where(F.col("version") == version)
    picked = wanted.where(F.col("commission").isin(commission, fallback)).groupBy("commission").agg(F.max_by("doc", "version").alias("doc"), F.max("version").alias("version"))
    return picked.orderBy((F.col("commission") != commission).cast("int")).limit(1)


def export(df: DataFrame, folder: str, by: str, mode: str = "overwrite") -> None:
    """JSON files in a folder for each value of ``by``."""
    df.write.mode(mode).partitionBy(by).json(folder)


def rebuild(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table anew, one Parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def append_ledger(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)
