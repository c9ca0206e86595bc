"""JSON-lines scans and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from minewright.operators.sampling import hash_sample


def load_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None, max_rows: int | None = None) -> DataFrame:
    """All rows of a JSON-lines file or folder; max_rows 0 means none, None all."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path)
    return rows if max_rows is None else rows.limit(max_rows)


def load_reviews(spark: SparkSession, path: str, sample_size: int | None = 100_000, use_reservoir: bool = True, seed: int = 42) -> DataFrame:
    """The three review columns, sampled, then without repeated or incomplete rows."""
    rows = load_json_lines(spark, path, "user_id string, business_id string, stars double")
    if sample_size is not None:
        key = F.to_json(F.struct("user_id", "business_id", "stars"))
        rows = hash_sample(rows, key, sample_size, seed) if use_reservoir else rows.limit(sample_size)
    return rows.dropDuplicates().na.drop()


def load_businesses(spark: SparkSession, path: str) -> DataFrame:
    """The business columns; missing categories become an empty text."""
    fields = "business_id string, name string, city string, state string, stars double, review_count long, categories string"
    return load_json_lines(spark, path, fields).na.fill("", ["categories"]).dropDuplicates()


def load_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): readable rows, and the counts of lines read, blank and corrupt.

    The file is read as text, so that lines are counted without a cache of the
    parsed rows; blank lines are skipped and undecodable ones left out.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "[\\t\\r\\n]", " ")).alias("line"))
    parsed = lines.select("line", F.from_json("line", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("row"))
    bad = F.col("row._corrupt_record").isNotNull()
    report = parsed.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("line") == "").alias("blank"),
        F.count_if((F.col("line") != "") & bad).alias("corrupt"),
    )
    return parsed.where(F.col("line") != "").where(~bad).select("row.*").drop("_corrupt_record"), report


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, in as many files as df has partitions."""
    df.write.mode(mode).json(path)


def write_web_payload(name: str, sections: dict[str, DataFrame], path: str) -> None:
    """`const <name> = {...};` of small summary frames (each already a bounded report), column by column."""
    payload = {key: frame.toPandas().to_dict("list") for key, frame in sections.items()}
    Path(path).write_text(f"const {name} = {json.dumps(payload, default=str)};\n", encoding="utf-8")
