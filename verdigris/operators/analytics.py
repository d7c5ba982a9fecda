"""Usage events: rows without source text, a sink by day, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.schemas import EVENTS


def review_events(files: DataFrame, findings: DataFrame, session_id: str, mode: str, version: str = "1") -> DataFrame:
    """One event of EVENTS for each reviewed file."""
    issues = findings.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("code").alias("rule"), "severity"))).alias("issues"))
    lines = F.size(F.split("source", "\n", -1))
    return files.select("path", lines.alias("lines")).join(issues, "path", "left").select(
        F.current_timestamp().alias("ts"), F.lit("review").alias("event"), F.lit(session_id).alias("session_id"), F.lit(mode).alias("mode"), F.lit("file").alias("target_type"), F.col("path").alias("target"),
        F.lit("python").alias("language"), "lines", F.coalesce("issues", F.array().cast(EVENTS["issues"].dataType)).alias("issues"), F.lit(None).cast("double").alias("latency_ms"), F.array().cast("array<int>").alias("accepted"), F.lit(version).alias("version"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """JSON lines in a folder for each day."""
    events.withColumn("date", F.to_date("ts")).write.partitionBy("date").mode("append").json(path)


def top_rules(findings: DataFrame, n: int = 5) -> DataFrame:
    """(category, code, n, rank): the most frequent rules of each category."""
    counts = findings.groupBy("category", "code").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "code"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def origin_split(findings: DataFrame) -> DataFrame:
    """How many findings come from rules and how many from the model."""
    return findings.groupBy(F.when(F.startswith(F.col("code"), F.lit("LLM")), "model").otherwise("static").alias("origin")).agg(F.count("*").alias("n"))


def target_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("target_type").agg(F.count("*").alias("n"))


def rollup_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by the columns, by their leading ones, and over all; a null stands for all."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
