"""Sinks: reports, scores, progress and trajectories as files; rule documents; keyed memory."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(found: DataFrame, path: str, errors: DataFrame | None = None) -> None:
    """A JSON report as a folder: findings, summary, errors; findings are written in parallel, one object a line."""
    found.write.mode("overwrite").json(f"{path}/findings")
    found.groupBy("severity", "triage_status").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    if errors is not None:
        errors.write.mode("overwrite").json(f"{path}/errors")


def append_lines(rows: DataFrame, path: str) -> None:
    """Trajectories and progress: JSON lines, appended."""
    rows.write.mode("append").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as JSON and, beside it, as a Markdown table."""
    scores.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in scores.columns]), F.lit(" |"))
    scores.select(row.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def upsert(memory: DataFrame | None, news: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Last write wins by key: the memory with the news, written to a new folder (never over what is read)."""
    both = news if memory is None else memory.unionByName(news)
    rest = [c for c in both.columns if c != key]
    out = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v")).select(key, "_v.*")
    out.write.mode("errorifexists").parquet(path)
    return both.sparkSession.read.parquet(path)


#: Rules that one document may hold.
MOST_RULES = 100_000


def rule_document(rules: DataFrame, as_yaml: bool = False) -> str:
    """A rule set as one YAML or JSON document; rule sets are small and leave through the driver."""
    rows = [r.asDict(recursive=True) for r in rules.limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules do not make one document; write them as JSON lines")
    if as_yaml:
        import yaml

        return yaml.safe_dump({"rules": rows}, sort_keys=False, allow_unicode=True)
    return json.dumps({"rules": rows}, ensure_ascii=False, indent=2)


def write_lines(lines: DataFrame, path: str) -> None:
    """A document of (place, line) as text files that are it when read in the order of their names; ranges of it are written in parallel."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def save_jobs(jobs: DataFrame, path: str) -> None:
    """Saves job records (scan_id, version, and what else they have): appended, so that no record is lost when a write fails; load_jobs() gives the last one of each id."""
    jobs.write.mode("append").json(path)


def load_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last saved record of each scan_id, by version."""
    saved = spark.read.schema(schema).json(path)
    rest = [c for c in saved.columns if c != "scan_id"]
    return saved.groupBy("scan_id").agg(F.max_by(F.struct(*rest), "version").alias("_v")).select("scan_id", "_v.*")


def write_bundle(rules: DataFrame, path: str) -> DataFrame:
    """A review bundle of a rule set: its normalized rules, their validation report, the exported older shape and what it skipped, each a folder of JSON lines; returns one row: valid, rules_checked, error_count, warning_count."""
    from lintlake.operators import rules as ops

    for name, part in (("normalized", rules), ("validation", ops.validate(rules)), ("legacy", ops.export_legacy(rules)), ("legacy_skips", ops.export_skips(rules))):
        part.write.mode("overwrite").json(f"{path}/{name}")
    spark = rules.sparkSession
    issues = spark.read.schema("rule_id string, level string, code string").json(f"{path}/validation")
    counts = issues.agg(F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warning").alias("warning_count"))
    checked = spark.read.schema("rule_no long").json(f"{path}/normalized").agg(F.count("*").alias("rules_checked"))
    both = checked.join(counts, F.lit(True))  # one row each
    return both.select((F.col("error_count") == 0).alias("valid"), "rules_checked", "error_count", "warning_count")


def one_document(spark: SparkSession, path: str):
    """A single JSON document, whole."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()["value"])
