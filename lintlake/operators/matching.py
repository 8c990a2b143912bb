"""Joins that match code to rules, findings to places, and findings to modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.session import small


def by_mode(found: DataFrame) -> DataFrame:
    """Each finding once for each triage mode it belongs to. A missing status is visible, never high-confidence. No join: the modes are exploded from an array in the row."""
    status = F.coalesce("triage_status", F.lit(""))
    modes = F.array(F.lit("all"), F.when(status != "suppressed", "visible"), F.when(status.isin("confirmed", "likely"), "high-confidence"))
    return found.withColumn("mode", F.explode(F.array_compact(modes)))


def match_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls against call patterns: equal; `.x` matches as a suffix; an undotted name also as a last segment. Rules are the bounded rule set."""
    name, p = F.col("call_name"), F.col("pattern")
    hit = (name == p) | (p.startswith(".") & name.endswith(p)) | (~p.contains(".") & name.endswith(F.concat(F.lit("."), p)))
    return calls.join(small(rules), hit)


def match_by_language(lines: DataFrame, rules: DataFrame, allowed: dict[str, tuple[str, ...]], without: tuple[str, ...] = ()) -> DataFrame:
    """Substring match with the sink categories that each language's matcher knows; a language that is not named knows all but `without`."""
    kind, ok = F.col("vulnerability_type"), None
    for lang, kinds in allowed.items():
        here = (F.col("lang") == lang) & kind.isin(*kinds)
        ok = here if ok is None else ok | here
    rest = ~F.col("lang").isin(*allowed) & ~kind.isin(*without)
    return lines.join(small(rules), F.col("line").contains(F.col("pattern")) & (ok | rest))


#: Lines of a stretch in which nodes and sinks meet.
BUCKET = 64


def nodes_with_sinks(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes and the sinks on their lines that their label names: a hash join on the file and a stretch of BUCKET lines (a node is in each that it touches, a sink in one), with the interval as residual condition."""
    s = sinks.withColumnRenamed("doc_id", "_d").withColumn("_b", F.floor(F.col("line_number") / BUCKET))
    n = nodes.withColumn("_nb", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.greatest("start_line", "end_line") / BUCKET))))
    on = (n["doc_id"] == s["_d"]) & (n["_nb"] == s["_b"]) & s["line_number"].between(n["start_line"], n["end_line"]) & n["label"].contains(s["sink_pattern"])
    return n.join(s, on).drop("_d", "_b", "_nb")


def source_windows(found: DataFrame, files: DataFrame, radius: int) -> DataFrame:
    """finding_id, n_lines, context: the lines around a finding, numbered and clamped to the file. A file's findings are listed first, so its text meets them once, and its lines are sliced within the row."""
    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("finding_id", "line_number")).alias("_f"))
    text = files.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    joined = listed.join(text, F.col("doc_id") == F.col("_d")).withColumn("_l", F.split("_t", "\n", -1))

    def window(f: Column) -> Column:
        first, last = F.greatest(f["line_number"] - radius, F.lit(1)), F.least(f["line_number"] + radius, F.size("_l"))
        numbered = F.transform(F.slice("_l", first, last - first + 1), lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x))
        return F.struct(f["finding_id"].alias("finding_id"), (last - first + 1).cast("long").alias("n_lines"), F.array_join(numbered, "\n").alias("context"))

    return joined.select(F.explode(F.transform("_f", window)).alias("x")).select("x.*")


def first_match(found: DataFrame, labels: DataFrame, tolerance: int) -> DataFrame:
    """Findings against range labels: same file and family, line within the label's range plus tolerance. A finding takes the first label in list order, hit before or not; of a label's findings the first is its match, the others are duplicates. Findings in files without labels take no part."""
    from pyspark.sql import Window

    lab = labels.select(F.col("file_path").alias("_f"), F.col("family").alias("_m"), "label_idx", "start_line", "end_line", "is_vulnerable")
    reviewed = labels.select(F.col("file_path").alias("_rf")).distinct()
    inside = found.join(reviewed, F.col("file_path") == F.col("_rf"), "left_semi")
    near = (F.col("file_path") == F.col("_f")) & (F.col("family") == F.col("_m")) & F.col("line_number").between(F.col("start_line") - tolerance, F.col("end_line") + tolerance)
    hit = inside.join(lab, near, "left")
    one = hit.withColumn("_n", F.row_number().over(Window.partitionBy("finding_id").orderBy(F.col("label_idx").asc_nulls_last()))).filter("_n = 1").drop("_n")
    nth = F.row_number().over(Window.partitionBy("file_path", "label_idx").orderBy("ordinal"))
    return one.withColumn("nth", nth).select("finding_id", "file_path", "family", "label_idx", F.when(F.col("label_idx").isNull() | ~F.col("is_vulnerable"), "fp").when(F.col("nth") == 1, "tp").otherwise("duplicate").alias("outcome"))


def label_outcomes(matched: DataFrame, labels: DataFrame) -> DataFrame:
    """file_path, label_idx, n_findings, outcome of every label by what first_match() gave it: TP or FN if it is vulnerable, FP or TN if not, with or without findings."""
    hits = matched.filter("label_idx IS NOT NULL").groupBy("file_path", "label_idx").agg(F.count("*").alias("n_findings"))
    out = labels.select("file_path", "label_idx", "is_vulnerable").join(hits, ["file_path", "label_idx"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("long")))
    some = F.col("n_findings") > 0
    return out.select("file_path", "label_idx", "n_findings", F.when(F.col("is_vulnerable"), F.when(some, "TP").otherwise("FN")).otherwise(F.when(some, "FP").otherwise("TN")).alias("outcome"))
