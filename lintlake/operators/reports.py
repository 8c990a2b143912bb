"""Report summaries, diffs, exports and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.dims import STATUSES, case, queue_rank, status_rank
from lintlake.session import small


def severity_summary(found: DataFrame) -> DataFrame:
    """Counts of the four ranked severities; the others are in the total alone."""
    return found.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


def status_counts(found: DataFrame, zero_fill: bool) -> DataFrame:
    """Counts by status; zero_fill gives all four known ones, 0 where none is."""
    if not zero_fill:
        return found.groupBy("triage_status").agg(F.count("*").alias("n"))
    one = found.agg(*[F.count_if(F.col("triage_status") == s).alias(s) for s in STATUSES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("triage_status"), F.col(f"`{s}`").alias("n")) for s in STATUSES])).alias("x")).select("x.*")


def summary(found: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Counts by each of several dimensions in one pass: dimension, value, n. Null or empty values get the dimension's default."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)).alias("value")) for c, default in dims.items()])
    return found.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def most_common(found: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """Top n values; ties by first appearance."""
    return found.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(n)


def duplicate_groups(found: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return found.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_delta(found: DataFrame, key: list[str]) -> DataFrame:
    """Rows, distinct keys, and what duplicates add."""
    by = found.groupBy(*key).agg(F.count("*").alias("_c"))
    return by.agg(F.sum("_c").alias("n"), F.count("*").alias("n_distinct")).withColumn("delta", F.col("n") - F.col("n_distinct"))


def key_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys that went and keys that came: change, key. Null-safe set difference in one full outer join of distinct keys."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in key])
    a, b = old.select(name.alias("key")).distinct().withColumn("_a", F.lit(1)), new.select(name.alias("key")).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, "key", "full_outer").filter("_a IS NULL OR _b IS NULL")
    return both.select(F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"), "key")


def counter_delta(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """new minus old counts by value, zeros dropped."""
    a, b = old.groupBy(column).agg(F.count("*").alias("_a")), new.groupBy(column).agg(F.count("*").alias("_b"))
    out = a.join(b, column, "full_outer").select(column, (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("delta"))
    return out.filter("delta <> 0")


def queue_order(found: DataFrame) -> list[Column]:
    """The review queue: muted last, by status, by severity, most confident first, by line."""
    return [F.col("muted").asc(), status_rank(F.col("triage_status")).asc(), queue_rank(F.col("severity")).asc(), F.coalesce("confidence", F.lit(-1.0)).desc(), F.coalesce("line_number", F.lit(0)).asc()]


def queue_page(found: DataFrame, page: int, tie: str, size: int = 12) -> DataFrame:
    """One page of the queue (from 1), with its place in it. limit and offset run as a top-k, not a full sort."""
    top = found.orderBy(*queue_order(found), tie).offset((page - 1) * size).limit(size)
    return top.withColumn("place", (F.row_number().over(Window.orderBy(*queue_order(found), tie)) + (page - 1) * size).cast("long"))


def queue_filter(found: DataFrame, status: str = "all", severity: str = "all", language: str = "all", family: str = "all", path: str = "", needle: str = "", muted: bool | None = None) -> DataFrame:
    """The dashboard's filters; `all` and empty strings do nothing. The needle is sought in the lower-cased fields joined by blanks."""
    on = F.lit(True)
    for column, value in (("triage_status", status), ("severity", severity), ("language", language), ("vulnerability_type", family)):
        if value != "all":
            on = on & (F.col(column) == value)
    if muted is not None:
        on = on & (F.col("muted") == muted)
    if path:
        on = on & path_selected(F.col("file_path"), path)
    if needle:
        hay = F.lower(F.concat_ws(" ", "finding_id", "rule_id", "vulnerability_type", "file_path", "snippet", "source_type", "sink_function", "language", "severity", "triage_status"))
        on = on & hay.contains(needle.lower())
    return found.filter(on)


def path_selected(path: Column, selected: str) -> Column:
    """Equal, below it, or below a folder named as its last segment (or that name alone), as a report may give paths from the root that was scanned; slashes of either kind. An empty path or selection selects nothing."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    want = selected.replace("\\", "/").rstrip("/")
    last = want.rsplit("/", 1)[-1]
    if not last:
        return F.lit(False)
    return (p != "") & ((p == want) | p.startswith(want + "/") | (p == last) | p.startswith(last + "/") | p.contains(f"/{last}/"))


def keep_newest(runs: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """What retention removes: all but the newest `keep` of each group (and what ties with them). Only the rows that stay are ranked, limited before the shuffle; no group is sorted whole."""
    stay = runs.select(F.col(group).alias("_g"), F.col(order).alias("_o")).withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_o")))).filter(F.col("_n") <= keep).select("_g", "_o").distinct()
    return runs.join(small(stay), F.col(group).eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o")), "left_anti")


def latest(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Last write of each key, as a map-side combined aggregate."""
    pick = F.max_by(F.struct(*columns), order).alias("_v")
    return rows.groupBy(key).agg(pick).select(key, *[F.col("_v")[c].alias(c) for c in columns])


def sarif_results(found: DataFrame) -> DataFrame:
    """SARIF results, flat: rule index by first appearance, level, fingerprint, column from 1 on."""
    first = found.groupBy("rule_id").agg(F.min("ordinal").alias("_o"))
    index = first.withColumn("rule_index", F.row_number().over(Window.orderBy("_o")) - 1).drop("_o")  # a row for each rule
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    out = found.join(small(index), "rule_id")
    return out.select("finding_id", "rule_id", "rule_index", level.alias("level"), F.concat_ws(":", "rule_id", "file_path", "line_number").alias("fingerprint"), F.greatest("column_number", F.lit(1)).alias("start_column"))


def thread_flows(flows: DataFrame) -> DataFrame:
    """sink_path, sink_line, n_locations, code_flow (JSON): the SARIF code flow of each joined source and sink: the source, the call sites on the way, the sink. flows: as cross-file taint gives them."""
    at = lambda path, line, text, weight: F.struct(F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.struct(line.cast("long").alias("startLine")).alias("region")).alias("physicalLocation"), F.struct(text.alias("text")).alias("message")).alias("location"), F.lit(weight).alias("importance"))
    steps = F.transform("chain", lambda c: at(F.regexp_extract(c, r"^(.*):(\d+)$", 1), F.regexp_extract(c, r"^(.*):(\d+)$", 2), F.lit("call"), "important"))
    line = F.concat(F.array(at(F.col("source_path"), F.col("source_line"), F.lit("source"), "essential")), steps, F.array(at(F.col("sink_path"), F.col("sink_line"), F.concat(F.lit("sink "), F.col("sink")), "essential")))
    return flows.select("source_path", "source_line", "sink_path", "sink_line", F.size(line).cast("long").alias("n_locations"), F.to_json(F.struct(F.array(F.struct(line.alias("locations"))).alias("threadFlows"))).alias("code_flow"))


# The score of a severity in SARIF.
SECURITY_SEVERITY = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0", "INFO": "1.0", "UNKNOWN": "0.0"}


def sarif_rules(found: DataFrame) -> DataFrame:
    """rule_index, rule_id, name, full_description, language, security_severity: the rules of a SARIF run, each as its first finding (by ordinal) defines it. A row for each rule."""
    score = case(F.col("severity"), SECURITY_SEVERITY, "0.0")
    first = found.groupBy("rule_id").agg(F.min("ordinal").alias("_o"), F.min_by(F.struct(F.col("vulnerability_type").alias("name"), F.concat_ws(" ", "vulnerability_type", F.lit("at"), "sink_function").alias("full_description"), "language", score.alias("security_severity")), "ordinal").alias("_f"))
    return first.select((F.row_number().over(Window.orderBy("_o")) - 1).alias("rule_index"), "rule_id", "_f.*")


def assembled(sections: list[DataFrame]) -> DataFrame:
    """place, line: the lines of a document made of sections, one after the other, each with key (its order, unique in the section) and line. Concatenated in the order of place they are the document; no task holds more than a range of it."""
    from lintlake.operators.findings import numbered

    out = None
    for i, s in enumerate(sections):
        s = s.select(F.lit(i).alias("_s"), F.col("key").cast("string").alias("key"), "line")
        out = s if out is None else out.unionByName(s)
    return numbered(out, "place", "_s", "key").select("place", "line")


def _line(found: DataFrame, text: str) -> DataFrame:
    return found.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(text).alias("line"))


def _items(rows: DataFrame, value: Column) -> DataFrame:
    """JSON list items, a line each, with a comma before all but the first."""
    least = rows.agg(F.min("key")).first()[0]
    return rows.select("key", F.concat(F.when(F.col("key") == F.lit(least), "").otherwise(","), F.to_json(value)).alias("line"))


def json_document(found: DataFrame, target: str) -> DataFrame:
    """The lines of a JSON report: scan_metadata, findings, summary."""
    place = F.struct("file_path", "line_number", "column_number").alias("location")
    items = _items(found.withColumn("key", F.col("finding_id")), F.struct("finding_id", "rule_id", "vulnerability_type", "severity", "triage_status", place))
    meta = found.agg(F.count_distinct("file_path").alias("files_with_findings")).select(F.lit("").alias("key"), F.concat(F.lit('{"scan_metadata":'), F.to_json(F.struct(F.lit(target).alias("target"), "files_with_findings")), F.lit(',"findings":[')).alias("line"))
    summary = severity_summary(found).select(F.lit("").alias("key"), F.concat(F.lit('],"summary":'), F.to_json(F.struct("total", "critical", "high", "medium", "low")), F.lit(',"errors":[]}')).alias("line"))
    return assembled([meta, items, summary])


def sarif_document(found: DataFrame, tool: str = "lintlake") -> DataFrame:
    """The lines of a SARIF 2.1.0 document: one run with its tool's rules and its results."""
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine"), F.greatest("column_number", F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    rules = _items(sarif_rules(found).withColumn("key", F.lpad(F.col("rule_index").cast("string"), 9, "0")), F.struct(F.col("rule_id").alias("id"), "name", F.struct(F.col("full_description").alias("text")).alias("fullDescription"), F.struct(F.col("security_severity").alias("security-severity")).alias("properties")))
    mark = F.struct(F.concat_ws(":", "rule_id", "file_path", "line_number").alias("primaryLocationLineHash")).alias("partialFingerprints")
    results = _items(found.withColumn("key", F.col("finding_id")), F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"), mark))
    head, between, foot = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s","rules":[' % tool, ']}},"results":[', "]}]}"
    return assembled([_line(found, head), rules, _line(found, between), results, _line(found, foot)])


def markdown(found: DataFrame) -> DataFrame:
    """The lines of a Markdown report: a heading for each severity from critical to low that has findings (the others are left out), then its findings by id."""
    titles = {"CRITICAL": "## Critical", "HIGH": "## High", "MEDIUM": "## Medium", "LOW": "## Low"}
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(titles) for x in (s, i)])[F.col("severity")]
    listed = found.filter(F.col("severity").isin(*titles)).withColumn("_r", rank.cast("string"))
    heads = listed.groupBy("severity", "_r").agg(F.count("*").alias("n")).select(F.col("_r").alias("key"), F.concat(F.create_map(*[F.lit(x) for p in titles.items() for x in p])[F.col("severity")], F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    items = listed.select(F.concat_ws(" ", "_r", "finding_id").alias("key"), F.format_string("- %s %s:%d", F.col("finding_id"), F.col("file_path"), F.col("line_number")).alias("line"))
    return assembled([_line(found, "# Security report"), heads.unionByName(items)])


def patches(found: DataFrame, order: str) -> DataFrame:
    """Findings with a patch, numbered among all findings (from 1), not among the patched."""
    return found.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).filter("unified_diff IS NOT NULL")


def monitor(rows: DataFrame) -> DataFrame:
    """State of a running job from its log rows (done boolean, failed boolean, seconds, ts): counts, rate, average."""
    wall = F.greatest(F.unix_micros(F.max("ts")) / 1e6 - F.unix_micros(F.min("ts")) / 1e6, F.lit(1e-6))
    return rows.agg(F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if("failed").alias("failed"), F.round(F.count_if("done") / wall, 9).alias("rate"), F.round(F.coalesce(F.avg("seconds"), F.lit(0.0)), 6).alias("avg_seconds"))
