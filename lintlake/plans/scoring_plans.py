"""Queries that score findings against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.dims import MODES
from lintlake.operators import matching
from lintlake.operators import scoring as ops
from lintlake.plans.base import TRUTH_SQL, findings, query, truth
from lintlake.session import table

_MODES = "(SELECT 'all' AS mode UNION ALL SELECT 'visible' UNION ALL SELECT 'high-confidence') AS ms"
_IN_MODE = "(mode = 'all' OR (mode = 'visible' AND coalesce(triage_status, '') <> 'suppressed') OR (mode = 'high-confidence' AND triage_status IN ('confirmed', 'likely')))"
#: Every eleventh case is reported under another family, so that unexpected cases occur.
_PRED_SQL = f"pred AS (SELECT DISTINCT mode, CASE WHEN doc_id % 11 = 0 THEN 'en' ELSE language END AS family, doc_id AS case_id FROM f JOIN {_MODES} ON {_IN_MODE})"
_COUNTS_SQL = f"""{_PRED_SQL}, {TRUTH_SQL}, t AS (SELECT mode, family, case_id, vulnerable FROM truth, (SELECT DISTINCT mode FROM pred)), j AS (SELECT mode, family, p.case_id IS NOT NULL AS h, vulnerable AS v FROM (SELECT *, 1 AS one FROM pred) p FULL OUTER JOIN t USING (mode, family, case_id)),
    counts AS (SELECT mode, family, count(*) FILTER (WHERE h AND v) AS tp, count(*) FILTER (WHERE h AND NOT coalesce(v, false)) AS fp, count(*) FILTER (WHERE NOT h AND v) AS fn, count(*) FILTER (WHERE NOT h AND NOT v) AS tn, count(*) FILTER (WHERE h AND v IS NULL) AS unexpected FROM j GROUP BY mode, family)"""
_COUNTS_SQL = _COUNTS_SQL.replace("p.case_id IS NOT NULL AS h", "one IS NOT NULL AS h")


def metrics(places: int | None = 4, accuracy: bool = False) -> str:
    r = lambda a, b: f"CASE WHEN ({b}) <= 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / ({b}) END"
    rnd = lambda e: f"round({e}, {places})" if places is not None else e
    out = f"{rnd(r('tp', 'tp + fp'))} AS precision, {rnd(r('tp', 'tp + fn'))} AS recall, {rnd(r('2 * tp', '2 * tp + fp + fn'))} AS f1"
    return out + (f", {rnd(r('tp + tn', 'tp + fp + fn + tn'))} AS accuracy" if accuracy else "")


def predictions(spark, d):
    f = findings(spark, d).select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 11 == 0, "en").otherwise(F.col("language")).alias("family"), "triage_status")
    return matching.by_mode(f).select("mode", "family", "case_id")


def counts(spark, d):
    return ops.confusion(predictions(spark, d), truth(spark, d), "mode", MODES)


@query("a10_score_by_family_mode")
def a10(spark, d):
    return ops.with_metrics(counts(spark, d))


@query("a11_micro_average")
def a11(spark, d):
    return ops.micro(counts(spark, d), "mode")


@query("a12_fp_reduction")
def a12(spark, d):
    return ops.fp_reduction(counts(spark, d))


@query("u5_set_algebra")
def u5(spark, d):
    """TP, FP, FN, TN by intersect, except and union of case sets."""
    from functools import reduce

    p = predictions(spark, d).filter("mode = 'visible'").select("case_id").distinct()
    t = truth(spark, d)
    pos, neg = t.filter("vulnerable").select("case_id"), t.filter("NOT vulnerable").select("case_id")
    every = t.select("case_id")
    parts = [("tp", p.intersect(pos)), ("fp", p.intersect(neg)), ("fn", pos.subtract(p)), ("tn", neg.subtract(p)), ("unexpected", p.subtract(every)), ("union", p.union(every).distinct())]
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts])


@query("j13_findings_with_truth", findings_sql=f"SELECT case_id, family, vulnerable, n FROM (SELECT doc_id AS case_id, count(*) AS n FROM f GROUP BY 1) JOIN truth USING (case_id)")
def j13(spark, d):
    n = findings(spark, d).groupBy(F.col("doc_id").alias("case_id")).agg(F.count("*").alias("n"))
    return n.join(truth(spark, d), "case_id").select("case_id", "family", "vulnerable", "n")


@query("a13_ablation_metrics")
def a13(spark, d):
    f = findings(spark, d)
    tiers = F.array(F.lit("linear"), F.when(F.col("steps") > 0, "graph"), F.when((F.col("steps") > 0) & ~F.col("sanitized"), "summary"))
    p = f.select(F.explode(F.array_compact(tiers)).alias("tier"), F.col("language").alias("family"), F.col("doc_id").alias("case_id"))
    total = ops.confusion(p, truth(spark, d), "tier", ("linear", "graph", "summary")).groupBy("tier").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return ops.with_metrics(total, None, True)


_TIERS = "tiers AS (SELECT DISTINCT tier, language AS family, doc_id AS case_id FROM f, (SELECT 'linear' AS tier UNION ALL SELECT 'graph' UNION ALL SELECT 'summary') WHERE tier = 'linear' OR (tier = 'graph' AND steps > 0) OR (tier = 'summary' AND steps > 0 AND NOT sanitized))"


@query("a14_kept_vs_truth")
def a14(spark, d):
    j = findings(spark, d).join(truth(spark, d).withColumnRenamed("case_id", "doc_id"), "doc_id", "left")
    j = j.withColumn("ai_status", F.when(F.col("ai_vulnerable").isNull(), F.col("triage_status")).when(~F.col("ai_vulnerable"), "suppressed").otherwise("likely"))
    return ops.kept_confusion(j, {"core": "triage_status", "ai": "ai_status"})


@query("a15_totals_cube")
def a15(spark, d):
    f = matching.by_mode(findings(spark, d))
    return f.cube("mode", "language", "source").agg(F.count("*").alias("n"), F.count_if(F.col("sanitized")).alias("n_sanitized"))


@query("a16_pair_scores")
def a16(spark, d):
    return _pairs(spark, d, False)


@query("a16_pair_scores_official")
def a16o(spark, d):
    return _pairs(spark, d, True)


def _pairs(spark, d, official):
    docs = table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id")
    pairs = docs.select(F.col("doc_id").cast("string").alias("case_id"), F.concat(F.lit("CWE-"), (F.col("doc_id") % 6).cast("string")).alias("cwe"), F.col("doc_id").cast("string").alias("vul_file"), F.when(F.col("doc_id") % 10 > 0, (F.col("doc_id") + 1).cast("string")).alias("fix_file"), F.concat(F.lit("fn"), (F.col("doc_id") % 3).cast("string")).alias("scope"))
    hits = findings(spark, d).select(F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("CWE-"), ((F.col("doc_id") - F.col("doc_id") % 2) % 6).cast("string")).alias("cwe"), F.concat(F.lit("fn"), (F.col("line_number") % 3).cast("string")).alias("scope"))
    return ops.pair_scores(hits, pairs, official)


def _pairs_sql(official):
    scope = "AND h.scope = p.scope" if official else ""
    return f"""pairs AS (SELECT doc_id, 'CWE-' || (doc_id % 6) AS cwe, doc_id AS vul, CASE WHEN doc_id % 10 > 0 THEN doc_id + 1 END AS fix, 'fn' || (doc_id % 3) AS scope FROM documents WHERE doc_id % 2 = 0),
    h AS (SELECT DISTINCT doc_id AS file, 'CWE-' || ((doc_id - doc_id % 2) % 6) AS cwe, 'fn' || (line_number % 3) AS scope FROM f),
    s AS (SELECT cwe, fix, EXISTS (SELECT 1 FROM h WHERE h.file = p.vul AND h.cwe = p.cwe {scope}) AS v, EXISTS (SELECT 1 FROM h WHERE h.file = p.fix AND h.cwe = p.cwe {scope}) AS x FROM pairs p),
    c AS (SELECT cwe, count(*) FILTER (WHERE v) AS tp, count(*) FILTER (WHERE fix IS NOT NULL AND x) AS fp, count(*) FILTER (WHERE NOT v) AS fn, count(*) FILTER (WHERE fix IS NOT NULL AND NOT x) AS tn FROM s GROUP BY cwe)"""


@query("j19_pair_files", sql="SELECT v.doc_id AS vul, x.doc_id AS fix FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) v LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 > 0) x ON x.doc_id = v.doc_id + 1")
def j19(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    v, x = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("vul")), docs.filter("doc_id % 2 = 1 AND doc_id % 5 > 0").select(F.col("doc_id").alias("fix"))
    return v.join(x, F.col("fix") == F.col("vul") + 1, "left")


@query("a17_suite_status", findings_sql="SELECT c.doc_id, coalesce(n, 0) AS n_findings, CASE WHEN vulnerable AND coalesce(n, 0) > 0 THEN 'TP' WHEN vulnerable THEN 'FN' WHEN coalesce(n, 0) > 0 THEN 'FP' ELSE 'TN' END AS status FROM (SELECT doc_id, (quality = 0 OR toxic = 1) AS vulnerable FROM labels) c LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY 1) USING (doc_id)")
def a17(spark, d):
    n = findings(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    c = table(spark, d, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("v")).join(n, "doc_id", "left")
    some = F.coalesce("n", F.lit(0)) > 0
    return c.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_findings"), F.when(F.col("v") & some, "TP").when(F.col("v"), "FN").when(some, "FP").otherwise("TN").alias("status"))


@query("a18_ablation_coverage", findings_sql="SELECT language, count(DISTINCT doc_id) AS targets, count(*) AS n, round(avg(steps + 2), 4) AS avg_depth, max(steps + 2) AS max_depth, round(CAST(count(*) FILTER (WHERE triage_status = 'suppressed') AS DOUBLE) / count(*), 4) AS suppressed_ratio FROM f GROUP BY language")
def a18(spark, d):
    return findings(spark, d).groupBy("language").agg(F.count_distinct("doc_id").alias("targets"), F.count("*").alias("n"), F.round(F.avg(F.col("steps") + 2), 4).alias("avg_depth"), F.max(F.col("steps") + 2).alias("max_depth"), F.round(F.count_if(F.col("triage_status") == "suppressed") / F.count("*"), 4).alias("suppressed_ratio"))


_LABELS_SQL = "lab AS (SELECT file_path, vulnerability_type AS family, row_number() OVER (PARTITION BY file_path ORDER BY line_number, vulnerability_type, ordinal) AS label_idx, line_number AS start_line, line_number + 1 AS end_line, k % 4 > 0 AS is_vulnerable FROM f WHERE k % 3 = 0)"


def _labels(f):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("file_path").orderBy("line_number", "vulnerability_type", "ordinal"))
    return f.filter("k % 3 = 0").select("file_path", "family", idx.alias("label_idx"), F.col("line_number").alias("start_line"), (F.col("line_number") + 1).alias("end_line"), (F.col("k") % 4 > 0).alias("is_vulnerable"))


@query("j12_range_first_match")
def j12(spark, d):
    f = findings(spark, d).withColumn("family", F.col("vulnerability_type"))
    return matching.first_match(f, _labels(f), 2)


@query("j12_label_outcomes")
def j12l(spark, d):
    """Labels with and without findings: hits, misses, and what was rightly or wrongly left alone. Only every second finding is reported, so that labels are missed too."""
    f = findings(spark, d).withColumn("family", F.col("vulnerability_type"))
    labels = _labels(f)
    return matching.label_outcomes(matching.first_match(f.filter("k % 2 = 0"), labels, 0), labels)


@query("j14_ai_report_truth", findings_sql=f"SELECT a.finding_id, a.ai_status, f.triage_status, t.vulnerable FROM (SELECT finding_id, CASE WHEN ai_vulnerable THEN 'likely' ELSE 'suppressed' END AS ai_status FROM f WHERE ai_vulnerable IS NOT NULL) a JOIN f USING (finding_id) LEFT JOIN truth t ON t.case_id = f.doc_id")
def j14(spark, d):
    f = findings(spark, d)
    a = f.filter("ai_vulnerable IS NOT NULL").select("finding_id", F.when(F.col("ai_vulnerable"), "likely").otherwise("suppressed").alias("ai_status"))
    return a.join(f.select("finding_id", "doc_id", "triage_status"), "finding_id").join(truth(spark, d).withColumnRenamed("case_id", "doc_id"), "doc_id", "left").select("finding_id", "ai_status", "triage_status", "vulnerable")


def _register():
    from lintlake.plans.base import FINDINGS_SQL, ORACLE_SQL

    w = f"WITH {FINDINGS_SQL}, {_COUNTS_SQL}"
    ORACLE_SQL["a10_score_by_family_mode"] = f"{w} SELECT *, {metrics()} FROM counts"
    ORACLE_SQL["a11_micro_average"] = f"{w} SELECT *, {metrics()} FROM (SELECT mode, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM counts GROUP BY mode)"
    cut = lambda m: f"round(CASE WHEN fa <= 0 THEN 0.0::DOUBLE ELSE (fa - coalesce({m}, 0)) * 100.0::DOUBLE / fa END, 2)"
    ORACLE_SQL["a12_fp_reduction"] = f"{w} SELECT family, CAST(fa AS BIGINT) AS fp_all, {cut('fv')} AS visible_reduction, {cut('fh')} AS high_reduction FROM (SELECT family, sum(fp) FILTER (WHERE mode = 'all') AS fa, sum(fp) FILTER (WHERE mode = 'visible') AS fv, sum(fp) FILTER (WHERE mode = 'high-confidence') AS fh FROM counts GROUP BY family)"
    sets = "p AS (SELECT DISTINCT case_id FROM pred WHERE mode = 'visible'), pos AS (SELECT case_id FROM truth WHERE vulnerable), neg AS (SELECT case_id FROM truth WHERE NOT vulnerable)"
    parts = {"tp": "p INTERSECT SELECT case_id FROM pos", "fp": "p INTERSECT SELECT case_id FROM neg", "fn": "pos EXCEPT SELECT case_id FROM p", "tn": "neg EXCEPT SELECT case_id FROM p", "unexpected": "p EXCEPT SELECT case_id FROM truth", "union": "p UNION SELECT case_id FROM truth"}
    ORACLE_SQL["u5_set_algebra"] = f"WITH {FINDINGS_SQL}, {_PRED_SQL}, {TRUTH_SQL}, {sets} " + " UNION ALL ".join(f"SELECT '{k}' AS part, count(*) AS n FROM (SELECT case_id FROM {v})" for k, v in parts.items())
    for name in ("j13_findings_with_truth", "j14_ai_report_truth"):
        ORACLE_SQL[name] = ORACLE_SQL[name].replace(FINDINGS_SQL, f"{FINDINGS_SQL}, {TRUTH_SQL}")
    ORACLE_SQL["a13_ablation_metrics"] = f"""WITH {FINDINGS_SQL}, {TRUTH_SQL}, {_TIERS}, t AS (SELECT tier, family, case_id, vulnerable FROM truth, (SELECT DISTINCT tier FROM tiers)), j AS (SELECT tier, one IS NOT NULL AS h, vulnerable AS v FROM (SELECT *, 1 AS one FROM tiers) FULL OUTER JOIN t USING (tier, family, case_id)),
        c AS (SELECT tier, count(*) FILTER (WHERE h AND v) AS tp, count(*) FILTER (WHERE h AND NOT coalesce(v, false)) AS fp, count(*) FILTER (WHERE NOT h AND v) AS fn, count(*) FILTER (WHERE NOT h AND NOT v) AS tn FROM j GROUP BY tier) SELECT *, {metrics(None, True)} FROM c"""
    ORACLE_SQL["a14_kept_vs_truth"] = f"""WITH {FINDINGS_SQL}, {TRUTH_SQL}, j AS (SELECT triage_status AS core, CASE WHEN ai_vulnerable IS NULL THEN triage_status WHEN NOT ai_vulnerable THEN 'suppressed' ELSE 'likely' END AS ai, vulnerable AS v FROM f JOIN truth ON case_id = doc_id),
        s AS (SELECT 'core' AS column_name, core AS st, v FROM j UNION ALL SELECT 'ai', ai, v FROM j), c AS (SELECT column_name, count(*) FILTER (WHERE st <> 'suppressed' AND v) AS tp, count(*) FILTER (WHERE st <> 'suppressed' AND NOT v) AS fp, count(*) FILTER (WHERE st = 'suppressed' AND v) AS fn, count(*) FILTER (WHERE st = 'suppressed' AND NOT v) AS tn FROM s GROUP BY 1) SELECT *, {metrics()} FROM c"""
    ORACLE_SQL["a15_totals_cube"] = f"WITH {FINDINGS_SQL} SELECT mode, language, source, count(*) AS n, count(*) FILTER (WHERE sanitized) AS n_sanitized FROM f JOIN {_MODES} ON {_IN_MODE} GROUP BY CUBE (mode, language, source)"
    for name, official in (("a16_pair_scores", False), ("a16_pair_scores_official", True)):
        ORACLE_SQL[name] = f"WITH {FINDINGS_SQL}, {_pairs_sql(official)} SELECT *, {metrics()} FROM c"
    ORACLE_SQL["j12_range_first_match"] = f"""WITH {FINDINGS_SQL}, {_LABELS_SQL}, h AS (SELECT finding_id, f.file_path, vulnerability_type AS family, ordinal, l.label_idx, l.is_vulnerable, row_number() OVER (PARTITION BY finding_id ORDER BY l.label_idx NULLS LAST) AS n FROM f LEFT JOIN lab l ON l.file_path = f.file_path AND l.family = f.vulnerability_type AND f.line_number BETWEEN l.start_line - 2 AND l.end_line + 2 WHERE f.file_path IN (SELECT file_path FROM lab)),
        o AS (SELECT *, row_number() OVER (PARTITION BY file_path, label_idx ORDER BY ordinal) AS nth FROM h WHERE n = 1) SELECT finding_id, file_path, family, CAST(label_idx AS INTEGER) AS label_idx, CASE WHEN label_idx IS NULL OR NOT is_vulnerable THEN 'fp' WHEN nth = 1 THEN 'tp' ELSE 'duplicate' END AS outcome FROM o"""
    ORACLE_SQL["j12_label_outcomes"] = f"""WITH {FINDINGS_SQL}, {_LABELS_SQL}, h AS (SELECT finding_id, f.file_path, l.label_idx, row_number() OVER (PARTITION BY finding_id ORDER BY l.label_idx NULLS LAST) AS n FROM f LEFT JOIN lab l ON l.file_path = f.file_path AND l.family = f.vulnerability_type AND f.line_number BETWEEN l.start_line AND l.end_line WHERE k % 2 = 0),
        c AS (SELECT file_path, label_idx, count(*) AS n FROM h WHERE n = 1 AND label_idx IS NOT NULL GROUP BY ALL)
        SELECT lab.file_path, CAST(lab.label_idx AS INTEGER) AS label_idx, coalesce(c.n, 0) AS n_findings, CASE WHEN is_vulnerable THEN CASE WHEN c.n > 0 THEN 'TP' ELSE 'FN' END WHEN c.n > 0 THEN 'FP' ELSE 'TN' END AS outcome FROM lab LEFT JOIN c ON c.file_path = lab.file_path AND c.label_idx = lab.label_idx"""


_register()
