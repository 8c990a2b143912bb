"""Queries of triage: routes, cascade, review roles, gates and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import investigation
from lintlake.operators import triage as ops
from lintlake.plans.base import FINDINGS_SQL, findings, query

_SEVERE = "severity IN ('CRITICAL', 'HIGH')"


@query("t1_route", findings_sql="SELECT finding_id, CASE WHEN confidence >= 0.85 AND NOT sanitized THEN 'direct-judge' ELSE 'skeptic-review' END AS route FROM f")
def t1(spark, d):
    return ops.route(findings(spark, d)).select("finding_id", "route")


_KINDS = "('CODE_INJECTION', 'INSECURE_DESERIALIZATION', 'PATH_TRAVERSAL', 'SQL_INJECTION', 'COMMAND_INJECTION')"
_FLOOR = "CASE vulnerability_type WHEN 'PATH_TRAVERSAL' THEN 0.68::DOUBLE WHEN 'COMMAND_INJECTION' THEN 0.70::DOUBLE ELSE 0.74::DOUBLE END"
_CASCADE = f"""c AS (SELECT *, CASE WHEN sanitized AND triage_status = 'confirmed' THEN 'sanitized-confirmed' WHEN sanitized AND triage_status IN ('likely', 'needs-review') THEN 'sanitized' WHEN sanitized THEN 'sanitized-kept'
    WHEN source_type IN ('COMMAND_LINE_ARGS', 'ENVIRONMENT_VAR') AND (vulnerability_type IN ('PATH_TRAVERSAL', 'MASS_ASSIGNMENT') OR (vulnerability_type = 'COMMAND_INJECTION' AND sink_function = 'subprocess.run' AND k % 5 > 0)) THEN 'local-operator-source'
    WHEN source_type IN ('COMMAND_LINE_ARGS', 'ENVIRONMENT_VAR') AND triage_status = 'needs-review' THEN 'local-operator-review' WHEN triage_status = 'needs-review' AND (vulnerability_type = 'OPEN_REDIRECT' OR (vulnerability_type = 'PATH_TRAVERSAL' AND k % 9 IN (0, 4))) THEN 'ambiguous-sink'
    WHEN triage_status = 'needs-review' AND (2 + steps + n_sanitizers >= 3 OR steps > 0) AND vulnerability_type IN {_KINDS} THEN 'promoted-likely' WHEN triage_status = 'needs-review' AND {_SEVERE} THEN 'severe-floor' ELSE 'unchanged' END AS reason FROM f),
    n AS (SELECT *, CASE reason WHEN 'sanitized-confirmed' THEN 'needs-review' WHEN 'sanitized' THEN 'suppressed' WHEN 'local-operator-source' THEN 'suppressed' WHEN 'promoted-likely' THEN 'likely' ELSE triage_status END AS new_status,
    CASE reason WHEN 'sanitized-confirmed' THEN least(confidence, 0.65) WHEN 'sanitized' THEN least(confidence, 0.40) WHEN 'local-operator-source' THEN least(confidence, 0.35) WHEN 'local-operator-review' THEN greatest(0.45, least(0.55, confidence)) WHEN 'ambiguous-sink' THEN greatest(0.55, least(0.62, confidence)) WHEN 'promoted-likely' THEN greatest(confidence, {_FLOOR}) WHEN 'severe-floor' THEN greatest(confidence, 0.60) ELSE confidence END AS new_confidence FROM c)"""


def _with(ctes: str, body: str) -> str:
    from lintlake.plans.base import FINDINGS_SQL

    return f"WITH {FINDINGS_SQL}, {ctes} {body}"


def _cascaded(spark, d):
    """Every ninth path sink only asks whether a path exists (sinks of other types stay what they are), and every other ninth sink says so in its pattern, which matters to paths only."""
    k = F.col("k") % 9
    f = findings(spark, d).withColumn("shell", ~(F.col("k") % 5 > 0)).withColumn("path_length", 2 + F.col("steps") + F.col("n_sanitizers"))
    f = f.withColumn("sink_function", F.when((k == 0) & (F.col("vulnerability_type") == "PATH_TRAVERSAL"), "os.path.Exists").otherwise(F.col("sink_function"))).withColumn("sink_pattern", F.when(k == 4, "p.exists(").otherwise(F.col("sink_pattern")))
    return ops.cascade(f)


@query("t2_cascade", sql=_with(_CASCADE, f"SELECT finding_id, reason, new_status, round(CAST(new_confidence AS DOUBLE), 6) AS new_confidence, new_status = 'needs-review' OR (new_status = 'suppressed' AND {_SEVERE}) AS manual_review FROM n"))
def t2(spark, d):
    return _cascaded(spark, d).select("finding_id", "reason", "new_status", F.round("new_confidence", 6).alias("new_confidence"), "manual_review")


_SCORE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + least(steps * 0.12::DOUBLE, 0.24) + least(confidence * 0.35::DOUBLE, 0.35) + 0.08 + CASE WHEN k % 4 > 0 THEN 0.08 ELSE 0 END - CASE WHEN n_sanitizers > 0 THEN 0.14 ELSE 0 END + CASE WHEN steps > 1 THEN 0.04 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.04 ELSE 0 END))"


def _scored(f):
    return ops.evidence_score(f.withColumns({"source_file": F.col("file_path"), "sink_file": F.when(F.col("k") % 4 > 0, F.col("file_path")).otherwise(""), "cfg_edges": F.col("steps") - 1, "dfg_edges": F.when(F.col("k") % 2 == 0, 1).otherwise(0)}))


@query("t3_evidence_score", findings_sql=f"SELECT finding_id, round({_SCORE}, 6) AS evidence_score FROM f")
def t3(spark, d):
    return _scored(findings(spark, d)).select("finding_id", F.round("evidence_score", 6).alias("evidence_score"))


_TOKENS = ("escape", "sanit", "license", "tion")
_MIT = "(contains(lower(snippet), 'escape') OR contains(lower(snippet), 'sanit') OR contains(lower(snippet), 'license'))"
_ROUTE = "CASE WHEN confidence >= 0.85 AND NOT sanitized THEN 'direct-judge' ELSE 'skeptic-review' END"
_SKEPTIC = f"""s0 AS (SELECT *, {_ROUTE} AS route, {_MIT} AS mit, {_SCORE} AS evidence_score FROM f), s1 AS (SELECT *, route = 'skeptic-review' AND mit AS hit, route = 'skeptic-review' AND mit AND {_SEVERE} AND triage_status = 'confirmed' AS guarded, route = 'skeptic-review' AND NOT mit AND triage_status <> 'suppressed' AND confidence < 0.60 AS weak FROM s0),
    s AS (SELECT *, route = 'skeptic-review' AS executed, CASE WHEN guarded THEN 'needs-review' WHEN hit THEN 'suppressed' WHEN weak THEN 'needs-review' END AS suggested, CASE WHEN guarded THEN 0.65::DOUBLE WHEN hit THEN 0.45::DOUBLE WHEN weak THEN 0.55::DOUBLE END AS cap FROM s1)"""


def _reviewed(spark, d):
    f = ops.route(_scored(findings(spark, d))).withColumn("mitigations", ops.tokens_in(F.col("snippet"), _TOKENS[:3]))
    return ops.skeptic(f)


@query("t4_skeptic", sql=_with(_SKEPTIC, "SELECT finding_id, executed, suggested, cap, weak AS objection FROM s"))
def t4(spark, d):
    return _reviewed(spark, d).select("finding_id", "executed", "suggested", "cap", "objection")


_JUDGE = f"""{_SKEPTIC}, j0 AS (SELECT *, CASE WHEN executed THEN coalesce(suggested, triage_status) ELSE triage_status END AS st, CASE WHEN executed AND cap IS NOT NULL THEN least(confidence, cap) ELSE confidence END AS cf, executed AND NOT mit AND NOT weak AND NOT sanitized AND {_SEVERE} AND evidence_score >= 0.70 AS clean, k % 3 AS signals FROM s),
    j AS (SELECT *, clean AND st IN ('likely', 'needs-review') AND vulnerability_type = 'SQL_INJECTION' AND signals >= 2 AS sure, clean AND st = 'needs-review' AND signals >= 1 AS maybe FROM j0)"""


@query("t5_judge", sql=_with(_JUDGE, "SELECT finding_id, CASE WHEN sure THEN 'confirmed' WHEN maybe THEN 'likely' ELSE st END AS final_status, round(CASE WHEN sure THEN greatest(cf, greatest(0.88, least(0.96, evidence_score))) WHEN maybe THEN greatest(cf, greatest(0.72, least(0.85, evidence_score))) ELSE cf END, 6) AS final_confidence, CASE WHEN sure THEN 'confirmed' WHEN maybe THEN 'likely' END AS promoted FROM j"))
def t5(spark, d):
    signals = F.slice(F.array(F.lit("dynamic-sql-construction"), F.lit("query-executed-directly")), 1, (F.col("k") % 3).cast("int"))
    return ops.judge(_reviewed(spark, d).withColumn("risk_signals", signals)).select("finding_id", "final_status", F.round("final_confidence", 6).alias("final_confidence"), "promoted")


_CTX = "CASE k % 4 WHEN 0 THEN 'query = \"SELECT * FROM t WHERE a=\" + x; cursor.execute(query)' WHEN 1 THEN 'os.system(cmd)' WHEN 2 THEN 'subprocess.run(c, shell=True)' ELSE 'cursor.execute(q)' END"


@query("t6_risk_signals", findings_sql="""SELECT finding_id, concat_ws(',', CASE WHEN vulnerability_type = 'SQL_INJECTION' AND k % 4 = 0 THEN 'dynamic-sql-construction' END, CASE WHEN vulnerability_type = 'SQL_INJECTION' AND k % 4 IN (0, 3) THEN 'query-executed-directly' END,
    CASE WHEN vulnerability_type = 'COMMAND_INJECTION' AND k % 4 = 1 THEN 'dangerous-shell-invocation' END, CASE WHEN vulnerability_type = 'COMMAND_INJECTION' AND k % 4 = 2 THEN 'shell-true-enabled' END) AS signals FROM f""")
def t6(spark, d):
    texts = ('query = "SELECT * FROM t WHERE a=" + x; cursor.execute(query)', "os.system(cmd)", "subprocess.run(c, shell=True)", "cursor.execute(q)")
    ctx = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % 4 + 1).cast("int"))
    return findings(spark, d).select("finding_id", F.array_join(ops.risk_signals(F.col("vulnerability_type"), ctx), ",").alias("signals"))


#: Replies of every kind, put together from a finding's number: words for a status, verdicts, confidences, and prose around.
_WORDS = ("TP", "False Positive", "needs_review", " Review ", "LIKELY", "confirmed", "suppressed", "odd", "", "true_positive", "fp", "NeedsReview")
_VERDICTS = ("true", "false", '"Yes"', '"no"', "1", "0", "null", '"y"', "2.5")
_CONFIDENCES = ("90", "-1", '"0.9"', '"high"', "0.25")
_STATUS_SQL = "CASE k % 12 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suppressed' WHEN 2 THEN 'needs-review' WHEN 3 THEN 'needs-review' WHEN 4 THEN 'likely' WHEN 5 THEN 'confirmed' WHEN 6 THEN 'suppressed' WHEN 9 THEN 'confirmed' WHEN 10 THEN 'suppressed' WHEN 11 THEN 'needs-review' END"


@query("t7_parse_decisions", findings_sql=f"SELECT finding_id, CASE WHEN k % 11 > 0 THEN coalesce(word, CASE WHEN k % 9 IN (0, 2, 4, 7, 8) THEN CASE WHEN conf >= 0.85 THEN 'confirmed' ELSE 'likely' END ELSE 'suppressed' END) END AS status, CASE WHEN k % 11 > 0 THEN conf END AS confidence, k % 11 = 0 AS failed FROM (SELECT finding_id, k, {_STATUS_SQL} AS word, CASE k % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS conf FROM f)")
def t7(spark, d):
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("k") % len(xs) + 1).cast("int"))
    body = F.concat(F.lit('{"status": "'), at(_WORDS), F.lit('", "is_vulnerable": '), at(_VERDICTS), F.lit(', "confidence": '), at(_CONFIDENCES), F.lit("}"))
    reply = F.when(F.col("k") % 11 == 0, at(("no json at all", '{"status": "TP"', "[1, 2]", ""))).when(F.col("k") % 3 == 0, F.concat(F.lit("```JSON\n"), body, F.lit("\n``` so far"))).when(F.col("k") % 3 == 1, F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise(body)
    return findings(spark, d).select("finding_id", ops.parse_decision(reply).alias("x")).select("finding_id", "x.*")


_GATED = """g AS (SELECT *, k % 13 > 0 AS llm_enabled, k % 11 = 0 AS proved_safe, CAST(k % 10 AS DOUBLE) / 10 AS quality, CAST(steps AS INTEGER) AS path_len, k % 2 = 0 AS has_source, k % 3 > 0 AS has_sink FROM f),
    e AS (SELECT *, CASE WHEN NOT llm_enabled THEN 'ai_mode_off' WHEN proved_safe THEN 'static_heuristic_proved_safe' WHEN CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END < 1 THEN 'severity_below_minimum' WHEN quality < 0.3 THEN 'insufficient_evidence_for_llm' WHEN path_len = 0 AND NOT (has_source AND has_sink) THEN 'no_source_sink_or_path' END AS deny_reason,
    0.35::DOUBLE * (CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END / 3.0::DOUBLE) + 0.25::DOUBLE * confidence + 0.20::DOUBLE * least(1.0::DOUBLE, CASE WHEN path_len > 0 AND has_source AND has_sink THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN path_len > 0 AND n_sanitizers = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN vulnerability_type IN ('SQL_INJECTION', 'COMMAND_INJECTION') THEN 0.2::DOUBLE ELSE 0 END)
    + 0.10::DOUBLE * (1.0::DOUBLE - abs(confidence - 0.5) * 2.0::DOUBLE) + 0.10::DOUBLE * CASE WHEN path_len > 0 THEN 0.5::DOUBLE * least((k % 4) / 3.0::DOUBLE, 1.0) + 0.5::DOUBLE * least(path_len / 8.0::DOUBLE, 1.0) ELSE 0.0 END AS priority FROM g)"""


def _gated(spark, d):
    k = F.col("k")
    f = findings(spark, d).withColumns({"llm_enabled": k % 13 > 0, "proved_safe": k % 11 == 0, "evidence_quality": (k % 10) / 10, "path_len": F.col("steps"), "has_source": k % 2 == 0, "has_sink": k % 3 > 0, "n_files": k % 4 + 1, "high_impact": F.col("vulnerability_type").isin("SQL_INJECTION", "COMMAND_INJECTION")})
    return ops.priority(ops.eligibility(f))


@query("t8_eligibility", sql=_with(_GATED, "SELECT finding_id, deny_reason FROM e"))
def t8(spark, d):
    return _gated(spark, d).select("finding_id", "deny_reason")


@query("o10_priority", sql=_with(_GATED, "SELECT finding_id, round(priority, 6) AS priority FROM e"))
def o10(spark, d):
    return _gated(spark, d).select("finding_id", F.round("priority", 6).alias("priority"))


@query("w6_budget_gate", sql=_with(f"""{_GATED}, r AS (SELECT finding_id, file_path, round(priority, 6) AS p FROM e WHERE deny_reason IS NULL), x AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY p DESC, finding_id) AS nf FROM r), y AS (SELECT *, sum(CASE WHEN nf <= 2 THEN 1 ELSE 0 END) OVER (ORDER BY p DESC, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM x)""",
    "SELECT finding_id, CASE WHEN coalesce(used, 0) >= 40 THEN 'scan_llm_budget_exhausted' WHEN nf > 2 THEN 'file_llm_budget_exhausted' ELSE 'eligible' END AS gate FROM y"))
def w6(spark, d):
    f = _gated(spark, d).filter("deny_reason IS NULL").withColumn("priority", F.round("priority", 6))
    return ops.budget_gate(f, 40, 2).select("finding_id", "gate")


_POLICY = "p AS (SELECT *, CASE WHEN k % 4 < 3 THEN 'suppressed' ELSE 'likely' END AS proposed, k % 9 = 0 AS llm_failed, k % 5 = 0 AS override, k % 7 > 0 AS validator, k % 3 > 0 AS proved_safe, k % 8 = 0 AS insufficient, k % 11 > 0 AS grounded, k % 13 = 0 AS disagree FROM f)"


@query("t9_suppression_policy", sql=_with(f"""{_POLICY}, v AS (SELECT finding_id, proposed, CASE WHEN proposed <> 'suppressed' AND llm_failed THEN 'llm_failed_noted' WHEN proposed <> 'suppressed' THEN 'not_a_suppression' WHEN llm_failed THEN 'fail_open_enforced' WHEN {_SEVERE} AND NOT override THEN 'high_critical_no_auto_suppress' WHEN {_SEVERE} AND NOT (validator AND proved_safe) THEN 'high_critical_requires_validator_proof'
    WHEN NOT grounded THEN 'suppression_without_grounded_evidence' WHEN NOT validator THEN 'suppression_without_validator' WHEN insufficient THEN 'insufficient_evidence' WHEN NOT proved_safe THEN 'no_static_proof_of_safety' WHEN disagree THEN 'unresolved_disagreement' ELSE 'suppression_allowed_with_evidence' END AS event FROM p)""",
    "SELECT finding_id, event, CASE WHEN proposed = 'suppressed' AND event <> 'suppression_allowed_with_evidence' THEN 'needs-review' ELSE proposed END AS policy_status FROM v"))
def t9(spark, d):
    k = F.col("k")
    f = findings(spark, d).withColumns({"proposed": F.when(k % 4 < 3, "suppressed").otherwise("likely"), "llm_failed": k % 9 == 0, "override": k % 5 == 0, "validator": k % 7 > 0, "proved_safe": k % 3 > 0, "insufficient": k % 8 == 0, "grounded": k % 11 > 0, "disagree": k % 13 == 0})
    return ops.suppression(f).select("finding_id", "event", "policy_status")


@query("t9_grounded_citations", findings_sql="SELECT finding_id, len(list_filter(['src/' || source || '/f' || doc_id || '.js', 'f' || (doc_id + k % 2) || '.js'], lambda c: ends_with(file_path, c) OR ends_with(c, file_path))) > 0 AS grounded FROM f")
def t9g(spark, d):
    """A citation is grounded when it and the evidence's file are suffixes of one another, either way."""
    cites = F.array(F.concat_ws("", F.lit("src/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".js")), F.concat(F.lit("f"), (F.col("doc_id") + F.col("k") % 2).cast("string"), F.lit(".js")))
    return findings(spark, d).select("finding_id", F.exists(cites, lambda c: F.col("file_path").endswith(c) | c.endswith(F.col("file_path"))).alias("grounded"))


@query("t11_next_node", findings_sql="SELECT finding_id, CASE WHEN k % 9 = 0 OR k % 4 >= 2 OR k % 15 >= 12 OR NOT (k % 2 = 0 OR k % 3 = 0) OR steps <= n_sanitizers THEN 'judge' ELSE 'reinvestigate' END AS next_node FROM f")
def t11(spark, d):
    k = F.col("k")
    f = findings(spark, d).withColumns({"llm_failed": k % 9 == 0, "rounds": k % 4, "tool_calls": k % 15, "disagree": k % 2 == 0, "insufficient": k % 3 == 0, "evidence": F.col("steps"), "evidence_before": F.col("n_sanitizers")})
    return ops.next_node(f).select("finding_id", "next_node")


@query("t12_trajectory_features", findings_sql="SELECT finding_id, steps + 2 AS n_steps, n_sanitizers > 0 AS has_sanitizer, length(snippet) AS snippet_chars, round(confidence - coalesce(ai_confidence, confidence), 6) AS confidence_shift FROM f")
def t12(spark, d):
    return findings(spark, d).select("finding_id", (F.col("steps") + 2).alias("n_steps"), (F.col("n_sanitizers") > 0).alias("has_sanitizer"), F.length("snippet").cast("long").alias("snippet_chars"), F.round(F.col("confidence") - F.coalesce("ai_confidence", "confidence"), 6).alias("confidence_shift"))


@query("t7b_service_verdict", findings_sql="SELECT finding_id, CASE WHEN k % 6 = 5 THEN 'needs-review' WHEN k % 6 < 2 THEN 'confirmed' WHEN k % 6 = 2 AND steps = 0 THEN 'needs-review' WHEN k % 6 = 2 THEN 'suppressed' ELSE 'likely' END AS verdict_status, CASE WHEN k % 4 = 0 THEN triage_status ELSE CASE WHEN k % 6 = 5 THEN 'needs-review' WHEN k % 6 < 2 THEN 'confirmed' WHEN k % 6 = 2 AND steps = 0 THEN 'needs-review' WHEN k % 6 = 2 THEN 'suppressed' ELSE 'likely' END END AS output_status FROM f")
def t7b(spark, d):
    """Verdict to status: insufficient evidence overrides; a false positive without evidence is demoted; shadow mode (k % 4 = 0) keeps the core's status."""
    k = F.col("k") % 6
    v = F.when(k == 5, "needs-review").when(k < 2, "confirmed").when((k == 2) & (F.col("steps") == 0), "needs-review").when(k == 2, "suppressed").otherwise("likely")
    return findings(spark, d).select("finding_id", v.alias("verdict_status"), F.when(F.col("k") % 4 == 0, F.col("triage_status")).otherwise(v).alias("output_status"))


@query("t7c_sensitive_never_suppressed", findings_sql="SELECT finding_id, CASE WHEN k % 9 = 0 THEN 'needs-review' WHEN k % 4 < 3 AND vulnerability_type IN ('SQL_INJECTION', 'COMMAND_INJECTION', 'CODE_INJECTION', 'INSECURE_DESERIALIZATION') THEN 'needs-review' WHEN k % 4 < 3 THEN 'suppressed' ELSE 'likely' END AS status FROM f")
def t7c(spark, d):
    k = F.col("k")
    sensitive = F.col("vulnerability_type").isin("SQL_INJECTION", "COMMAND_INJECTION", "CODE_INJECTION", "INSECURE_DESERIALIZATION")
    return findings(spark, d).select("finding_id", F.when(k % 9 == 0, "needs-review").when((k % 4 < 3) & sensitive, "needs-review").when(k % 4 < 3, "suppressed").otherwise("likely").alias("status"))


_CARDS = "(VALUES ('c1', NULL, 'SQL_INJECTION'), ('c2', 'de', NULL), ('c3', 'fr', 'COMMAND_INJECTION'), ('c4', NULL, NULL)) AS c(card_id, card_language, card_type)"


def _cards(spark):
    return spark.sql("SELECT * FROM VALUES ('c1', CAST(NULL AS STRING), 'SQL_INJECTION'), ('c2', 'de', NULL), ('c3', 'fr', 'COMMAND_INJECTION'), ('c4', NULL, NULL) AS c(card_id, card_language, card_type)")


@query("j10_wildcard_cards", findings_sql=f"SELECT finding_id, card_id FROM (SELECT *, CASE WHEN k % 8 > 0 THEN language END AS lang2 FROM f) JOIN {_CARDS} ON (lang2 IS NULL OR card_language IS NULL OR lang2 = card_language) AND (vulnerability_type IS NULL OR card_type IS NULL OR vulnerability_type = card_type)")
def j10(spark, d):
    f = findings(spark, d).withColumn("language", F.when(F.col("k") % 8 > 0, F.col("language")))
    return ops.wildcard_cards(f, _cards(spark)).select("finding_id", "card_id")


@query("j11_card_ids", findings_sql=f"SELECT finding_id, card_id, card_type FROM (SELECT finding_id, unnest(['c' || (k % 6), 'c4']) AS card_id FROM f) JOIN {_CARDS} USING (card_id)")
def j11(spark, d):
    ids = findings(spark, d).select("finding_id", F.explode(F.array(F.concat(F.lit("c"), (F.col("k") % 6).cast("string")), F.lit("c4"))).alias("card_id"))
    return ids.join(F.broadcast(_cards(spark)), "card_id").select("finding_id", "card_id", "card_type")


@query("j15_overlay_semi_join", findings_sql="SELECT finding_id, triage_status FROM f WHERE finding_id IN (SELECT finding_id FROM f WHERE ai_vulnerable IS NOT NULL)")
def j15(spark, d):
    f = findings(spark, d)
    return f.join(f.filter("ai_vulnerable IS NOT NULL").select("finding_id"), "finding_id", "left_semi").select("finding_id", "triage_status")


@query("j16_record_pairs", sql=_with(_CASCADE, "SELECT f.finding_id, f.triage_status, n.new_status, f.triage_status <> n.new_status AS changed FROM f JOIN n USING (finding_id)"))
def j16(spark, d):
    reviewed = _cascaded(spark, d).select("finding_id", "new_status")
    return findings(spark, d).select("finding_id", "triage_status").join(reviewed, "finding_id").withColumn("changed", F.col("triage_status") != F.col("new_status"))


_G18 = "CASE WHEN sanitized THEN 'suppressed' WHEN source_type = 'FILE_READ' OR language = 'fr' THEN 'suppressed' WHEN steps > 0 AND n_sanitizers < 2 THEN 'confirmed' ELSE 'needs-review' END"


@query("g18_bridge_status", findings_sql=f"SELECT finding_id, {_G18} AS status, CASE WHEN sanitized THEN 0.92::DOUBLE WHEN source_type = 'FILE_READ' OR language = 'fr' THEN 0.88::DOUBLE WHEN steps > 0 AND n_sanitizers < 2 THEN 0.88::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM f")
def g18(spark, d):
    """Bridge verdict: sanitizer, no untrusted source (also languages without a graph), traced over different lines, else review."""
    san, trusted, traced = F.col("sanitized"), (F.col("source_type") == "FILE_READ") | (F.col("language") == "fr"), (F.col("steps") > 0) & (F.col("n_sanitizers") < 2)
    return findings(spark, d).select("finding_id", F.when(san | trusted, "suppressed").when(traced, "confirmed").otherwise("needs-review").alias("status"), F.when(san, 0.92).when(trusted, 0.88).when(traced, 0.88).otherwise(0.65).alias("confidence"))


def _rounds(f):
    k = F.col("k")
    each = lambda of: F.array(*[of(r) for r in range(3)])
    return f.select(
        "finding_id", F.when(k % 11 == 0, "low_priority").alias("deny_reason"), (k % 13 == 0).alias("settled"), F.col("steps").alias("evidence"), F.when(k % 9 == 0, "hypothesis_builder").when(k % 9 == 1, "auditor").alias("failed_at"), each(lambda r: ((k + r) % 4).cast("int")).alias("calls"),
        each(lambda r: ((F.floor(k / 2) + r) % 2).cast("int")).alias("artifacts"), each(lambda r: ((k + 3 * r) % 10) / 10).alias("confidence"), each(lambda r: (k + r) % 2 == 0).alias("disagree"), each(lambda r: (k + 2 * r) % 5 == 0).alias("insufficient"),
    )


@query("t11_investigation", sql=f"""WITH RECURSIVE {FINDINGS_SQL},
    w AS (SELECT finding_id, k, -1 AS r, CASE WHEN k % 11 = 0 THEN 'eligibility_gate>end' WHEN k % 13 = 0 THEN 'eligibility_gate>evidence_inventory>planner>investigation_planner>end' ELSE 'eligibility_gate>evidence_inventory>planner>investigation_planner' END AS path,
            CASE WHEN k % 11 = 0 THEN 'denied' WHEN k % 13 = 0 THEN 'settled' END AS why, 0 AS n, 0 AS used, steps AS ev, NULL::INTEGER AS before, false AS asked FROM f
        UNION ALL SELECT finding_id, k, r, went || CASE WHEN failed THEN '' WHEN why IS NULL THEN '>reinvestigate' ELSE '>judge' END, why, n + CASE WHEN why IS NULL THEN 1 ELSE 0 END, used, ev, CASE WHEN why IS NULL THEN ev ELSE before END, asked FROM
            (SELECT *, CASE WHEN failed THEN 'model failed' WHEN n >= 2 THEN 'rounds used' WHEN used >= 12 THEN 'tool calls used' WHEN NOT ((k + r) % 2 = 0 AND asked OR (k + 2 * r) % 5 = 0) THEN 'no open question' WHEN ev <= before THEN 'nothing new' END AS why FROM
            (SELECT finding_id, k, r + 1 AS r, n, before, k % 9 < 2 AS failed, used + (k + r + 1) % 4 AS used, ev + CASE WHEN (k + r + 1) % 4 > 0 THEN (k // 2 + r + 1) % 2 ELSE 0 END AS ev, asked OR ((k + 3 * (r + 1)) % 10 < 8 AND k % 9 > 1) AS asked,
                path || CASE WHEN (k + r + 1) % 4 > 0 THEN '>tool_executor' ELSE '' END || '>hypothesis_builder' || CASE k % 9 WHEN 0 THEN '>judge' WHEN 1 THEN '>knowledge_loader>auditor>judge' ELSE '>knowledge_loader>auditor' || CASE WHEN (k + 3 * (r + 1)) % 10 < 8 THEN '>skeptic' ELSE '' END || '>validator' END AS went
             FROM w WHERE why IS NULL)))
    SELECT finding_id, path, CAST(n AS INTEGER) AS n_rounds, CAST(used AS INTEGER) AS tool_calls, CAST(ev AS INTEGER) AS evidence, why FROM w WHERE why IS NOT NULL""")
def t11i(spark, d):
    """The whole way of each finding through the investigation's stages, at most two rounds more than one."""
    return investigation.investigate(_rounds(findings(spark, d))).select("finding_id", F.array_join("path", ">").alias("path"), "n_rounds", "tool_calls", "evidence", "why")


@query("t9_suppression_events", findings_sql="""SELECT finding_id, CASE WHEN denied IS NULL THEN proposed ELSE 'needs-review' END AS policy_status, concat_ws(',', CASE WHEN proposed <> 'suppressed' AND failed THEN 'llm_failed_noted' END, CASE WHEN proposed = 'suppressed' AND NOT failed AND severe AND over AND val AND proved THEN 'high_critical_suppress_allowed_by_validator' END, denied, CASE WHEN proposed = 'suppressed' AND denied IS NULL THEN 'suppression_allowed_with_evidence' END) AS events FROM (
    SELECT *, CASE WHEN proposed <> 'suppressed' THEN NULL WHEN failed THEN 'fail_open_enforced' WHEN severe AND NOT over THEN 'high_critical_no_auto_suppress' WHEN severe AND NOT (val AND proved) THEN 'high_critical_requires_validator_proof' WHEN k % 4 = 0 THEN 'suppression_without_grounded_evidence' WHEN NOT val THEN 'suppression_without_validator'
        WHEN k % 11 = 0 THEN 'insufficient_evidence' WHEN NOT proved THEN 'no_static_proof_of_safety' WHEN k % 13 = 0 THEN 'unresolved_disagreement' END AS denied FROM
    (SELECT finding_id, k, CASE WHEN k % 6 < 5 THEN 'suppressed' ELSE triage_status END AS proposed, k % 7 = 0 AS failed, severity IN ('CRITICAL', 'HIGH') AS severe, k % 2 = 0 AS over, k % 3 > 0 AS val, k % 5 > 1 AS proved FROM f))""")
def t9e(spark, d):
    """All events of the suppression policy, in order."""
    k = F.col("k")
    f = findings(spark, d).withColumns({"proposed": F.when(k % 6 < 5, "suppressed").otherwise(F.col("triage_status")), "llm_failed": k % 7 == 0, "override": k % 2 == 0, "validator": k % 3 > 0, "proved_safe": k % 5 > 1, "insufficient": k % 11 == 0, "grounded": k % 4 > 0, "disagree": k % 13 == 0})
    return investigation.suppression_events(f).select("finding_id", "policy_status", F.array_join("events", ",").alias("events"))
