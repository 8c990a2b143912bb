"""Triage: routing, the deterministic cascade, auditor, skeptic and judge, the gates in front of a model, and its policies.

All are ordered CASE expressions over finding columns: narrow, no shuffle, but for the budget gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import small, written

OPERATOR_SOURCES = ("COMMAND_LINE_ARGS", "ENVIRONMENT_VAR")
#: Floors of the promotion to likely.
LIKELY_FLOOR = {"CODE_INJECTION": 0.74, "INSECURE_DESERIALIZATION": 0.74, "SQL_INJECTION": 0.74, "PATH_TRAVERSAL": 0.68, "COMMAND_INJECTION": 0.70}
SEVERE = ("CRITICAL", "HIGH")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def route(found: DataFrame) -> DataFrame:
    """direct-judge from .85 on without effective sanitizer, else skeptic-review."""
    return found.withColumn("route", F.when((F.col("confidence") >= 0.85) & ~F.col("sanitized"), "direct-judge").otherwise("skeptic-review"))


def cascade(found: DataFrame) -> DataFrame:
    """The deterministic triage: new_status, new_confidence, reason, manual_review.

    Needs triage_status, confidence, sanitized, source_type, vulnerability_type, sink_function, sink_pattern, shell (boolean: an argument
    is shell=true), steps, path_length, severity. The first rule that applies decides.
    """
    s, c, kind, sev = F.col("triage_status"), F.col("confidence"), F.col("vulnerability_type"), F.col("severity")
    review = s == "needs-review"
    local = F.col("source_type").isin(*OPERATOR_SOURCES)
    harmless = kind.isin("PATH_TRAVERSAL", "MASS_ASSIGNMENT") | ((kind == "COMMAND_INJECTION") & F.col("sink_function").startswith("subprocess.") & ~F.col("shell"))
    only_asks = (kind == "PATH_TRAVERSAL") & (F.lower(F.coalesce("sink_function", F.lit(""))).endswith("exists") | F.lower(F.coalesce("sink_pattern", F.lit(""))).contains(".exists"))
    stays = review & ((kind == "OPEN_REDIRECT") | only_asks)
    strong = review & ((F.col("path_length") >= 3) | (F.col("steps") > 0)) & kind.isin(*LIKELY_FLOOR)
    floor = F.coalesce(*[F.when(kind == k, v) for k, v in LIKELY_FLOOR.items()])
    rules = [
        (F.col("sanitized") & (s == "confirmed"), "needs-review", F.least(c, F.lit(0.65)), "sanitized-confirmed"),
        (F.col("sanitized") & s.isin("likely", "needs-review"), "suppressed", F.least(c, F.lit(0.40)), "sanitized"),
        (F.col("sanitized"), None, c, "sanitized-kept"),
        (local & harmless, "suppressed", F.least(c, F.lit(0.35)), "local-operator-source"),
        (local & review, None, clamp(c, 0.45, 0.55), "local-operator-review"),
        (stays, None, clamp(c, 0.55, 0.62), "ambiguous-sink"),
        (strong, "likely", F.greatest(c, floor), "promoted-likely"),
        (review & sev.isin(*SEVERE), None, F.greatest(c, F.lit(0.60)), "severe-floor"),
    ]
    status = conf = why = None
    for on, to, value, name in rules:
        to = s if to is None else F.lit(to)
        status = F.when(on, to) if status is None else status.when(on, to)
        conf = F.when(on, value) if conf is None else conf.when(on, value)
        why = F.when(on, name) if why is None else why.when(on, name)
    out = found.withColumns({"new_status": status.otherwise(s), "new_confidence": conf.otherwise(c), "reason": why.otherwise("unchanged")})
    return out.withColumn("manual_review", (F.col("new_status") == "needs-review") | ((F.col("new_status") == "suppressed") & sev.isin(*SEVERE)))


def evidence_score(found: DataFrame) -> DataFrame:
    """The auditor's score from steps, confidence, locations, sanitizers and graph edges (source_file, sink_file, cfg_edges, dfg_edges)."""
    plus = lambda on, v: F.when(on, v).otherwise(0.0)
    score = (
        0.35 + F.least(F.col("steps") * 0.12, F.lit(0.24)) + F.least(F.col("confidence") * 0.35, F.lit(0.35)) + plus(F.col("source_file") != "", 0.08) + plus(F.col("sink_file") != "", 0.08)
        - plus(F.col("n_sanitizers") > 0, 0.14) + plus(F.col("cfg_edges") > 0, 0.04) + plus(F.col("dfg_edges") > 0, 0.04)
    )
    return found.withColumn("evidence_score", clamp(score, 0.0, 1.0))


def skeptic(found: DataFrame) -> DataFrame:
    """On skeptic-review only: with mitigation signals (array `mitigations`) severe confirmed findings go to needs-review under .65, others to suppressed under .45; without, a weak finding (below .60, not suppressed) draws an objection and .55."""
    on = F.col("route") == "skeptic-review"
    hit = on & (F.size("mitigations") > 0)
    guarded = hit & F.col("severity").isin(*SEVERE) & (F.col("triage_status") == "confirmed")
    weak = on & (F.size("mitigations") == 0) & (F.col("triage_status") != "suppressed") & (F.col("confidence") < 0.60)
    return found.withColumns({
        "executed": on,
        "suggested": F.when(guarded, "needs-review").when(hit, "suppressed").when(weak, "needs-review"),
        "cap": F.when(guarded, 0.65).when(hit, 0.45).when(weak, 0.55),
        "objection": weak,
    })


def judge(found: DataFrame) -> DataFrame:
    """Applies the skeptic's word, then promotes: to confirmed (SQL, severe, score from .70, both SQL risk signals) or likely (severe, needs-review, score from .70, any signal); never with mitigations, sanitizers or objections. Columns: final_status, final_confidence, promoted."""
    st = F.when(F.col("executed"), F.coalesce("suggested", "triage_status")).otherwise(F.col("triage_status"))
    cf = F.when(F.col("executed") & F.col("cap").isNotNull(), F.least("confidence", "cap")).otherwise(F.col("confidence"))
    out = found.withColumn("_s", st).withColumn("_c", cf)
    clean = F.col("executed") & (F.size("mitigations") == 0) & ~F.col("objection") & ~F.col("sanitized") & F.col("severity").isin(*SEVERE) & (F.col("evidence_score") >= 0.70)
    sure = clean & F.col("_s").isin("likely", "needs-review") & (F.col("vulnerability_type") == "SQL_INJECTION") & (F.size("risk_signals") >= 2)
    maybe = clean & (F.col("_s") == "needs-review") & (F.size("risk_signals") >= 1)
    e = F.col("evidence_score")
    return out.withColumns({
        "final_status": F.when(sure, "confirmed").when(maybe, "likely").otherwise(F.col("_s")),
        "final_confidence": F.when(sure, F.greatest("_c", clamp(e, 0.88, 0.96))).when(maybe, F.greatest("_c", clamp(e, 0.72, 0.85))).otherwise(F.col("_c")),
        "promoted": F.when(sure, "confirmed").when(maybe, "likely"),
    }).drop("_s", "_c")


def tokens_in(text: Column, tokens: tuple[str, ...]) -> Column:
    """Those of the tokens that the lower-cased text holds."""
    t = F.lower(text)
    return F.array_compact(F.array(*[F.when(t.contains(x), F.lit(x)) for x in tokens]))


def risk_signals(kind: Column, context: Column) -> Column:
    """Names of the risks that the code around a SQL or command sink shows."""
    t = F.lower(context)
    named = t.contains("query =") | t.contains("sql =")
    keyword = t.contains("select ") | t.contains("insert ") | t.contains("update ") | t.contains("delete ")
    dynamic = named & (t.contains('f"') | t.contains("+") | t.contains(".format(") | t.contains("% "))
    sql, cmd = kind == "SQL_INJECTION", kind == "COMMAND_INJECTION"
    return F.array_compact(F.array(
        F.when(sql & keyword & dynamic, "dynamic-sql-construction"), F.when(sql & t.contains("execute("), "query-executed-directly"),
        F.when(cmd & (t.contains("os.system") | t.contains("popen")), "dangerous-shell-invocation"), F.when(cmd & t.contains("shell=true"), "shell-true-enabled"),
    ))


def priority(found: DataFrame) -> DataFrame:
    """Model priority: .35 severity + .25 confidence + .20 exploitability + .10 ambiguity + .10 exposure. Needs path_len, n_files, has_source, has_sink, n_sanitizers, high_impact."""
    sev = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0) / 3.0
    path = F.col("path_len") > 0
    plus = lambda on, v: F.when(on, v).otherwise(0.0)
    exploit = F.least(F.lit(1.0), plus(path & F.col("has_source") & F.col("has_sink"), 0.5) + plus(path & (F.col("n_sanitizers") == 0), 0.3) + plus(F.col("high_impact"), 0.2))
    ambiguity = 1.0 - F.abs(F.col("confidence") - 0.5) * 2.0
    exposure = F.when(path, 0.5 * F.least((F.col("n_files") - 1) / 3.0, F.lit(1.0)) + 0.5 * F.least(F.col("path_len") / 8.0, F.lit(1.0))).otherwise(0.0)
    return found.withColumn("priority", 0.35 * sev + 0.25 * F.col("confidence") + 0.20 * exploit + 0.10 * ambiguity + 0.10 * exposure)


def eligibility(found: DataFrame, min_rank: int = 1, min_quality: float = 0.3) -> DataFrame:
    """First reason that keeps a finding from the model, before any budget; null when there is none. Needs llm_enabled, proved_safe, severity, evidence_quality, path_len, has_source, has_sink."""
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0)
    reason = (
        F.when(~F.col("llm_enabled"), "ai_mode_off").when(F.col("proved_safe"), "static_heuristic_proved_safe").when(rank < min_rank, "severity_below_minimum").when(F.col("evidence_quality") < min_quality, "insufficient_evidence_for_llm")
        .when((F.col("path_len") == 0) & ~(F.col("has_source") & F.col("has_sink")), "no_source_sink_or_path")
    )
    return found.withColumn("deny_reason", reason)


def budget_gate(found: DataFrame, per_scan: int, per_file: int) -> DataFrame:
    """Admits by (-priority, finding_id) while both budgets last: reason eligible, file_llm_budget_exhausted or scan_llm_budget_exhausted.

    A file's budget is its first rows by rank; the scan's is the first of those. Because a denied row uses up neither,
    the sequential gate equals two ranks: by file, then over the survivors. The second is a top-k, never a full sort.
    """
    order = [F.col("priority").desc(), F.col("finding_id").asc()]
    ranked = written(found.withColumn("_f", F.row_number().over(Window.partitionBy("file_path").orderBy(*order))), "budget")
    admitted = ranked.filter(F.col("_f") <= per_file).orderBy(*order).limit(per_scan)
    n, last = admitted.agg(F.count("*"), F.max(F.struct((-F.col("priority")).alias("p"), "finding_id"))).first()
    # rows up to the last admitted one were looked at while the scan's budget lasted
    late = F.struct((-F.col("priority")).alias("p"), "finding_id") > F.struct(F.lit(last["p"]).alias("p"), F.lit(last["finding_id"]).alias("finding_id")) if n >= max(per_scan, 1) else F.lit(per_scan < 1)
    gate = F.when(late, "scan_llm_budget_exhausted").when(F.col("_f") > per_file, "file_llm_budget_exhausted").otherwise("eligible")
    return ranked.withColumn("gate", gate).drop("_f")


def suppression(found: DataFrame) -> DataFrame:
    """What may become of a proposed suppression: policy_status and event; the first rule that applies sends it to needs-review. Needs proposed, llm_failed, severity, override, validator, proved_safe, insufficient, grounded, disagree."""
    sup = F.col("proposed") == "suppressed"
    severe = F.col("severity").isin(*SEVERE)
    proof = F.col("validator") & F.col("proved_safe")
    event = (
        F.when(~sup & F.col("llm_failed"), "llm_failed_noted").when(~sup, "not_a_suppression").when(F.col("llm_failed"), "fail_open_enforced").when(severe & ~F.col("override"), "high_critical_no_auto_suppress").when(severe & ~proof, "high_critical_requires_validator_proof")
        .when(~F.col("grounded"), "suppression_without_grounded_evidence").when(~F.col("validator"), "suppression_without_validator").when(F.col("insufficient"), "insufficient_evidence").when(~F.col("proved_safe"), "no_static_proof_of_safety").when(F.col("disagree"), "unresolved_disagreement")
        .otherwise("suppression_allowed_with_evidence")
    )
    out = found.withColumn("event", event)
    return out.withColumn("policy_status", F.when(sup & (F.col("event") != "suppression_allowed_with_evidence"), "needs-review").otherwise(F.col("proposed")))


def next_node(found: DataFrame, max_rounds: int = 2, tool_budget: int = 12) -> DataFrame:
    """After the validator: judge, or reinvestigate when a question is open, budgets last, and the round brought something new."""
    stop = F.col("llm_failed") | (F.col("rounds") >= max_rounds) | (F.col("tool_calls") >= tool_budget) | ~(F.col("disagree") | F.col("insufficient")) | (F.col("evidence") <= F.col("evidence_before"))
    return found.withColumn("next_node", F.when(stop, "judge").otherwise("reinvestigate"))


def wildcard_cards(found: DataFrame, cards: DataFrame) -> DataFrame:
    """Findings with the knowledge cards that fit: a null on either side fits anything. The cards are a bounded literal set."""
    ok = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))
    return found.join(small(cards), ok("language", "card_language") & ok("vulnerability_type", "card_type"))


# Words for a status.
STATUS_WORDS = {
    "confirmed": "confirmed", "true-positive": "confirmed", "tp": "confirmed", "likely": "likely", "needs-review": "needs-review", "needsreview": "needs-review", "review": "needs-review",
    "suppressed": "suppressed", "false-positive": "suppressed", "fp": "suppressed",
}


def parse_decision(reply: Column) -> Column:
    """A model's reply as struct(status, confidence, failed): a JSON object, also fenced or inside prose.

    Blanks and underscores in a status count as hyphens. Without a known status is_vulnerable decides: text is true if it
    is 1, true, yes or y, other values as they are true or not. Confidence is clamped to 0..1, and 0.5 where it is no
    number. What is neither has failed, and has no status and no confidence.
    """
    fenced = F.regexp_extract(reply, r"(?is)```json\s*(.*?)\s*```", 1)
    plain = F.when(F.trim(reply).startswith("```"), F.regexp_extract(F.trim(reply), r"(?s)```\s*(.*?)\s*```", 1)).otherwise(F.trim(reply))
    text = F.when(fenced != "", fenced).otherwise(plain)
    body = F.try_parse_json(F.when(text.startswith("{"), text).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))
    return F.transform(F.array(body), _decided)[0]


def _decided(body: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(body, path, kind)
    status = F.regexp_replace(F.lower(F.trim(get("$.status", "string"))), "[_ ]", "-")
    known = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair]), status)
    number = get("$.confidence", "double")
    conf = F.when(number.isNull() | F.isnan(number), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    kind = F.schema_of_variant(get("$.is_vulnerable", "variant"))
    said = get("$.is_vulnerable", "string")
    true = F.when(kind == "STRING", F.lower(F.trim(said)).isin("1", "true", "yes", "y")).when(kind == "BOOLEAN", said == "true").when(kind == "VOID", F.lit(False)).when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~said.isin("[]", "{}")).otherwise(get("$.is_vulnerable", "double") != 0)
    got = F.coalesce(known, F.when(true, F.when(conf >= 0.85, "confirmed").otherwise("likely")).when(~true, "suppressed"))
    return F.struct(got.alias("status"), F.when(got.isNotNull(), conf).alias("confidence"), got.isNull().alias("failed"))
