"""The investigation of a finding as a walk through its stages, with all edges and a bounded number of rounds.

What each round would find is given as arrays; the walk is a fold over them within the row, so findings of any number are
walked in one narrow pass, without a loop on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.triage import SEVERE

#: Most rounds after the first, tool calls that may be used, and the confidence from which no skeptic is asked.
ROUNDS, TOOLS, SURE = 2, 12, 0.8


def investigate(found: DataFrame, rounds: int = ROUNDS, tools: int = TOOLS, sure: float = SURE) -> DataFrame:
    """path (stages in order), n_rounds, tool_calls, evidence, why (of the end) of each finding.

    Needs deny_reason (null: eligible), settled (the planner ends it), evidence (artifacts at hand), failed_at (null, or the
    stage where the model fails: hypothesis_builder or auditor), and for each round, from the first on: calls, artifacts,
    confidence, disagree, insufficient (arrays; what is missing counts as none). A round is followed by another only while
    a question is open, rounds and tool calls last, and the round before brought something new. Whoever disagrees with the
    auditor must have been asked.
    """
    path = lambda *names: F.array(*[F.lit(n) for n in names])
    start = F.struct(path("eligibility_gate", "evidence_inventory", "planner", "investigation_planner").alias("path"), F.lit(None).cast("string").alias("why"), F.lit(0).alias("n"), F.lit(0).alias("tools"), F.col("evidence").cast("int").alias("evidence"), F.lit(None).cast("int").alias("before"), F.lit(False).alias("asked"))

    def step(acc: Column, r: Column) -> Column:
        of = lambda name, none: F.coalesce(F.get(F.col(name), r), F.lit(none))
        calls = of("calls", 0)
        used, held = acc["tools"] + calls, acc["evidence"] + F.when(calls > 0, of("artifacts", 0)).otherwise(0)
        lost = F.coalesce(F.col("failed_at"), F.lit(""))
        skeptic = of("confidence", 0.0) < sure
        asked = acc["asked"] | skeptic & ~lost.isin("hypothesis_builder", "auditor")
        went = F.concat(
            acc["path"], F.when(calls > 0, path("tool_executor")).otherwise(path()), path("hypothesis_builder"),
            F.when(lost == "hypothesis_builder", path("judge")).otherwise(F.concat(path("knowledge_loader", "auditor"), F.when(lost == "auditor", path("judge")).otherwise(F.concat(F.when(skeptic, path("skeptic")).otherwise(path().cast("array<string>")), path("validator"))))),
        )
        open_ = of("disagree", False) & asked | of("insufficient", False)
        why = (
            F.when(lost.isin("hypothesis_builder", "auditor"), "model failed").when(acc["n"] >= rounds, "rounds used").when(used >= tools, "tool calls used").when(~open_, "no open question")
            .when(held <= acc["before"], "nothing new")
        )
        went = F.concat(went, F.when(lost.isin("hypothesis_builder", "auditor"), path().cast("array<string>")).when(why.isNotNull(), path("judge")).otherwise(path("reinvestigate")))
        new = F.struct(went.alias("path"), why.alias("why"), (acc["n"] + F.when(why.isNull(), 1).otherwise(0)).alias("n"), used.alias("tools"), held.cast("int").alias("evidence"), F.when(why.isNull(), held).otherwise(acc["before"]).cast("int").alias("before"), asked.alias("asked"))
        return F.when(acc["why"].isNotNull(), acc).otherwise(new)

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(rounds)), start, step)
    none = lambda names, why: F.struct(path(*names).alias("path"), F.lit(why).alias("why"), F.lit(0).alias("n"), F.lit(0).alias("tools"), F.col("evidence").cast("int").alias("evidence"), F.lit(None).cast("int").alias("before"), F.lit(False).alias("asked"))
    out = F.when(F.col("deny_reason").isNotNull(), none(["eligibility_gate", "end"], "denied")).when(F.col("settled"), none(["eligibility_gate", "evidence_inventory", "planner", "investigation_planner", "end"], "settled")).otherwise(walk)
    return found.withColumn("_w", out).select(*[c for c in found.columns if c != "evidence"], F.col("_w.path").alias("path"), F.col("_w.n").alias("n_rounds"), F.col("_w.tools").alias("tool_calls"), F.col("_w.evidence").alias("evidence"), F.col("_w.why").alias("why"))


def suppression_events(found: DataFrame) -> DataFrame:
    """policy_status and events (all of them, in order) of what may become of a proposed state; a denial ends the list and sends a proposed suppression to needs-review. Needs proposed, llm_failed, severity, override, validator, proved_safe, insufficient, grounded, disagree."""
    sup, failed = F.col("proposed") == "suppressed", F.col("llm_failed")
    severe, proof = F.col("severity").isin(*SEVERE), F.col("validator") & F.col("proved_safe")
    denied = (
        F.when(~sup, None).when(failed, "fail_open_enforced").when(severe & ~F.col("override"), "high_critical_no_auto_suppress").when(severe & ~proof, "high_critical_requires_validator_proof")
        .when(~F.col("grounded"), "suppression_without_grounded_evidence").when(~F.col("validator"), "suppression_without_validator").when(F.col("insufficient"), "insufficient_evidence").when(~F.col("proved_safe"), "no_static_proof_of_safety").when(F.col("disagree"), "unresolved_disagreement")
    )
    events = F.array_compact(F.array(F.when(~sup & failed, "llm_failed_noted"), F.when(sup & ~failed & severe & F.col("override") & proof, "high_critical_suppress_allowed_by_validator"), denied, F.when(sup & denied.isNull(), "suppression_allowed_with_evidence")))
    return found.withColumns({"policy_status": F.when(denied.isNotNull(), "needs-review").otherwise(F.col("proposed")), "events": events})
