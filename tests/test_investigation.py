"""Investigations against a loop, and suppression events against a chain of conditions."""

import itertools
import random

from lintlake.operators.investigation import investigate, suppression_events


def by_hand(deny, settled, evidence, failed, calls, artifacts, confidence, disagree, insufficient, rounds, tools, sure):
    if deny is not None:
        return ["eligibility_gate", "end"], 0, 0, evidence, "denied"
    path = ["eligibility_gate", "evidence_inventory", "planner", "investigation_planner"]
    if settled:
        return [*path, "end"], 0, 0, evidence, "settled"
    of = lambda xs, i, none: xs[i] if i < len(xs) else none
    n, used, before, asked = 0, 0, None, False
    while True:
        if of(calls, n, 0) > 0:
            path.append("tool_executor")
            used += of(calls, n, 0)
            evidence += of(artifacts, n, 0)
        path.append("hypothesis_builder")
        if failed == "hypothesis_builder":
            return [*path, "judge"], n, used, evidence, "model failed"
        path += ["knowledge_loader", "auditor"]
        if failed == "auditor":
            return [*path, "judge"], n, used, evidence, "model failed"
        if of(confidence, n, 0.0) < sure:
            path.append("skeptic")
            asked = True
        path.append("validator")
        why = None
        if n >= rounds:
            why = "rounds used"
        elif used >= tools:
            why = "tool calls used"
        elif not (of(disagree, n, False) and asked or of(insufficient, n, False)):
            why = "no open question"
        elif before is not None and evidence <= before:
            why = "nothing new"
        if why:
            return [*path, "judge"], n, used, evidence, why
        path.append("reinvestigate")
        n, before = n + 1, evidence


def test_investigations(spark):
    rng = random.Random(11)
    some = lambda f: [f() for _ in range(rng.randrange(5))]
    rows = []
    for i in range(400):
        rows.append((i, "low" if rng.random() < 0.1 else None, rng.random() < 0.1, rng.randrange(3), rng.choice([None] * 6 + ["hypothesis_builder", "auditor"]), some(lambda: rng.randrange(4)), some(lambda: rng.randrange(2)), some(rng.random), some(lambda: rng.random() < 0.8), some(lambda: rng.random() < 0.4)))
    df = spark.createDataFrame(rows, "id int, deny_reason string, settled boolean, evidence int, failed_at string, calls array<int>, artifacts array<int>, confidence array<double>, disagree array<boolean>, insufficient array<boolean>")
    for rounds, tools in ((2, 12), (3, 4), (0, 99)):
        got = {r["id"]: (r["path"], r["n_rounds"], r["tool_calls"], r["evidence"], r["why"]) for r in investigate(df, rounds, tools).collect()}
        ends = set()
        for r in rows:
            want = by_hand(*r[1:], rounds, tools, 0.8)
            assert got[r[0]] == want, r
            ends.add(want[4])
        assert len(ends) >= 4


def test_suppression_events(spark):
    flags = ("llm_failed", "override", "validator", "proved_safe", "insufficient", "grounded", "disagree")
    rows = [(p, s, *f) for p in ("suppressed", "confirmed") for s in ("HIGH", "LOW") for f in itertools.product((False, True), repeat=len(flags))]
    df = spark.createDataFrame(rows, "proposed string, severity string, " + ", ".join(f"{f} boolean" for f in flags))

    def want(p, s, failed, override, validator, proved, insufficient, grounded, disagree):
        sup, events = p == "suppressed", []
        if failed:
            if sup:
                return "needs-review", ["fail_open_enforced"]
            events.append("llm_failed_noted")
        if sup and s == "HIGH":
            if not override:
                return "needs-review", ["high_critical_no_auto_suppress"]
            if not (validator and proved):
                return "needs-review", ["high_critical_requires_validator_proof"]
            events.append("high_critical_suppress_allowed_by_validator")
        for on, name in ((not grounded, "suppression_without_grounded_evidence"), (not validator, "suppression_without_validator"), (insufficient, "insufficient_evidence"), (not proved, "no_static_proof_of_safety"), (disagree, "unresolved_disagreement")):
            if sup and on:
                return "needs-review", [*events, name]
        return p, [*events, "suppression_allowed_with_evidence"] if sup else events

    for r in suppression_events(df).collect():
        assert (r["policy_status"], r["events"]) == want(*tuple(r)[:9]), r
