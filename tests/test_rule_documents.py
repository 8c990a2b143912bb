"""Rule documents walked, normalized and validated against plain Python on random documents."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.operators import rule_documents as x


def table(spark, docs):
    rows = [(f"r{i}", json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "rule_id string, j string").select("rule_id", F.parse_json("j").alias("rule")).repartition(3)


def some(rng, depth=0):
    kind = rng.randrange(14 if depth < 4 else 9)
    if kind == 0:
        return rng.choice([3, 2.5, True, None, [], ["a"]])
    if kind < 3:
        return rng.choice(["a.b(", "x", ""])
    out = {}
    if rng.random() < 0.3:
        out["focus-metavariable"] = rng.choice(["$X", " $Y ", "", 5])
    if kind < 9:
        for k in rng.sample(["pattern", "pattern-inside", "pattern-regex", "pattern-not", "odd", "metavariable-regex", "exact", "by-side-effect"], rng.randrange(4)):
            out[k] = rng.choice([True, False, 0, "yes", None]) if k in ("exact", "by-side-effect") else rng.choice(["os.run($X)", "q", " f(", "", 7])
        return out
    for k in rng.sample(["pattern-either", "patterns"], rng.randrange(1, 3)):
        out[k] = rng.choice([None, "no list", 4]) if rng.random() < 0.1 else [some(rng, depth + 1) for _ in range(rng.randrange(4))]
    return out


def walked(role, entries):
    found, notes = [], []

    def focus_of(v):
        f = v.get("focus-metavariable") if isinstance(v, dict) else None
        return f.strip() if isinstance(f, str) and f.strip() else None

    def modifies(v):
        return isinstance(v, dict) and set(v) <= set(x.MODIFIERS)

    def visit(v, given):
        if isinstance(v, str):
            found.append((v, "literal", False, False, given))
            return
        if not isinstance(v, dict):
            notes.append(f"Skipped {role} entry with unsupported type: {type(v).__name__}")
            return
        mine, side, before = focus_of(v) or given, bool(v.get("by-side-effect", False)), len(found)
        if isinstance(p := v.get("pattern"), str):
            found.append((p, "pattern", bool(v["exact"]) if "exact" in v else bool(re.match(x.CALL_HEAD, p.strip())), side, mine))
        if isinstance(p := v.get("pattern-inside"), str):
            found.append((p, "pattern", False, side, mine))
        if isinstance(p := v.get("pattern-regex"), str):
            found.append((p, "pattern-regex", bool(v.get("exact", False)), side, mine))
        any_own, groups = len(found) > before, [k for k in x.GROUPS if v.get(k) is not None]
        for k in groups:
            if not isinstance(v[k], list):
                notes.append(f"Skipped {role} nested group '{k}' because it is not a list")
                continue
            deep = mine
            for c in v[k]:
                deep = focus_of(c) or deep
            for c in v[k]:
                if not modifies(c):
                    visit(c, deep)
        if not any_own and not groups and not modifies(v):
            notes.append(f"Skipped {role} entry without reviewable pattern fields: " + ", ".join(sorted(v)))

    for e in [] if entries is None else entries if isinstance(entries, list) else [entries]:
        visit(e, None)
    return list(dict.fromkeys(found)), notes


def test_patterns_of_random_rules(spark):
    rng = random.Random(4)
    docs = [{key: rng.choice([None, "one", {"pattern": "p("}]) if rng.random() < 0.1 else [some(rng) for _ in range(rng.randrange(5))] for key in x.ROLES.values()} for _ in range(150)] + [{}, 5, None, []]
    patterns, notes = x.pattern_entries(table(spark, docs))
    got, said = {}, {}
    for r in sorted(patterns.collect(), key=lambda r: r["position"]):
        got.setdefault((r["rule_id"], r["role"]), []).append((r["pattern"], r["pattern_mode"], r["exact"], r["by_side_effect"], r["focus_metavariable"]))
    for r in notes.collect():
        said.setdefault((r["rule_id"], r["role"]), []).append(r["note"])
    n = 0
    for i, d in enumerate(docs):
        for role, key in x.ROLES.items():
            want, told = walked(role, d.get(key) if isinstance(d, dict) else None)
            assert got.get((f"r{i}", role), []) == want and sorted(said.get((f"r{i}", role), [])) == sorted(told), (d, role)
            n += len(want)
    assert n > 500


def rule(**more):
    return {"id": "r", "mode": "taint", "languages": ["go", " Python "], "severity": "ERROR", "message": "m", "metadata": {"cwe": ["see CWE-9, cwe-89"], "owasp": "A03:2021 - x"}, "pattern-sources": ["s"], "pattern-sinks": ["t("]} | more


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        (rule(), ("python", "SQL_INJECTION", "CRITICAL", ["CWE-9", "CWE-89"], ["A03:2021"], None)), (rule(mode="search"), (None, None, None, None, None, "only taint-mode rules are supported")), (rule(languages="java"), ("java", "SQL_INJECTION", "CRITICAL", ["CWE-9", "CWE-89"], ["A03:2021"], None)),
        (rule(languages=["go"]), (None, None, None, None, None, "rule language is unsupported or filtered out")), (rule(metadata={}, id="x"), (None, None, None, None, None, "could not infer family and no override was supplied")),
        (rule(metadata={}, message="bad Template"), ("python", "SSTI", "CRITICAL", [], [], None)), (rule(metadata={"note": "SSRF"}), ("python", "SSRF", "CRITICAL", [], [], None)), (rule(severity="odd", metadata={"cwe": "CWE-22"}), ("python", "PATH_TRAVERSAL", "MEDIUM", ["CWE-22"], [], None)),
        (rule(**{"pattern-sinks": [{"pattern-not": "x"}]}), (None, None, None, None, None, "rule does not expose a reviewable taint source/sink subset")), (7, (None, None, None, None, None, "rule is not a mapping")),
    ],
)
def test_normalized(spark, doc, want):
    r = x.normalize_rules(table(spark, [doc])).first()
    assert r["skip_reason"] == want[5]
    if want[5] is None:
        assert (r["language"], r["family"], r["severity"], r["cwe"], r["owasp"]) == want[:5] and r["n_sources"] == r["n_sinks"] == 1


GOOD = {
    "schema_version": "v1", "rule_id": "R1", "title": "t", "language": "python", "family": "SSRF", "severity": "HIGH", "taxonomy": {"cwe": ["CWE-1"], "owasp": ["A01:2021"]},
    "detection": {"match_mode": "m", "source_patterns": [{"pattern": "a", "pattern_mode": "literal", "exact": False, "by_side_effect": False}], "sink_patterns": [{"pattern": "f(", "pattern_mode": "pattern", "exact": True, "by_side_effect": False, "focus_metavariable": "$X"}], "sanitizers": []},
    "triage": {"knowledge_refs": [], "fp_hints": ["x"], "remediation_notes": []}, "provenance": {"source": "s", "source_rule_id": "i", "importer": "m", "snapshot_version": "1", "source_path": "p"}, "notes": ["n"],
}


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


CASES = [
    (("schema_version",), "v2", {("error", "schema_version", "invalid_rule_schema_version")}), (("title",), " ", {("error", "title", "missing_required_field")}), (("language",), "go", {("error", "language", "unsupported_language"), ("error", "language", "out_of_scope_language")}),
    (("family",), "XSS", {("error", "family", "out_of_scope_family")}), (("family",), "ODD", {("error", "family", "unsupported_family"), ("error", "family", "out_of_scope_family")}), (("severity",), "odd", {("error", "severity", "unsupported_severity")}), (("severity",), 5, {("error", "severity", "missing_required_field")}),
    (("taxonomy",), [], {("error", "taxonomy", "invalid_taxonomy")}), (("taxonomy", "cwe"), "CWE-1", {("error", "taxonomy.cwe", "invalid_taxonomy_list")}), (("taxonomy", "cwe"), ["cwe-1", "odd", 5], {("warning", "taxonomy.cwe[1]", "suspicious_cwe_format"), ("error", "taxonomy.cwe[2]", "invalid_taxonomy_value")}),
    (("taxonomy", "owasp"), ["A1"], {("warning", "taxonomy.owasp[0]", "suspicious_owasp_format")}), (("detection",), None, {("error", "detection", "invalid_detection")}), (("detection", "match_mode"), "", {("error", "detection.match_mode", "missing_match_mode")}), (("detection", "sink_patterns"), {}, {("error", "detection.sink_patterns", "invalid_pattern_list")}),
    (("detection", "source_patterns"), [], {("error", "detection.source_patterns", "empty_pattern_list")}), (("detection", "sanitizers"), ["s"], {("error", "detection.sanitizers[0]", "invalid_pattern_entry")}),
    (("detection", "sink_patterns"), [{}], {("error", f"detection.sink_patterns[0].{k}", c) for k, c in (("pattern", "missing_pattern"), ("pattern_mode", "invalid_pattern_mode"), ("exact", "invalid_exact_flag"), ("by_side_effect", "invalid_by_side_effect_flag"))}),
    (("detection", "sink_patterns", 0, "exact"), False, {("warning", "detection.sink_patterns[0].exact", "call_pattern_without_exact")}), (("detection", "sink_patterns", 0, "focus_metavariable"), " ", {("error", "detection.sink_patterns[0].focus_metavariable", "invalid_focus_metavariable")}),
    (("triage",), "x", {("error", "triage", "invalid_triage")}), (("triage", "fp_hints"), None, {("error", "triage.fp_hints", "invalid_triage_list")}), (("triage", "fp_hints"), ["", "a"], {("error", "triage.fp_hints[0]", "invalid_triage_value")}), (("provenance",), None, {("error", "provenance", "invalid_provenance")}),
    (("provenance", "importer"), None, {("error", "provenance.importer", "missing_required_field")}), (("provenance", "source_path"), "", {("warning", "provenance.source_path", "missing_source_path")}), (("provenance", "source_path"), 5, {("error", "provenance.source_path", "invalid_source_path")}), (("notes",), None, set()), (("notes",), {}, {("warning", "notes", "invalid_notes")}),
    (("notes",), ["a", " ", 4], {("warning", "notes[1]", "invalid_note_value"), ("warning", "notes[2]", "invalid_note_value")}), (("rule_id",), "", {("error", "rule_id", "missing_required_field")}),
]


def test_issues(spark):
    docs = [GOOD] + [changed(p, v) for p, v, _ in CASES]
    named = spark.createDataFrame([(json.dumps(d | ({"rule_id": f"R{i}"} if d["rule_id"] else {})),) for i, d in enumerate(docs)], "j string").select(F.parse_json("j").alias("rule"))
    every = {}
    for r in x.validate_rules(named, profile="python-reviewed-ssrf-v1", schema_version="v1").collect():
        every.setdefault(r["rule_id"], set()).add((r["level"], r["path"], r["code"]))
    assert "R0" not in every
    for i, (path, value, want) in enumerate(CASES, 1):
        assert every.get(f"R{i}" if path != ("rule_id",) else "<missing-rule-id>", set()) == want, (path, value)


def test_values_are_worked_out_once(spark):
    """However often a helper looks at its argument, the expression holds it once, so nested ones do not multiply."""
    from lintlake.operators import rule_documents as r

    for use in (r.kind, r.text, r.items, r.listed, r.names, r.truth, r.filled):
        assert str(use(F.col("_inner"))).count("_inner") == 1, use.__name__


def test_parts_are_dealt_to_all_cores(spark):
    from lintlake.plans.rule_plans import _rule_documents

    assert _rule_documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
