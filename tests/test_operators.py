"""Edge cases of the operators on small tables made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.functions import code
from lintlake.graph import scripts
from lintlake.graph.flow import Flow, Values
from lintlake.operators import findings, graphs, matching, reports, rules, scoring, triage
from lintlake.sources import files, sinks
from lintlake.streaming import jobs


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_dedupe_keeps_earliest_of_ties_and_any_row_order(spark):
    schema = "finding_id string, file_path string, line_number int, column_number int, vulnerability_type string, sink_function string, sink_pattern string, sanitized boolean, severity string, variable string, steps int, n_sanitizers int, ordinal int"
    base = ("f", 1, 1, "XSS", "s", "p")
    data = [("a", *base, True, "CRITICAL", "v", 0, 0, 1), ("b", *base, False, "LOW", "v", 1, 0, 2), ("c", *base, False, "HIGH", None, 1, 0, 3), ("d", *base, False, "HIGH", "v", 2, 0, 4), ("e", *base, False, "HIGH", "v", 2, 0, 5)]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        got = findings.dedupe_sinks(table(spark, schema, *data)).collect()
        assert [(r.finding_id, r.first_ordinal) for r in got] == [("d", 1)]


def test_renumber_is_dense_over_partitions(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("ordinal"))
    got = {r.ordinal: r.finding_id for r in findings.renumber(df, "ordinal").collect()}
    assert got == {i: f"VULN-{i + 1:03d}" for i in range(500)}


def test_modes_are_nested_and_null_status_is_visible(spark):
    df = table(spark, "finding_id int, triage_status string", (1, "confirmed"), (2, "likely"), (3, "needs-review"), (4, "suppressed"), (5, None))
    got = {}
    for r in matching.by_mode(df).collect():
        got.setdefault(r.mode, set()).add(r.finding_id)
    assert got == {"all": {1, 2, 3, 4, 5}, "visible": {1, 2, 3, 5}, "high-confidence": {1, 2}}


def test_confusion_counts_cases_not_findings(spark):
    found = table(spark, "mode string, family string, case_id int", ("all", "x", 1), ("all", "x", 1), ("all", "x", 2), ("all", "x", 9))
    truth = table(spark, "case_id int, family string, vulnerable boolean", (1, "x", True), (2, "x", False), (3, "x", True), (4, "x", False))
    (r,) = scoring.with_metrics(scoring.confusion(found, truth, "mode", ("all",))).collect()
    assert (r.tp, r.fp, r.fn, r.tn, r.unexpected) == (1, 2, 1, 1, 1)
    assert (r.precision, r.recall, r.f1) == (0.3333, 0.5, 0.4)


def test_range_match_tolerance_and_duplicates(spark):
    labels = table(spark, "file_path string, family string, label_idx int, start_line int, end_line int, is_vulnerable boolean", ("a", "x", 1, 10, 12, True), ("a", "x", 2, 11, 30, True), ("a", "x", 3, 50, 50, False))
    f = [("f1", "a", "x", 8, 1), ("f2", "a", "x", 14, 2), ("f3", "a", "x", 15, 3), ("f4", "a", "x", 7, 4), ("f5", "a", "x", 50, 5), ("f6", "b", "x", 1, 6)]
    got = {r.finding_id: r.outcome for r in matching.first_match(table(spark, "finding_id string, file_path string, family string, line_number int, ordinal int", *f), labels, 2).collect()}
    assert got == {"f1": "tp", "f2": "duplicate", "f3": "tp", "f4": "fp", "f5": "fp"}


def sequential_gate(rows, per_scan, per_file):
    used, by, out = 0, {}, {}
    for i, path, p in sorted(rows, key=lambda r: (-r[2], r[0])):
        if used >= per_scan:
            out[i] = "scan_llm_budget_exhausted"
        elif by.get(path, 0) >= per_file:
            out[i] = "file_llm_budget_exhausted"
        else:
            used, by[path], out[i] = used + 1, by.get(path, 0) + 1, "eligible"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budget_gate_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i:03d}", f"p{rng.randrange(6)}", rng.randrange(5) / 4) for i in range(60)]
    per_scan, per_file = rng.choice([3, 8, 100]), rng.choice([1, 3])
    got = triage.budget_gate(table(spark, "finding_id string, file_path string, priority double", *rows), per_scan, per_file)
    assert {r.finding_id: r.gate for r in got.collect()} == sequential_gate(rows, per_scan, per_file)


def test_merge_rules_base_wins_in_order(spark):
    b = table(spark, "rule_no int, pattern string, type string, note string", (1, "a", "t", "base"), (2, "b", "t", "base"))
    o = table(spark, "rule_no int, pattern string, type string, note string", (1, "b", "t", "over"), (2, "c", "t", "over"), (3, "c", "t", "again"))
    assert [(r.pattern, r.note, r.position) for r in rules.merge(b, o, ["pattern", "type"]).orderBy("position").collect()] == [("a", "base", 1), ("b", "base", 2), ("c", "over", 3)]


def test_closure_ends_on_cycles_and_keeps_first_level(spark):
    edges = table(spark, "src int, dst int", (1, 2), (2, 3), (3, 1), (1, 3), (3, 4))
    start = table(spark, "node int", (1,))
    assert {(r.node, r.level) for r in graphs.closure(start, edges, 10).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {r.node for r in graphs.closure(start, edges, 1).collect()} == {1, 2, 3}


def test_queue_filter_and_paths(spark):
    df = table(spark, "file_path string", ("src\\app\\a.py",), ("src/app",), ("lib/app/b.py",), ("src/apple/c.py",))
    assert {r.file_path for r in df.filter(reports.path_selected(F.col("file_path"), "src/app/")).collect()} == {"src\\app\\a.py", "src/app", "lib/app/b.py"}


def test_selected_paths_are_folders(spark):
    df = table(spark, "file_path string", ("app/main.py",), ("other/main.py",), ("main.py",), ("other/main.py/x",), ("",), (None,))
    assert {r.file_path for r in df.filter(reports.path_selected(F.col("file_path"), "app/main.py")).collect()} == {"app/main.py", "main.py", "other/main.py/x"}
    assert df.filter(reports.path_selected(F.col("file_path"), "/")).count() == 0


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"status": "False Positive"}', ("suppressed", 0.5, False)), ('{"status": "review", "confidence": 90}', ("needs-review", 1.0, False)), ('{"status": "needs_review", "confidence": -3}', ("needs-review", 0.0, False)),
        ('{"is_vulnerable": "yes", "confidence": "0.9"}', ("confirmed", 0.9, False)), ('{"is_vulnerable": "maybe"}', ("suppressed", 0.5, False)), ('{"is_vulnerable": null}', ("suppressed", 0.5, False)), ('{"is_vulnerable": []}', ("suppressed", 0.5, False)),
        ('{"is_vulnerable": {"a": 1}}', ("likely", 0.5, False)), ('{"is_vulnerable": 0}', ("suppressed", 0.5, False)), ('{"confidence": 0.9}', (None, None, True)), ('{"status": 7}', (None, None, True)), ('{"status": "tp"', (None, None, True)), (None, (None, None, True)), ("", (None, None, True)),
        ('```\n{"status": "tp", "confidence": null}\n```', ("confirmed", 0.5, False)), ('Well: ```json {"status": "fp"}``` or {"status": "tp"}', ("suppressed", 0.5, False)), ('{"status": "odd", "is_vulnerable": true, "confidence": 0.85}', ("confirmed", 0.85, False)),
    ],
)
def test_decisions(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string").select(triage.parse_decision(F.col("reply")).alias("x")).select("x.*")
    assert tuple(df.first()) == want


def test_match_many_equals_match_lines(spark):
    rng = random.Random(5)
    patterns = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(30)] + ["", None, "ab", "a.b", "("]
    rules_ = table(spark, "rule_id int, pattern string, file string", *[(i, p, "r") for i, p in enumerate(patterns)])
    lines_ = table(spark, "doc_id int, line string, n int", *[(i, "".join(rng.choice("abc.( ") for _ in range(20)), 1) for i in range(60)], (60, None, 1), (61, "", 1))
    want = sorted(tuple(r) for r in findings.match_lines(lines_, rules_).collect())
    assert sorted(tuple(r) for r in findings.match_many(lines_, rules_).collect()) == want and len(want) > 200


def test_filters_on_matches_stay_behind_the_match(spark):
    """A later filter on rules and lines is worked out for matches, not in the join for every line with every rule."""
    rules_ = table(spark, "rule_id string, pattern string", ("A", "a"), ("B", "b"))
    lines_ = table(spark, "doc_id int, line string", (1, "xa"), (2, "ab"), (3, "c"))
    got = findings.match_lines(lines_, rules_).select("doc_id", F.concat(F.upper("rule_id"), F.col("doc_id").cast("string")).alias("id")).filter("id <> 'B2'")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("upper" not in x for x in plan.split("\n") if "Join Inner" in x) and "Join Inner" in plan
    assert sorted(tuple(r) for r in got.collect()) == [(1, "A1"), (2, "A2")]


def test_call_patterns(spark):
    df = table(spark, "p string, args array<string>", ("subprocess.run(shell=True)", ["cmd", "shell = True"]), ("f(**)", ["**kw"]), ("g(a=1)", ["b=1"]))
    got = df.select(code.call_name(F.col("p")).alias("n"), code.satisfies(F.col("args"), code.constraints(F.col("p"))).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("subprocess.run", True), ("f", True), ("g", False)]


SOURCES, SINKS = ("request.",), ("os.system",)
HEAD = "def keep(a, b):\n    return a\n\ndef fixed(a):\n    return 'x'\n\ndef run(request):\n    v = request.args\n"


@pytest.mark.parametrize(
    ("body", "flows"),
    [
        ("    os.system(v)\n", True),
        ("    v = 'safe'\n    os.system(v)\n", False),
        ("    return v\n    os.system(v)\n", False),
        ("    for x in [1]:\n        continue\n        os.system(v)\n", False),
        ("    w = keep(v, 1)\n    os.system(w)\n", True),
        ("    w = fixed(v)\n    os.system(w)\n", False),
        ("    w = keep(1, v)\n    os.system(w)\n", False),
        ("    d = {}\n    d['k'] = v\n    d['j'] = 1\n    os.system(d)\n", True),
        ("    l = []\n    l.append(v)\n    os.system(l)\n", True),
        ("    if v:\n        v = 1\n    os.system(v)\n", True),
        ("    while True:\n        if v:\n            break\n    os.system(v)\n", True),
        ("    try:\n        w = v\n    finally:\n        os.system(w)\n", True),
    ],
)
def test_taint_is_path_sensitive(body, flows):
    assert bool(Flow(HEAD + body).trace(SOURCES, SINKS)) == flows


def test_sanitizers_are_recorded_and_summaries_follow_data():
    g = Flow(HEAD + "    w = shlex.quote(v)\n    os.system(w)\n")
    assert [x[3] for x in g.trace(SOURCES, SINKS, ("shlex.quote",))] == [True]
    depends = {f.name: f.depends for f in g.functions}
    assert depends["keep"] == ["a"] and depends["fixed"] == []


def test_trace_is_whole_on_many_ways():
    ways = "".join(f"    if c:\n        n{i} = v\n" for i in range(16))
    g = Flow(HEAD + ways + "".join(f"    os.system(n{i})\n" for i in range(16)))
    assert [x[1] for x in g.trace(SOURCES, SINKS)] == list(range(41, 57))


def test_trace_keeps_each_source_and_the_way_without_a_sanitizer():
    both = "    if c:\n        v = request.a\n    else:\n        v = request.b\n    os.system(v)\n"
    assert [x[:2] for x in Flow(HEAD + both).trace(SOURCES, SINKS)] == [(10, 13), (12, 13)]
    kept = "    w = request.other\n    os.system(v)\n"
    assert [x[:2] for x in Flow(HEAD + kept).trace(SOURCES, SINKS)] == [(8, 10)]
    for a, b in (("v", "shlex.quote(v)"), ("shlex.quote(v)", "v")):
        half = f"    if c:\n        w = {a}\n    else:\n        w = {b}\n    os.system(w)\n"
        assert Flow(HEAD + half).trace(SOURCES, SINKS, ("shlex.quote",)) == [(8, 13, 2, False)]
    every = "    if c:\n        w = shlex.quote(v)\n    else:\n        w = shlex.quote(v)\n    os.system(w)\n"
    assert [x[3] for x in Flow(HEAD + every).trace(SOURCES, SINKS, ("shlex.quote",))] == [True]


@pytest.mark.parametrize(("code_text", "safe"), [("def f(q):\n    c = 'a' + 'b'\n    os.system(c)\n", True), ("def f(q):\n    c = 'a' + q\n    os.system(c)\n", False), ("def f(q):\n    if 1 == 1:\n        c = 'x'\n    else:\n        c = q\n    os.system(c)\n", True), ("def f(q):\n    c = 'x'\n    if q:\n        c = q\n    os.system(c)\n", False)])
def test_constant_filter(code_text, safe):
    import ast

    v = Values(("os.system",))
    v.block(ast.parse(code_text).body[0].body, {"q": "tainted"})
    assert isinstance(next(iter(v.hits.values())), tuple) == safe


def test_files_rules_truth_and_reports(spark, tmp_path):
    for name, text in (("app/a.py", "x = 1\n"), ("node_modules/b.js", "x"), ("app/c.txt", "x"), ("app/D.PHTML", "<?php")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    got = files.code_files(spark, str(tmp_path / "tree")).collect()
    assert {(r.path, r.language, r.content) for r in got} == {("app/a.py", "python", "x = 1\n"), ("app/D.PHTML", "php", "<?php")}
    (tmp_path / "r.yaml").write_text("sources:\n- {pattern: request., type: HTTP}\nsinks:\n  sqli:\n  - {pattern: execute(, severity: HIGH}\nsanitizers:\n- {pattern: int(, mitigates: [SQL_INJECTION]}\n")
    assert {(r.kind, r.category, r.pattern) for r in files.rules(spark, str(tmp_path / "r.yaml")).collect()} == {("source", None, "request."), ("sink", "sqli", "execute("), ("sanitizer", None, "int(")}
    (tmp_path / "t.csv").write_text("# head\nBenchmarkTest00001,sqli,true,89\n\nBenchmarkTest00002,odd,FALSE,1\n")
    assert [tuple(r) for r in files.ground_truth(spark, str(tmp_path / "t.csv")).orderBy("case_id").collect()] == [("BenchmarkTest00001", "sqli", "SQL_INJECTION", True, 89), ("BenchmarkTest00002", "odd", None, False, 1)]
    (tmp_path / "bad.csv").write_text("BenchmarkTest00001,sqli,true\n")
    with pytest.raises(ValueError):
        files.ground_truth(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "s.json").write_text('{"results": [{"check_id": "c", "path": "p", "start": {"line": 3, "col": 1}, "extra": {"message": "m", "severity": "ERROR"}}]}')
    (r,) = files.scanner_report(spark, str(tmp_path / "s.json")).collect()
    import hashlib

    assert r.fingerprint == hashlib.sha256(b"c|p|3|m").hexdigest()


def test_upsert_last_write_wins(spark, tmp_path):
    a = table(spark, "key string, note string, at int", ("k", "old", 1), ("m", "only", 1))
    b = table(spark, "key string, note string, at int", ("k", "new", 2))
    got = sinks.upsert(a, b, "key", "at", str(tmp_path / "mem"))
    assert {(r.key, r.note) for r in got.collect()} == {("k", "new"), ("m", "only")}


def test_stream_ends_with_the_batch_result(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.job_states(s).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {tuple(r) for r in jobs.job_states(src).collect()}
    assert {tuple(r) for r in spark.table("states").collect()} == want


def test_report_sinks(spark, tmp_path):
    f = table(spark, "finding_id string, severity string, triage_status string", ("a", "HIGH", "likely"), ("b", "LOW", None))
    sinks.write_report(f, str(tmp_path / "r"), table(spark, "path string, error string", ("x", "bad")))
    assert spark.read.json(str(tmp_path / "r/findings")).count() == 2 and spark.read.json(str(tmp_path / "r/errors")).count() == 1
    sinks.append_lines(f, str(tmp_path / "l"))
    sinks.append_lines(f, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.write_scores(f, str(tmp_path / "s"))
    assert {r.value for r in spark.read.text(str(tmp_path / "s/markdown")).collect()} == {"| a | HIGH | likely |", "| b | LOW | - |"}
    assert sinks.rule_document(f.limit(0)) == '{\n  "rules": []\n}'


def test_ttl_and_resume(spark):
    from datetime import datetime

    r = table(spark, "k string, ts timestamp", ("old", datetime(2024, 1, 1)), ("new", datetime(2024, 1, 9)))
    assert [x.k for x in jobs.fresh(r, F.lit(datetime(2024, 1, 10)), 7).collect()] == ["new"]
    assert [x.k for x in jobs.resume(r, r.filter("k = 'old'"), "k").collect()] == ["new"]


def test_call_binding_and_resolution(spark):
    calls = table(spark, "call_id int, callee string, arguments array<string>", (1, "f", ["x", "y", "z"]))
    fns = table(spark, "callee string, params array<string>", ("f", ["a", "b"]))
    assert sorted(map(tuple, graphs.bind_arguments(calls, fns).collect())) == [(1, "x", "a"), (1, "y", "b"), (1, "z", "a"), (1, "z", "b")]
    c = table(spark, "file string, callee string", ("m.py", "f"), ("m.py", "g"), ("m.py", "h"))
    imports = table(spark, "file string, name string, target_file string", ("m.py", "f", "lib.py"))
    index = table(spark, "name string, file string, ordinal int", ("f", "z.py", 1), ("g", "b.py", 2), ("g", "a.py", 3))
    assert {(r.callee, r.target) for r in graphs.resolve_calls(c, imports, index).collect()} == {("f", "lib.py"), ("g", "b.py"), ("h", None)}


def test_program_that_does_not_parse_is_a_row(spark):
    from lintlake.graph import flow

    f = table(spark, "path string, content string", ("bad.py", "def ("), ("none.py", None), ("ok.py", "x = 1\n"))
    got = flow.graph(f).filter("kind = 'error'").collect()
    assert [r.path for r in got] == ["bad.py"] and flow.traces(f, ("request.",), ("os.system",)).count() == 0


def test_script_lexer(spark):
    f = table(spark, "path string, content string", ("a.js", "let q = req.query.x;\nconst s = 'a' + q;\nrun(s);"), ("b.php", "<?php $q = $_GET['x'];\n$q = clean($q);\nrun($q);"), ("c.js", "let q = clean(req.query.x);\nrun(q);"))
    got = scripts.script_taint(f, ("req.query", "$_GET"), ("run(",), ("clean(",)).collect()
    assert {(r.path, r.source_line, r.sink_line, r.sanitized) for r in got} == {("a.js", 1, 3, False), ("b.php", 1, 3, True), ("c.js", 1, 2, True)}


def test_linear_taint_equals_a_loop(spark):
    from lintlake.plans import graph_plans

    got = {r.conv_id: (r.n_tainted, r.n_hits) for r in graph_plans.g22(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        tainted, hits = want.setdefault(r.conv_id, ([], []))
        words = r.text.lower().split(" ")
        read = any(w in tainted for w in words)
        if read and r.role == "assistant":
            hits.append(r.turn)
        if (read or r.turn == 0) and words[0] not in tainted:
            tainted.append(words[0])
    assert got == {k: (len(t), len(h)) for k, (t, h) in want.items()}


def test_json_documents_hold_their_rows(spark):
    import json

    from lintlake.plans import finding_plans, report_plans

    lines = report_plans.k1(spark, "/root/testdata/sf0.001")
    assert lines.columns == ["place", "line"]
    document = json.loads("\n".join(r.line for r in sorted(lines.collect())))
    found = document["findings"]
    assert document["summary"]["total"] == len(found)
    assert found and all({"finding_id", "rule_id", "severity", "triage_status", "location"} <= x.keys() for x in found)
    assert {json.loads(r.document)["finding"]["finding_id"] for r in finding_plans.p4(spark, "/root/testdata/sf0.001").collect()} == {x["finding_id"] for x in found}


def test_evidence_grows_with_whole_texts(spark, tmp_path):
    from lintlake.plans import registry

    told = [(1, 0, "The first"), (1, 1, "The second"), (1, 2, "The first"), (1, 3, None), (1, 4, "The second one")]
    table(spark, "conv_id long, turn long, text string", *told).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(registry.QUERIES["w9_evidence_growth"](spark, str(tmp_path)).collect())
    assert [(r.n, r.grew) for r in got] == [(1, True), (2, True), (2, False), (2, False), (3, True)]


@pytest.mark.parametrize(("name", "depth", "starts"), [("g9_backward_slice", 5, (42, 77)), ("g10_path_to_node", 12, (5,))])
def test_slices_reach_the_reference_depth(spark, tmp_path, name, depth, starts):
    from lintlake.plans import registry

    at, keys = starts[0], [1]
    for _ in range(depth + 1):  # a chain upward from the start, each key calling the one before
        at = next(k for k in range(5 * at - 5, 7 * at + 7) if k > at and at in (k // 7, k // 5 + 1))
        keys.append(at)
    table(spark, "o_orderkey long", *[(k,) for k in keys]).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.node: r.level for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert [got.get(k) for k in keys[1:]] == [*range(1, depth + 1), None]


@pytest.mark.parametrize("forward", [False, True])
def test_variable_slice_grows(spark, forward):
    rng, rows, want = random.Random(3), [], {}
    for g in range(12):
        names, hits = {"a"}, []
        for i in range(70):
            reads, writes = rng.sample("abcdefghij", rng.randrange(3)), rng.sample("abcdefghij", rng.randrange(3))
            rows.append((g, i, reads, writes))
            if names & set(reads if forward else writes):
                hits.append(i)
                names |= set(writes if forward else reads)
        want[g] = (sorted(names), hits[:25] if forward else hits[-25:], len(hits))
    rng.shuffle(rows)
    got = graphs.variable_slice(table(spark, "g long, i long, reads array<string>, writes array<string>", *rows), "g", "i", "a", forward).collect()
    assert {r.g: (r.variables, r.slice, r.statement_count) for r in got} == want and max(x[2] for x in want.values()) > 25
