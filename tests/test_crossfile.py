"""Projects of several files with the flows between them that a reader finds."""

import pytest

from lintlake.graph import crossfile as x

#: name, files, {(source path, line, sink path, line, type): (status, hops, chain)}
PROJECTS = [
    ("import of a function", {"app.py": "from db import run\nx = request.args.get('a')\nrun(x)", "db.py": "def run(q):\n    cur.execute(q)"}, {("app.py", 2, "db.py", 2, "SQL_INJECTION"): ("CONFIRMED", 1, ["app.py:3"])}),
    ("import of a module", {"app.py": "import lib.db as d\nd.run(request.json)", "lib/db.py": "def run(q):\n    os.system(q)"}, {("app.py", 2, "lib/db.py", 2, "COMMAND_INJECTION"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("import of a package", {"app.py": "from lib import run\nrun(request.json)", "lib/__init__.py": "def run(q):\n    eval(q)"}, {("app.py", 2, "lib/__init__.py", 2, "CODE_INJECTION"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("file before package", {"app.py": "from lib import run\nrun(request.json)", "lib/__init__.py": "def run(q):\n    eval(q)", "lib.py": "def run(q):\n    pass"}, {}),
    ("relative import", {"a/app.py": "from .db import run\nrun(request.json)", "a/db.py": "from ..c import go\ndef run(q):\n    go(q)", "c.py": "def go(z):\n    eval(z)"}, {("a/app.py", 2, "c.py", 2, "CODE_INJECTION"): ("CONFIRMED", 2, ["a/app.py:2", "a/db.py:3"])}),
    ("no import: first of the index", {"app.py": "run(request.json)", "b.py": "def run(q):\n    eval(q)", "c.py": "def run(q):\n    exec(q)"}, {("app.py", 1, "b.py", 2, "CODE_INJECTION"): ("CONFIRMED", 1, ["app.py:1"])}),
    ("import before index", {"app.py": "from c import run\nrun(request.json)", "b.py": "def run(q):\n    eval(q)", "c.py": "def run(q):\n    open(q)"}, {("app.py", 2, "c.py", 2, "PATH_TRAVERSAL"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("second argument", {"app.py": "from db import run\nrun(1, request.json)", "db.py": "def run(p, q):\n    eval(p)\n    open(q)"}, {("app.py", 2, "db.py", 3, "PATH_TRAVERSAL"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("keyword", {"app.py": "from db import run\nrun(q=request.json)", "db.py": "def run(p, q):\n    eval(p)\n    open(q)"}, {("app.py", 2, "db.py", 3, "PATH_TRAVERSAL"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("starred", {"app.py": "from db import run\nrun(*request.json)", "db.py": "def run(p, q):\n    eval(p)\n    open(q)"}, {("app.py", 2, "db.py", 2, "CODE_INJECTION"): ("CONFIRMED", 1, ["app.py:2"]), ("app.py", 2, "db.py", 3, "PATH_TRAVERSAL"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("further arguments", {"app.py": "from db import run\nrun(1, 2, request.json)", "db.py": "def run(p, *q):\n    eval(p)\n    open(q)"}, {("app.py", 2, "db.py", 3, "PATH_TRAVERSAL"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("method of self", {"app.py": "class A:\n    def f(self):\n        self.g(request.json)\n    def g(self, q):\n        eval(q)"}, {("app.py", 3, "app.py", 5, "CODE_INJECTION"): ("CONFIRMED", 1, ["app.py:3"])}),
    ("cleaned for the type", {"app.py": "from db import run\nx = shlex.quote(request.json)\nrun(x)", "db.py": "def run(q):\n    os.system(q)\n    cur.execute(q)"}, {("app.py", 2, "db.py", 2, "COMMAND_INJECTION"): ("SUPPRESSED", 1, ["app.py:3"]), ("app.py", 2, "db.py", 3, "SQL_INJECTION"): ("CONFIRMED", 1, ["app.py:3"])}),
    ("cleaned in the callee", {"app.py": "from db import run\nrun(request.json)", "db.py": "def run(q):\n    p = shlex.quote(q)\n    os.system(p)\n    os.system(q)"}, {("app.py", 2, "db.py", 3, "COMMAND_INJECTION"): ("SUPPRESSED", 1, ["app.py:2"]), ("app.py", 2, "db.py", 4, "COMMAND_INJECTION"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("cleaned on one way only", {"app.py": "from db import run, safe\nx = request.json\nrun(x)\nsafe(x)", "db.py": "def run(q):\n    go(q)\ndef safe(q):\n    go(shlex.quote(q))\ndef go(z):\n    os.system(z)"}, {("app.py", 2, "db.py", 6, "COMMAND_INJECTION"): ("CONFIRMED", 2, ["app.py:3", "db.py:2"])}),
    ("conversion mitigates no type alone", {"app.py": "from db import run\nrun(int(request.json))", "db.py": "def run(q):\n    os.system(q)"}, {("app.py", 2, "db.py", 2, "COMMAND_INJECTION"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("returned source", {"app.py": "from web import get\nx = get()\nos.system(x)", "web.py": "from low import read\ndef get():\n    return read()", "low.py": "def read():\n    y = input()\n    return y"}, {("low.py", 2, "app.py", 3, "COMMAND_INJECTION"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("result of what it is given", {"app.py": "from u import same\nx = same(request.json)\nos.system(x)", "u.py": "def same(a):\n    return a"}, {("app.py", 2, "app.py", 3, "COMMAND_INJECTION"): ("CONFIRMED", 0, [])}),
    ("cycle of calls", {"a.py": "from b import g\ndef f(x, n):\n    g(x, n)\nf(request.json, 3)", "b.py": "from a import f\ndef g(y, n):\n    if n:\n        f(y, n - 1)\n    os.system(y)"}, {("a.py", 4, "b.py", 5, "COMMAND_INJECTION"): ("CONFIRMED", 2, ["a.py:4", "a.py:3"])}),
    ("broken file", {"app.py": "from db import run\nrun(request.json)", "db.py": "def run(q):\n    os.system(q)", "bad.py": "def ("}, {("app.py", 2, "db.py", 2, "COMMAND_INJECTION"): ("CONFIRMED", 1, ["app.py:2"])}),
    ("killed before the call", {"app.py": "from db import run\nx = request.json\nx = 'a'\nrun(x)", "db.py": "def run(q):\n    os.system(q)"}, {}),
    ("other lines of the callee's file", {"app.py": "from db import run\nrun(request.json)", "db.py": "def run(q):\n    pass\ndef other(q):\n    os.system(q)"}, {}),
]


@pytest.fixture(scope="module")
def found(spark):
    """All projects in one table, each in a folder of its own; names that are imported are looked up from there too."""
    rows = [(f"p{i}/{path}", text) for i, (_, files, _) in enumerate(PROJECTS) for path, text in files.items() if not PROJECTS[i][0].startswith("no import")]
    got = x.cross_file(spark.createDataFrame(rows, "path string, content string").repartition(3)).collect()
    alone = next(files for name, files, _ in PROJECTS if name.startswith("no import"))
    got += x.cross_file(spark.createDataFrame([(f"p5/{p}", t) for p, t in alone.items()], "path string, content string")).collect()
    return got


@pytest.mark.parametrize("i", range(len(PROJECTS)), ids=[p[0] for p in PROJECTS])
def test_projects(found, i):
    cut = lambda s: s.removeprefix(f"p{i}/")
    mine = [r for r in found if r["source_path"].startswith(f"p{i}/")]
    assert {(cut(r["source_path"]), r["source_line"], cut(r["sink_path"]), r["sink_line"], r["vulnerability_type"]): (r["triage_status"], r["hops"], [cut(c) for c in r["chain"]]) for r in mine} == PROJECTS[i][2]
    for r in mine:
        assert r["severity"] == ("CRITICAL" if r["vulnerability_type"] in x.SEVERE else "HIGH") and r["confidence"] == 0.92
        assert r["n_files"] == len({r["source_path"], r["sink_path"], *(c.rsplit(":", 1)[0] for c in r["chain"])})


def test_depth(spark):
    rows = [(f"m{i}.py", f"from m{i + 1} import f{i + 1}\ndef f{i}(a):\n    f{i + 1}(a)") for i in range(7)] + [("m7.py", "def f7(a):\n    os.system(a)"), ("app.py", "from m0 import f0\nfrom m2 import f2\nf0(request.json)\nf2(request.json)")]
    files = spark.createDataFrame(rows, "path string, content string")
    assert [(r["source_line"], r["hops"]) for r in x.cross_file(files).collect()] == [(4, 6)]
    assert sorted((r["source_line"], r["hops"]) for r in x.cross_file(files, depth=9).collect()) == [(3, 8), (4, 6)]


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([("a.py", None), ("b.py", ""), ("c.py", "def (")], "path string, content string")
    assert x.cross_file(files).collect() == [] == x.cross_file(files.limit(0)).collect()


def test_candidates():
    assert x.candidates("a/b/c.py", "pkg.mod.f") == [("pkg/mod.py", "f"), ("pkg/mod/__init__.py", "f"), ("a/b/pkg/mod.py", "f"), ("a/b/pkg/mod/__init__.py", "f"), ("pkg.py", "mod.f"), ("pkg/__init__.py", "mod.f"), ("a/b/pkg.py", "mod.f"), ("a/b/pkg/__init__.py", "mod.f")]
    assert x.candidates("a/b/c.py", "..m.f") == [("a/m.py", "f"), ("a/m/__init__.py", "f"), ("a/__init__.py", "m.f")]


@pytest.mark.parametrize("name", ["g15_returned_sources", "g17_cross_file_taint", "j7_import_calls", "j8_bound_arguments", "j17_call_graph"])
def test_files_are_read_once(spark, monkeypatch, name):
    """All that follows reads written tables: no level of a fixpoint goes back to the files."""
    from lintlake.plans import program_plans
    from lintlake.plans.base import QUERIES

    plans = []
    monkeypatch.setattr(x, "written", lambda df, n, w=x.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or w(df, n))
    few = lambda s, d, m=program_plans.modules: m(s, d).limit(20)
    monkeypatch.setattr(program_plans, "modules", few)
    plans.append(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("MapInArrow") for p in plans) == 1
