"""What is worked out for a program, and how often: results are those of plain walks, the work is not."""

import ast

import pytest

from lintlake.graph import crossfile, program
from lintlake.graph.program import Flow, Taint

NESTED = """
import a.b as c
def f(x):
    global g
    try:
        from m import n as o
        if x: p = o
        else:
            q = c.z
    except E as e:
        r = p
    finally:
        for i in x: import k
    match x:
        case [1, *s]:
            t = q
    class D:
        nonlocal_ = r
        def m(self):
            global h
            u = t
    with x as y: v = [w for w in x if (z := w)]
"""


def test_statements_are_those_of_a_walk_in_its_order():
    tree = ast.parse(NESTED)
    assert program.statements(tree)[1:] == [n for n in ast.walk(tree) if isinstance(n, (ast.stmt, ast.excepthandler, ast.match_case))]
    f = tree.body[1]
    assert {x for n in program.statements(f, inner=False) if isinstance(n, ast.Global) for x in n.names} == {"g"}
    assert Flow(NESTED).functions[0].shared == {"g"}


def test_plain_statements_are_not_walked_for_imports_and_scopes(monkeypatch):
    text = "def f(p, q):\n" + "".join(f"    v{i % 5} = g(v{i % 3}, p, q)\n    os.system(v1)\n" for i in range(200))
    seen = []
    for name in ("walk", "iter_child_nodes"):
        monkeypatch.setattr(ast, name, lambda n, w=getattr(ast, name): seen.append(n) or w(n))
    g = Flow(text)
    assert len(g.nodes) > 400 and len(seen) < 10


@pytest.mark.parametrize("last", ["pass", "return v3"])
def test_a_node_is_worked_out_once_for_summary_and_ports(monkeypatch, last):
    made = []
    monkeypatch.setattr(Taint, "_hot", lambda self, n, w=Taint._hot: made.append(n.id) or w(self, n))
    text = "def f(p, q):\n    v = p\n" + "    if q: return q\n" * 50 + f"    {last}\n" + "f(1, 2)\n"
    g = Flow(text)
    t = Taint(g, crossfile.SOURCES, crossfile.SINKS, {})
    before = len(made)
    ports = t.ports()
    # the nodes that the summary's run came to are not worked out again: what is left is the look for sources
    assert len(made) - before <= len(g.nodes) + 5 and any(x[5] == "return" for x in ports)


def test_summaries_that_change_are_used():
    """What was worked out with a summary is dropped when that summary grows: through callers, defaults and recursion."""
    text = "def a(x):\n    return b(x)\ndef b(y):\n    return c(y)\ndef c(z):\n    if z: return a(z)\n    return z\ndef d(w=a(input())):\n    return w\nos.system(a(request.json))\n"
    assert [r[:2] for r in Taint(Flow(text), ("request.json",), ("os.system",)).trace()] == [(10, 10)]
    assert Taint(Flow(text), ("request.json", "input(")).returning()[-1] == "d"


def test_lines_are_measured_once(spark):
    """The words of a line are not split again for every place of its program that depends on them."""
    from lintlake.plans import program_plans as p

    for make in (p.programs, p.modules, p.guarded, p.checked, p.script_files):
        assert make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_functions_that_nothing_calls_get_a_summary_only_where_it_is_asked_for(monkeypatch):
    ran = []
    monkeypatch.setattr(Taint, "_run", lambda self, start, inside=None, ports=False, w=Taint._run: ran.append(inside) or w(self, start, inside, ports))
    text = "def f(a, b):\n    return a\ndef g(c):\n    return f(c, 1)\ndef h(x=g(2)):\n    return x\n"
    g = Flow(text)
    names = lambda: sorted(g.functions[i].name for i in ran if i is not None)
    Taint(g, ("input(",)).returning()
    assert names() == ["f", "g", "g"] or names() == ["f", "g"]
    assert {f.name: f.depends for f in g.functions} == {"f": ["a"], "g": ["c"], "h": ["x"]}
