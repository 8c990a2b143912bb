"""Programs with the flows and the constant sinks that a reader finds in them."""

import ast

import pytest

from lintlake.graph.flow import Def, Flow, Taint, Values, all_args

SOURCES, SINKS, CLEAN = ("request.",), ("os.system",), ("escape",)

#: name, program, (source line, sink line, sanitized) of each flow
FLOWS = [
    ("plain", "x = request.args\nos.system(x)", {(1, 2, False)}),
    ("overwritten", "x = request.args\nx = 'a'\nos.system(x)", set()),
    ("direct", "os.system(request.args)", {(1, 1, False)}),
    ("direct, cleaned", "os.system(escape(request.args))", {(1, 1, True)}),
    ("two sources", "if c:\n    x = request.args\nelse:\n    x = request.form\nos.system(x)", {(2, 5, False), (4, 5, False)}),
    ("cleaned", "x = request.args\nx = escape(x)\nos.system(x)", {(1, 3, True)}),
    ("cleaned on one way", "x = request.args\nif c:\n    x = escape(x)\nos.system(x)", {(1, 4, False)}),
    ("chain", "a = request.args\nb = a + 'x'\nc = f'{b}'\nos.system(c)", {(1, 4, False)}),
    ("method", "class A:\n    def f(self):\n        x = request.args\n        os.system(x)", {(3, 4, False)}),
    ("async", "async def f():\n    x = await request.json()\n    os.system(x)", {(2, 3, False)}),
    ("async with", "async def f():\n    async with request.get() as x:\n        os.system(x)", {(2, 3, False)}),
    ("async for", "async def f():\n    async for x in request.lines():\n        os.system(x)", {(2, 3, False)}),
    ("augmented", "x = 'ls '\nx += request.args\nos.system(x)", {(2, 3, False)}),
    ("augmented keeps", "x = request.args\nx += 'a'\nos.system(x)", {(1, 3, False)}),
    ("annotated", "x: str = request.args\nos.system(x)", {(1, 2, False)}),
    ("annotation alone", "x = request.args\nx: str\nos.system(x)", {(1, 3, False)}),
    ("tuple", "a, b = request.args\nos.system(b)", {(1, 2, False)}),
    ("loop target", "for x in request.args:\n    os.system(x)", {(1, 2, False)}),
    ("around a loop", "y = 'a'\nfor i in r:\n    os.system(y)\n    y = request.args", {(4, 3, False)}),
    ("loop that may not run", "x = request.args\nfor x in []:\n    pass\nos.system(x)", {(1, 4, False)}),
    ("loop else", "x = request.args\nfor i in r:\n    pass\nelse:\n    os.system(x)", {(1, 5, False)}),
    ("break", "x = 'a'\nwhile True:\n    x = request.args\n    break\nos.system(x)", {(3, 5, False)}),
    ("dead after return", "def f():\n    x = request.args\n    return 1\n    os.system(x)", set()),
    ("dead after endless loop", "x = request.args\nwhile True:\n    pass\nos.system(x)", set()),
    ("handler", "x = 'a'\ntry:\n    x = request.args\n    g()\nexcept E:\n    os.system(x)", {(3, 6, False)}),
    ("finally", "x = 'a'\ntry:\n    x = request.args\nfinally:\n    os.system(x)", {(3, 5, False)}),
    ("with", "with open(request.args) as x:\n    os.system(x)", {(1, 2, False)}),
    ("nested sink", "x = request.args\ny = 1 + os.system(x)", {(1, 2, False)}),
    ("sink in test", "x = request.args\nif os.system(x):\n    pass", {(1, 2, False)}),
    ("sink in return", "def f():\n    x = request.args\n    return os.system(x)", {(2, 3, False)}),
    ("sink in assert", "x = request.args\nassert os.system(x) == 0", {(1, 2, False)}),
    ("walrus", "if (x := request.args):\n    os.system(x)", {(1, 2, False)}),
    ("match", "match request.args:\n    case [x, *y]:\n        os.system(y)", {(2, 3, False)}),
    ("match of a name", "r = request.args\nmatch r:\n    case [x, *y]:\n        os.system(y)", {(1, 4, False)}),
    ("mutator", "a = []\na.append(request.args)\nos.system(a)", {(2, 3, False)}),
    ("element", "d = {}\nd['k'] = request.args\nos.system(d)", {(2, 3, False)}),
    ("keyword", "x = request.args\nos.system(command=x)", {(1, 2, False)}),
    ("through a function", "def pick(a, b):\n    return a\nx = request.args\ny = pick(x, 1)\nos.system(y)", {(3, 5, False)}),
    ("function that drops it", "def pick(a, b):\n    return a\nx = request.args\ny = pick(1, x)\nos.system(y)", set()),
    ("unknown function", "x = request.args\ny = other(x)\nos.system(y)", {(1, 3, False)}),
    ("closure", "def f():\n    x = request.args\n    def g():\n        os.system(x)\n    g()", {(2, 4, False)}),
    ("shadowed in a closure", "def f():\n    x = request.args\n    def g(x):\n        os.system(x)\n    g(1)", set()),
    ("module name", "x = request.args\ndef f():\n    os.system(x)", {(1, 3, False)}),
    ("comprehension", "x = [a for a in request.args]\nos.system(x)", {(1, 2, False)}),
    ("deleted", "x = request.args\ndel x\nos.system(x)", set()),
    ("other argument", "x = request.args\nlog(x)\nos.system('a')", set()),
    ("halfway to finally", "x = 'a'\ntry:\n    x = request.args\n    g()\n    x = 'safe'\nfinally:\n    os.system(x)", {(3, 7, False)}),
    ("after finally", "x = 'a'\ntry:\n    x = request.args\n    g()\n    x = 'safe'\nfinally:\n    pass\nos.system(x)", set()),
    ("return through finally", "def f():\n    x = request.args\n    try:\n        return 1\n    finally:\n        os.system(x)", {(2, 6, False)}),
    ("dead after finally", "def f():\n    x = request.args\n    try:\n        return 1\n    finally:\n        pass\n    os.system(x)", set()),
    ("break through finally", "for i in r:\n    try:\n        x = request.args\n        break\n    finally:\n        os.system(x)", {(3, 6, False)}),
    ("cleaned copy", "x = request.args\ny = escape(x)\nos.system(x)", {(1, 3, False)}),
    ("the cleaned copy itself", "x = request.args\ny = escape(x)\nos.system(y)", {(1, 3, True)}),
    ("cleaned beside", "os.system(escape('a') + request.args)", {(1, 1, False)}),
    ("cleaned beside a name", "x = request.args\nos.system(escape(x) + x)", {(1, 2, False)}),
    ("cleaned at once", "x = escape(request.args)\nos.system(x)", {(1, 2, True)}),
    ("cleaned at the sink", "x = request.args\nos.system(escape(x))", {(1, 2, True)}),
    ("cleaned in a function", "def f(a):\n    return escape(a)\nx = f(request.args)\nos.system(x)", {(3, 4, True)}),
    ("cleaned by method", "x = html.escape(request.args)\nos.system(x)", {(1, 2, True)}),
    ("imported sink", "from os import system\nsystem(request.args)", {(2, 2, False)}),
    ("imported sink by another name", "from os import system as run\nrun(request.args)", {(2, 2, False)}),
    ("imported module by another name", "import os as o\nx = request.args\no.system(x)", {(2, 3, False)}),
    ("sink in a name", "import os\nrun = os.system\nrun(request.args)", {(3, 3, False)}),
    ("starred argument", "def pick(a, b):\n    return b\nx = request.args\ny = pick(*x)\nos.system(y)", {(3, 5, False)}),
    ("starred keywords", "def pick(a, b):\n    return b\nx = request.args\ny = pick(**x)\nos.system(y)", {(3, 5, False)}),
    ("further arguments", "def pick(a, *b):\n    return b\ny = pick(1, 2, request.args)\nos.system(y)", {(3, 4, False)}),
    ("further keywords", "def pick(a, **b):\n    return b\ny = pick(1, k=request.args)\nos.system(y)", {(3, 4, False)}),
    ("two functions of a name", "def pick(a):\n    return 'a'\ndef pick(a):\n    return a\ny = pick(request.args)\nos.system(y)", {(5, 6, False)}),
    ("written after its reader", "def f():\n    os.system(x)\nx = request.args\nf()", {(3, 2, False)}),
    ("written, called, written", "def f():\n    os.system(x)\nx = request.args\nf()\nx = 'a'", {(3, 2, False)}),
    ("written around an inner function", "def f():\n    def g():\n        os.system(x)\n    x = request.args\n    g()", {(4, 3, False)}),
    ("sink in a function", "def run(c):\n    os.system(c)\nx = request.args\nrun(x)", {(3, 2, False)}),
    ("sink two functions down", "def a(c):\n    b(c)\ndef b(d):\n    os.system(d)\na(request.args)", {(5, 4, False)}),
    ("sink in a method", "class A:\n    def f(self, c):\n        self.g(c)\n    def g(self, d):\n        os.system(d)\n    def h(self):\n        self.f(request.args)", {(7, 5, False)}),
    ("recursion", "def f(a, n):\n    if n:\n        return f(a, n - 1)\n    return a\nos.system(f(request.args, 3))", {(5, 5, False)}),
    ("mutual recursion", "def f(a):\n    return g(a)\ndef g(a):\n    if a:\n        return a\n    return f(a)\nx = f(request.args)\nos.system(x)", {(7, 8, False)}),
    ("other caller of a function", "def same(a):\n    return a\nx = same(request.args)\ny = same('a')\nos.system(y)", set()),
    ("function that returns a source", "def fetch():\n    return request.args\nx = fetch()\nos.system(x)", {(2, 4, False)}),
    ("function that returns a name from outside", "x = request.args\ndef get():\n    return x\ny = get()\nos.system(y)", {(1, 5, False)}),
    ("default value", "def f(x=request.args):\n    os.system(x)", {(1, 2, False)}),
    ("global written in a function", "def f():\n    global x\n    x = request.args\ndef g():\n    os.system(x)", {(3, 5, False)}),
    ("swap", "a, b = request.args, 'x'\na, b = b, a\nos.system(a)\nos.system(b)", {(1, 4, False)}),
    ("element by element", "a, b = 'x', request.args\nos.system(a)", set()),
    ("index", "d = {}\nd[request.args] = 1\nos.system(d)", {(2, 3, False)}),
    ("attribute keeps", "x = request.args\nx.a = 1\nos.system(x)", {(1, 3, False)}),
    ("lambda", "x = request.args\nf = lambda: os.system(x)", {(1, 2, False)}),
    ("raised", "def f():\n    x = request.args\n    raise E(os.system(x))", {(2, 3, False)}),
]


@pytest.mark.parametrize(("name", "program", "flows"), FLOWS, ids=[f[0] for f in FLOWS])
def test_flows(name, program, flows):
    assert {(a, b, clean) for a, b, _, clean in Taint(Flow(program), SOURCES, SINKS, CLEAN).trace()} == flows


def test_many_branches():
    program = "x = request.args\n" + "".join(f"if c{i}:\n    y{i} = x\n" for i in range(60)) + "os.system(y59)"
    assert [(a, b) for a, b, _, _ in Taint(Flow(program), SOURCES, SINKS).trace()] == [(1, 122)]


def test_work_grows_with_the_file():
    import time

    took = []
    for n in (1_000, 16_000):
        lines = ["def f(v0):", *(f"    v{i + 1} = v{i}" for i in range(n)), *(f"    if c:\n        w = v{i}" for i in range(n)), *(f"    u.append(v{i})" for i in range(n)), "    os.system(u, w)", "f(request.args)"]
        began = time.process_time()
        assert [x[:2] for x in Taint(Flow("\n".join(lines)), SOURCES, SINKS).trace()] == [(len(lines) + n, len(lines) + n - 1)]
        took.append(time.process_time() - began)
    assert took[1] < 60 * took[0]


def test_definitions_reach_through_merges():
    f = Flow("x = 1\nif c:\n    x = 2\nelif d:\n    y = 3\nprint(x)")
    assert [(f.nodes[a].line, f.nodes[b].line, v) for a, b, v in f.dfg if v == "x"] == [(1, 6, "x"), (3, 6, "x")]


#: name, body of f(q), {line: keep} of the sinks that can be reached
VALUES = [
    ("constant", "c = 'a'\nos.system(c)", {3: False}),
    ("parameter", "os.system(q)", {2: True}),
    ("folded", "c = 'a' + 'b'\nos.system(f'{c} x')", {3: False}),
    ("format spec", "c = 1.5\nos.system(f'{c:.2f}')", {3: True}),
    ("augmented", "c = 'a'\nc += q\nos.system(c)", {4: True}),
    ("augmented constant", "c = 'a'\nc += 'b'\nos.system(c)", {4: False}),
    ("annotated", "c = 'a'\nc: str = q\nos.system(c)", {4: True}),
    ("annotation alone", "c = 'a'\nc: str\nos.system(c)", {4: False}),
    ("finally", "c = 'a'\ntry:\n    g()\nfinally:\n    c = q\nos.system(c)", {7: True}),
    ("try body", "c = 'a'\ntry:\n    c = q\nexcept E:\n    pass\nos.system(c)", {7: True}),
    ("handler", "c = 'a'\ntry:\n    g()\nexcept E:\n    c = q\nos.system(c)", {7: True}),
    ("sink in handler", "c = 'a'\ntry:\n    c = q\n    g()\nexcept E:\n    os.system(c)", {7: True}),
    ("sink in finally", "c = 'a'\ntry:\n    c = q\nfinally:\n    os.system(c)", {6: True}),
    ("sink in try else", "c = 'a'\ntry:\n    g()\nexcept E:\n    return\nelse:\n    os.system(c)", {8: False}),
    ("constant through try", "c = 'a'\ntry:\n    g()\nexcept E:\n    h()\nos.system(c)", {7: False}),
    ("loop", "c = 'a'\nfor i in q:\n    os.system(c)\n    c = i", {4: True}),
    ("constant in loop", "c = 'a'\nfor i in q:\n    os.system(c)", {4: False}),
    ("while else", "c = 'a'\nwhile q:\n    c = q\nelse:\n    os.system(c)", {6: True}),
    ("for else", "c = 'a'\nfor i in q:\n    pass\nelse:\n    os.system(c)", {6: False}),
    ("endless", "while True:\n    pass\nos.system(q)", {}),
    ("endless with break", "c = 'a'\nwhile True:\n    c = q\n    break\nos.system(c)", {6: True}),
    ("walrus", "c = 'a'\nif (c := q):\n    pass\nos.system(c)", {5: True}),
    ("with target", "c = 'a'\nwith g() as c:\n    os.system(c)", {4: True}),
    ("swallowed", "c = 'a'\nwith suppress(E):\n    c = q\n    g()\n    c = 'a'\nos.system(c)", {7: True}),
    ("tuple", "c, e = 'a', q\nos.system(c)\nos.system(e)", {3: False, 4: True}),
    ("swap", "c, e = 'a', q\nc, e = e, c\nos.system(c)\nos.system(e)", {4: True, 5: False}),
    ("star", "c = 'a'\n*c, e = q\nos.system(c)", {4: True}),
    ("live side", "c = q\nif 1 == 1:\n    c = 'a'\nos.system(c)", {5: False}),
    ("dead side", "if 1 == 2:\n    os.system(q)", {}),
    ("both sides", "if q:\n    c = 'a'\nelse:\n    c = q\nos.system(c)", {6: True}),
    ("equal on both", "if q:\n    c = 'a'\nelse:\n    c = 'a'\nos.system(c)", {6: False}),
    ("one and true", "if q:\n    c = 1\nelse:\n    c = True\nos.system(c)", {6: True}),
    ("global", "global c\nc = 'a'\ng()\nos.system(c)", {5: True}),
    ("nonlocal", "c = 'a'\ndef h():\n    nonlocal c\n    c = q\nh()\nos.system(c)", {7: True}),
    ("locals", "c = 'a'\nlocals()['c'] = q\nos.system(c)", {4: True}),
    ("import", "c = 'a'\nimport c\nos.system(c)", {4: True}),
    ("deleted", "c = 'a'\ndel c\nos.system(c)", {4: True}),
    ("match", "c = 'a'\nmatch q:\n    case [c]:\n        pass\nos.system(c)", {6: True}),
    ("lambda", "c = 'a'\nh = lambda c: os.system(c)", {3: True}),
    ("comprehension", "c = 'a'\n[os.system(c) for c in q]", {3: True}),
    ("keywords alone", "os.system(command='a')", {2: True}),
    ("starred", "c = ('a',)\nos.system(*c)", {3: True}),
    ("nested call", "g(os.system('a'))", {2: False}),
    ("after return", "return\nos.system(q)", {}),
    ("star import", "c = 'a'\nfrom m import *\nos.system(c)", {4: True}),
    ("exec", "c = 'a'\nexec(q)\nos.system(c)", {4: True}),
    ("setattr", "c = 'a'\nsetattr(sys.modules[__name__], 'c', q)\nos.system(c)", {4: True}),
    ("grown beyond bounds", "c = 'a'\n" + "c += c\n" * 60 + "os.system(c)", {63: True}),
    ("number grown beyond bounds", "c = 9\n" + "c = c * c\n" * 60 + "os.system(c)", {63: True}),
    ("comparison", "c = q\nif 3 * 4 > 10:\n    c = 'a'\nos.system(c)", {5: False}),
    ("chained comparison", "c = q\nif 1 < 2 <= 2:\n    c = 'a'\nos.system(c)", {5: False}),
    ("comparison of kinds", "c = 'a'\nif 1 < 'x':\n    c = q\nos.system(c)", {5: True}),
    ("or decides", "c = 'a'\nif q or 1:\n    c = 'b'\nos.system(c)", {5: True}),
    ("and of constants", "c = 'a'\nif 1 and 0:\n    c = q\nos.system(c)", {5: False}),
    ("remainder, negation", "c = 'a'\nif -7 % 4 != 1 or not 1:\n    c = q\nos.system(c)", {5: False}),
    ("division by zero", "c = 'a'\nif 1 // 0:\n    c = q\nos.system(c)", {5: True}),
    ("member", "c = 'a'\nif 'x' in 'abc':\n    c = q\nos.system(c)", {5: False}),
    ("text times number", "c = 'a' * 9\nos.system(c)", {3: True}),
    ("class body", "class A:\n    os.system('a')\n    def m(self, c):\n        os.system(c)", {3: False, 5: True}),
]


@pytest.mark.parametrize(("name", "body", "want"), VALUES, ids=[v[0] for v in VALUES])
def test_constant_sinks(name, body, want):
    program = "def f(q):\n" + "\n".join("    " + x for x in body.split("\n"))
    tree = ast.parse(program)
    v = Values(SINKS, tree)
    for f in [tree, *(n for n in ast.walk(tree) if isinstance(n, Def))]:
        v.block(f.body, dict.fromkeys(all_args(f), "tainted") if isinstance(f, Def) else {})
    assert {line: not isinstance(x, tuple) for line, x in v.hits.items()} == want


# --- random programs against every way through them

WAYS = 3_000


def ways(body, depth=2):
    """Every way through a block as lists of simple statements; loops, which hold no branches, run up to five times. A way ends early at a return."""
    out = [([], False)]
    for s in body:
        here = []
        for done, ended in out:
            if ended:
                here.append((done, True))
            elif isinstance(s, ast.If):
                here += [(done + w, e) for b in (s.body, s.orelse) for w, e in ways(b, depth)]
            elif isinstance(s, ast.While):
                [(once, e)] = ways(s.body, depth)  # no branch inside
                here += [(done + once * n, e and n > 0) for n in range(2 if e else 6)]
            elif isinstance(s, ast.Return):
                here.append((done, True))
            else:
                here.append((done + [s], False))
        out = here
        assert len(out) < WAYS
    return out


def run_way(way):
    """(source line, sink line, clean) of one way, by what each name holds."""
    env, found = {}, set()

    def value(e):
        if isinstance(e, ast.Name):
            return env.get(e.id, set())
        if isinstance(e, ast.Attribute):
            return {(e.lineno, False)} if ast.unparse(e) == "request.args" else value(e.value)
        if isinstance(e, ast.Call):
            got = set().union(*(value(a) for a in e.args))
            return {(o, True) for o, _ in got} if e.func.id == "escape" else got
        return set().union(*(value(x) for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr)))

    for s in way:
        if isinstance(s, ast.Assign):
            parts = [(t, value(v)) for t, v in (zip(s.targets[0].elts, s.value.elts) if isinstance(s.targets[0], ast.Tuple) else [(s.targets[0], s.value)])]
            for t, v in parts:
                env[t.id] = v
        elif isinstance(s, ast.AugAssign):
            env[s.target.id] = env.get(s.target.id, set()) | value(s.value)
        elif isinstance(s, ast.Expr) and ast.unparse(s.value.func) == "os.system":
            found |= {(o, s.lineno, c) for a in s.value.args for o, c in value(a)}
        elif isinstance(s, ast.Expr):
            env[s.value.func.value.id] = env.get(s.value.func.value.id, set()) | value(s.value.args[0])
    return found


def program_of(rng, depth=0):
    out = []
    for _ in range(rng.randrange(2, 7)):
        a, b, c = (rng.choice("xyz") for _ in range(3))
        kind = rng.randrange(12 if depth < 2 else 9)
        if kind < 9:
            out.append([f"{a} = request.args", f"{a} = {b}", f"{a} = escape({b})", f"os.system({a})", f"{a} = 'k'", f"{a} += {b}", f"{a}.append({b})", f"os.system({a} + escape({b}))", f"{a}, {b} = {b}, {c}" if a != b else f"{a} = {c}"][kind])
        elif kind == 11:
            out += [f"while {a}:", *("    " + x for x in program_of(rng, depth + 2))]
        else:
            out += [f"if {a}:", *("    " + x for x in program_of(rng, depth + 1))]
            if rng.random() < 0.5:
                out += ["else:", *("    " + x for x in program_of(rng, depth + 1))]
        if depth and rng.random() < 0.1:
            out.append("return")
    return out


def test_random_programs():
    import random

    rng, some, flows = random.Random(21), 0, 0
    while some < 300:
        text = "def f():\n    x = request.args\n" + "\n".join("    " + x for x in program_of(rng))
        try:
            want = set().union(*(run_way(w) for w, _ in ways(ast.parse(text).body[0].body)))
        except AssertionError:  # too many ways to walk
            continue
        some += 1
        pairs = {(a, b) for a, b, _ in want}
        want = {(a, b, (a, b, False) not in want) for a, b in pairs}
        got = {(a, b, clean) for a, b, _, clean in Taint(Flow(text), SOURCES, SINKS, CLEAN).trace()}
        assert got == want, text
        flows += len(want)
    assert flows > 300


def test_rows_are_given_in_small_batches():
    """Many files in one batch do not hold all their rows at once."""
    import pyarrow as pa

    from lintlake.graph import flow

    schema = pa.schema({"path": pa.string(), "n": pa.int64()})
    files = pa.record_batch([pa.array([f"f{i}" for i in range(100)]), pa.array([None, "x"] * 50)], names=["path", "content"])
    got = list(flow._per_file(lambda p, t: [(p, i) for i in range(1_000 if t else 0)], schema)(iter([files])))
    assert sum(b.num_rows for b in got) == 50_000 and max(b.num_rows for b in got) < flow.ROWS + 1_000
    assert [r["n"] for b in got for r in b.to_pylist()] == [*range(1_000)] * 50
    assert list(flow._per_file(lambda p, t: [], schema)(iter([files]))) == []


def test_statements_are_written_out_once(monkeypatch):
    """A function's first line needs nothing of its body, and equal statements on one line are written out once for all files."""
    import ast

    from lintlake.graph.program import Flow

    text = "def f(a):\n" + "".join(f"    v{i} = request.args  # {i}\n    if v{i}: pass\n" for i in range(40)) + "    return a\n"
    first = [n.text for n in Flow(text).nodes]
    seen = []
    monkeypatch.setattr(ast, "unparse", lambda n, u=ast.unparse: seen.append(u(n)) or seen[-1])
    assert [n.text for n in Flow(text).nodes] == first and "v7 = request.args" in first and "if v7:" in first
    assert seen == ["def f(a):\n    pass"]
