"""A Python file as nodes with control and data edges, and the flow of values between them.

Names are followed by definitions: a read is joined to the definitions that reach it, through merges where several do
(each merge stands once for each name, so the graph grows with the file, not with the pairs). A write that may leave what
the name held (an element, a mutator, a loop's target) reads the name too and hands it on. Values are followed by
expressions: what a sanitizer is given comes out clean, what a function of the file is given comes out if its summary
says so, everything else that is read comes out as it went in.
"""

from __future__ import annotations

import ast
import copy
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from lintlake.graph.dominance import dominators, frontiers

# Methods that put their arguments into what they are called on.
MUTATORS = {"append", "extend", "add", "update", "insert", "setdefault"}

Def = (ast.FunctionDef, ast.AsyncFunctionDef)


@dataclass
class Move:
    """What a node writes: the names, the expressions that flow into them, and whether the names keep what they held."""

    writes: set[str]
    values: list[ast.AST]
    keeps: bool = False


@dataclass
class Node:
    id: int
    kind: str
    line: int
    scope: str
    text: str
    function: int = -1  # that it belongs to; -1: the module
    moves: list[Move] = field(default_factory=list)
    looks: list[ast.AST] = field(default_factory=list)  # expressions that are evaluated
    reads: set[str] = field(default_factory=set)
    end: int = 0  # last line of its statement

    @cached_property
    def writes(self) -> set[str]:
        return set().union(*(m.writes for m in self.moves)) if self.moves else set()


@dataclass
class Function:
    id: int
    name: str
    line: int
    params: list[str]
    entry: int
    scope: int  # the function around it, -1: none
    method: bool
    star: str | None  # the parameter that takes further arguments, and further keywords
    stars: str | None
    end: int = 0
    returns: list[int] = field(default_factory=list)
    flow: Flow | None = field(default=None, repr=False, compare=False)
    shared: set[str] = field(default_factory=set)  # names of other scopes that it writes

    @property
    def depends(self) -> list[str]:
        """Parameters that reach a return."""
        return [p for p in self.params if self.flow.summary.through[self.id].get(p)]

    def bound(self, call: ast.Call, bare: bool) -> Iterator[tuple[ast.AST, list[str]]]:
        """Arguments with the parameters they may go to. bare: called by name, so a method's first parameter is given like any other."""
        params = self.params if bare or not self.method else self.params[1:]
        every = [*params, *(x for x in (self.star, self.stars) if x)]
        loose = False
        for i, a in enumerate(call.args):
            loose = loose or isinstance(a, ast.Starred)
            yield a, every if loose or i >= len(params) and not self.star else [params[i]] if i < len(params) else [self.star]
        for k in call.keywords:
            yield k.value, [k.arg] if k.arg in self.params else [self.stars] if k.arg and self.stars else every


#: Nodes without parts, of which no one asks.
_BARE = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)


def walked(e: ast.AST) -> list[ast.AST]:
    """The nodes under an expression as ast.walk gives them, but for contexts and operators (kept at the node: trees are not changed)."""
    got = getattr(e, "_walked", None)
    if got is None:
        got = [e]
        for n in got:
            for f in n._fields if not isinstance(n, (ast.Name, ast.Constant)) else ():
                x = getattr(n, f, None)
                if isinstance(x, ast.AST):
                    if not isinstance(x, _BARE):
                        got.append(x)
                elif isinstance(x, list):
                    got += [y for y in x if isinstance(y, ast.AST) and not isinstance(y, _BARE)]
        e._walked = got
    return got


#: First lines by the text of a statement on one line; bounded.
_LINES: dict[str, str] = {}


def first_line(s: ast.stmt, lines: list[str] | None) -> str:
    """The first line of a statement as ast.unparse writes it. lines: the program's, where positions in them are characters."""
    text = lines[s.lineno - 1][s.col_offset : s.end_col_offset] if lines is not None and s.lineno == s.end_lineno and not getattr(s, "decorator_list", None) else None
    got = _LINES.get(text) if text is not None else None
    if got is not None:
        return got
    if isinstance(s, (*Def, ast.ClassDef, ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)):
        head = copy.copy(s)
        head.body = [ast.Pass()]  # what stands below is not on the line
        if hasattr(s, "orelse"):
            head.orelse = []
    else:
        head = s
    got = ast.unparse(head).split("\n")[0]
    if text is not None and len(text) <= 1_000:
        if len(_LINES) >= 65_536:
            _LINES.clear()
        _LINES[text] = got
    return got


def names(e: ast.AST | None) -> frozenset[str]:
    """The names that an expression reads (kept at the node)."""
    if e is None:
        return frozenset()
    got = getattr(e, "_names", None)
    if got is None:
        got = e._names = frozenset(n.id for n in walked(e) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load))
    return got


def calls_in(e: ast.AST) -> tuple[ast.Call, ...]:
    """The calls under an expression (kept at the node)."""
    got = getattr(e, "_calls", None)
    if got is None:
        got = e._calls = tuple(n for n in walked(e) if isinstance(n, ast.Call))
    return got


#: The fields that hold statements, handlers or cases, by class of node.
_BODIES = {k: tuple(f for f in k._fields if f in ("body", "handlers", "orelse", "finalbody", "cases")) for k in (ast.Module, ast.ExceptHandler, ast.match_case, *ast.stmt.__subclasses__())}


def statements(top: ast.AST, inner: bool = True) -> list[ast.AST]:
    """The statements under a statement or module, with handlers and cases, as ast.walk orders them; expressions are not entered. inner: also those of functions and classes inside."""
    out = [top]
    for n in out:
        if inner or n is top or not isinstance(n, (*Def, ast.ClassDef)):
            for f in _BODIES[type(n)]:
                out += getattr(n, f)
    return out


def dotted(e: ast.AST) -> str:
    if isinstance(e, ast.Name):
        return e.id
    if not isinstance(e, ast.Attribute):
        return ""
    got = getattr(e, "_dotted", None)
    if got is None:
        parts, x = [], e
        while isinstance(x, ast.Attribute):
            parts.append(x.attr)
            x = x.value
        if isinstance(x, ast.Name):
            parts.append(x.id)
        got = e._dotted = ".".join(reversed(parts))
    return got


def own(s: ast.AST) -> tuple[ast.AST, ...]:
    """The nodes of a statement or expression but for the bodies of functions and classes inside (kept at the node: trees are not changed)."""
    got = getattr(s, "_own", None)
    if got is None:
        work, out = [s], []
        while work:
            n = work.pop()
            out.append(n)
            if n is s or not isinstance(n, (*Def, ast.ClassDef)):
                work += ast.iter_child_nodes(n)
        got = s._own = tuple(out)
    return got


def own_calls(s: ast.AST) -> tuple[ast.Call, ...]:
    """The calls among a statement's own nodes."""
    got = getattr(s, "_own_calls", None)
    if got is None:
        got = s._own_calls = tuple(n for n in own(s) if isinstance(n, ast.Call))
    return got


def own_names(s: ast.AST) -> frozenset[str]:
    """The names among a statement's own nodes."""
    got = getattr(s, "_own_names", None)
    if got is None:
        got = s._own_names = frozenset(n.id for n in own(s) if isinstance(n, ast.Name))
    return got


def all_args(f: ast.AST) -> list[str]:
    a = f.args
    return [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *(v for v in (a.vararg, a.kwarg) if v is not None))]


def captures(pattern: ast.AST) -> set[str]:
    """Names that a case pattern binds."""
    return {x for n in ast.walk(pattern) for x in (getattr(n, "name", None), getattr(n, "rest", None)) if isinstance(x, str)}


def targets(e: ast.AST) -> tuple[set[str], bool]:
    """Names that an assignment target writes, and whether it replaces them (an element or attribute does not)."""
    if isinstance(e, ast.Name):
        return {e.id}, True
    if isinstance(e, (ast.Tuple, ast.List)):
        got = [targets(x) for x in e.elts]
        return set().union(*(w for w, _ in got)) if got else set(), all(k for _, k in got)
    if isinstance(e, ast.Starred):
        return targets(e.value)
    while isinstance(e, (ast.Attribute, ast.Subscript)):
        e = e.value
    return {n.id for n in ast.walk(e) if isinstance(n, ast.Name)}, False


def keys(e: ast.AST) -> list[ast.AST]:
    """Expressions inside an assignment target that are not written: indexes."""
    return [] if isinstance(e, ast.Name) else [n.slice for n in ast.walk(e) if isinstance(n, ast.Subscript)]


def pairs(target: ast.AST, value: ast.AST) -> list[tuple[ast.AST, ast.AST]]:
    """Targets with their values, element by element where both are written out."""
    if isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, (ast.Tuple, ast.List)) and len(target.elts) == len(value.elts) and not any(isinstance(x, ast.Starred) for x in (*target.elts, *value.elts)):
        return [p for t, v in zip(target.elts, value.elts, strict=True) for p in pairs(t, v)]
    return [(target, value)]


def imported(tree: ast.AST) -> dict[str, set[str]]:
    """Local names with the full names they may stand for, by imports anywhere and plain assignments of other names."""
    out: dict[str, set[str]] = {}
    every = [n for n in statements(tree) if isinstance(n, (ast.Import, ast.ImportFrom, ast.Assign))]
    for n in every:
        if isinstance(n, ast.Import):
            for a in n.names:
                out.setdefault(a.asname or a.name.split(".")[0], set()).add(a.name if a.asname else a.name.split(".")[0])
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                out.setdefault(a.asname or a.name, set()).add(f"{'.' * n.level}{n.module or ''}{'.' if n.module else ''}{a.name}")
    for n in every:
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and isinstance(n.value, (ast.Name, ast.Attribute)) and (full := dotted(n.value)):
            head, _, rest = full.partition(".")
            for h in out.get(head, ()) if head != n.targets[0].id else ():
                out.setdefault(n.targets[0].id, set()).add(f"{h}.{rest}" if rest else h)
    return out


class Flow:
    """Nodes, control edges, data edges and functions of a module. Code that control cannot reach gets no node.

    tests: outcomes of tests that are known, by line and column; the other side of such a branch cannot be reached.
    branches: for each node that branches the numbers of the nodes of its body (first, after) and of what stands for else.
    """

    def __init__(self, text: str, tests: dict[tuple[int, int], bool] | None = None):
        self.tests = tests or {}
        self.branches: dict[int, tuple[int, int, int]] = {}
        self.nodes: list[Node] = []
        self.cfg: list[tuple[int, int, str]] = []
        self.functions: list[Function] = []
        self.exits: dict[int, list[int]] = {}  # of each function (-1: the module) the nodes after which it ends
        self._loops: list[tuple[list[int], int]] = []
        self._function = -1
        self._in_class = False
        tree = ast.parse(text)
        self._lines = text.split("\n") if text.isascii() and "\r" not in text and "\f" not in text else None
        self.aliases = imported(tree)
        ends = self._block(tree.body, [self._node("entry", tree, "<module>", 0)], "<module>")
        self.by_name: dict[str, list[Function]] = {}
        for f in self.functions:
            self.by_name.setdefault(f.name, []).append(f)
        self.exits[-1] = ends
        self._closures()
        self.next: dict[int, list[int]] = {}
        self.prev: dict[int, list[int]] = {}
        for a, b in dict.fromkeys((a, b) for a, b, _ in self.cfg):
            self.next.setdefault(a, []).append(b)
            self.prev.setdefault(b, []).append(a)
        for f in self.functions:
            f.flow = self

    # --- control

    def _node(self, kind: str, at: ast.AST, scope: str, line: int | None = None, moves: Iterable[Move] = (), looks: Iterable[ast.AST | None] = (), text: str = "") -> int:
        n = Node(len(self.nodes), kind, line if line is not None else at.lineno, scope, text, self._function, list(moves), [e for e in looks if e is not None], end=getattr(at, "end_lineno", None) or 0)
        for e in n.looks:
            for c in walked(e):
                if isinstance(c, ast.NamedExpr):  # may not come to be evaluated
                    n.moves.append(Move({c.target.id}, [c.value], True))
        n.reads = set().union(*map(names, n.looks), *(names(v) for m in n.moves for v in m.values), *(m.writes for m in n.moves if m.keeps))
        self.nodes.append(n)
        return n.id

    def _link(self, preds: list[int], to: int, label: str = "next") -> list[int]:
        self.cfg += [(p, to, label) for p in preds]
        return [to]

    def _block(self, body: list[ast.stmt], preds: list[int], scope: str) -> list[int]:
        for s in body:
            if not preds:
                break
            preds = self._statement(s, preds, scope)
        return preds

    def _define(self, s: ast.AST, preds: list[int], scope: str, text: str) -> list[int]:
        a = s.args
        plain = [x.arg for x in [*a.posonlyargs, *a.args]]
        given = [*zip(plain[len(plain) - len(a.defaults) :], a.defaults, strict=True), *((x.arg, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None)]
        outer, self._function = self._function, len(self.functions)
        entry = self._node("parameters", s, s.name, moves=[Move({n}, [d for p, d in given if p == n]) for n in all_args(s)], text=text)
        method = self._in_class and bool(plain) and not any(dotted(d) == "staticmethod" for d in s.decorator_list)
        f = Function(self._function, s.name, s.lineno, [*plain, *(x.arg for x in a.kwonlyargs)], entry, outer, method, a.vararg.arg if a.vararg else None, a.kwarg.arg if a.kwarg else None)
        self.functions.append(f)
        self._link(preds, entry, "closure")  # names from around it are read as they were where it was defined
        held, self._loops, self._in_class = (self._loops, self._in_class), [], False
        ends = self._block(s.body, [entry], s.name)
        self._loops, self._in_class = held
        mine = [n.id for n in self.nodes[entry:] if n.function == f.id]
        f.returns = [i for i in mine if self.nodes[i].kind == "return"]
        f.end = len(self.nodes)
        f.shared = {x for n in statements(s, inner=False) if isinstance(n, (ast.Global, ast.Nonlocal)) for x in n.names}
        self.exits[f.id] = [*ends, *f.returns]
        self._function = outer
        return self._link(preds, self._node("function", s, scope, moves=[Move({s.name}, [])], looks=[*a.defaults, *a.kw_defaults, *s.decorator_list], text=text))

    def _statement(self, s: ast.stmt, preds: list[int], scope: str) -> list[int]:
        text = first_line(s, self._lines)
        if isinstance(s, Def):
            return self._define(s, preds, scope, text)
        if isinstance(s, ast.Assign):
            moves = []
            for t, v in (p for t in s.targets for p in pairs(t, s.value)):
                written, kills = targets(t)
                moves.append(Move(written, [v, *keys(t)], not kills))
            # every value is read before any name is written, so names that two parts write and read stand as they were
            return self._link(preds, self._node("assign", s, scope, moves=moves, looks=[s.value, *(k for t in s.targets for k in keys(t))], text=text))
        if isinstance(s, (ast.AnnAssign, ast.AugAssign)):
            kind = "annassign" if isinstance(s, ast.AnnAssign) else "augassign"
            if s.value is None:  # an annotation alone writes nothing
                return self._link(preds, self._node(kind, s, scope, text=text))
            written, kills = targets(s.target)
            values = [s.value, *keys(s.target)] + ([ast.copy_location(ast.Name(n, ast.Load()), s) for n in sorted(written)] if isinstance(s, ast.AugAssign) else [])
            return self._link(preds, self._node(kind, s, scope, moves=[Move(written, values, not kills)], looks=[s.value, *keys(s.target)], text=text))
        if isinstance(s, ast.Expr):
            call, moves = s.value, []
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in MUTATORS:
                moves = [Move(targets(call.func.value)[0], [*call.args, *(k.value for k in call.keywords)], True)]
            return self._link(preds, self._node("call" if isinstance(call, ast.Call) else "expr", s, scope, moves=moves, looks=[call], text=text))
        if isinstance(s, (ast.Return, ast.Raise)):
            looks = [s.value] if isinstance(s, ast.Return) else [s.exc, s.cause]
            self._link(preds, self._node("return" if isinstance(s, ast.Return) else "raise", s, scope, looks=looks, text=text))
            return []
        if isinstance(s, (ast.Break, ast.Continue)):
            at = self._node("break" if isinstance(s, ast.Break) else "continue", s, scope, text=text)
            self._link(preds, at)
            if self._loops:
                breaks, head = self._loops[-1]
                if isinstance(s, ast.Break):
                    breaks.append(at)
                else:
                    self._link([at], head, "back")
            return []
        if isinstance(s, ast.If):
            at = self._link(preds, self._node("if", s, scope, looks=[s.test], text=text))
            known, first = self.tests.get((s.test.lineno, s.test.col_offset)), len(self.nodes)
            out = self._block(s.body, at, scope) if known is not False else []
            middle = len(self.nodes)
            if known is not True:
                out = out + (self._block(s.orelse, at, scope) if s.orelse else at)
            self.branches[at[0]] = (first, middle, len(self.nodes))
            return out
        if isinstance(s, ast.ClassDef):
            at = self._link(preds, self._node("class", s, scope, moves=[Move({s.name}, [])], looks=[*s.bases, *s.decorator_list], text=text))
            held, self._in_class = self._in_class, True
            out = self._block(s.body, at, scope)
            self._in_class = held
            return out
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            loop = isinstance(s, ast.While)
            moves = [] if loop else [Move(targets(s.target)[0], [s.iter], True)]
            head = self._node("while" if loop else "for", s, scope, moves=moves, looks=[s.test if loop else s.iter], text=text)
            self._link(preds, head)
            breaks: list[int] = []
            self._loops.append((breaks, head))
            first = len(self.nodes)
            if not (loop and self.tests.get((s.test.lineno, s.test.col_offset)) is False):
                self._link(self._block(s.body, [head], scope), head, "back")
            self.branches[head] = (first, len(self.nodes), len(self.nodes))
            self._loops.pop()
            endless = loop and isinstance(s.test, ast.Constant) and bool(s.test.value)
            done = [] if endless else self._block(s.orelse, [head], scope) if s.orelse else [head]
            return done + breaks
        if isinstance(s, (ast.Try, ast.TryStar)):
            return self._try(s, preds, scope)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            moves = [Move(w, [i.context_expr], not k) for i in s.items if i.optional_vars is not None for w, k in [targets(i.optional_vars)]]
            return self._block(s.body, self._link(preds, self._node("with", s, scope, moves=moves, looks=[i.context_expr for i in s.items], text=text)), scope)
        if isinstance(s, ast.Match):
            at = self._link(preds, self._node("match", s, scope, looks=[s.subject], text=text))
            out = list(at)
            for c in s.cases:
                first = len(self.nodes) + 1
                case = self._link(at, self._node("case", c.pattern, scope, moves=[Move(captures(c.pattern), [s.subject], True)], looks=[c.guard], text=f"{ast.unparse(s.subject)}: {ast.unparse(c.pattern)}"))
                out += self._block(c.body, case, scope)
                self.branches[case[0]] = (first, len(self.nodes), len(self.nodes))
            return out
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            return self._link(preds, self._node("statement", s, scope, moves=[Move({(a.asname or a.name).split(".")[0] for a in s.names}, [])], text=text))
        gone = {n.id for n in ast.walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Del)}
        return self._link(preds, self._node("statement", s, scope, moves=[Move(gone, [])] if gone else [], looks=[x for x in ast.iter_child_nodes(s) if isinstance(x, ast.expr)], text=text))

    def _try(self, s: ast.AST, preds: list[int], scope: str) -> list[int]:
        """A handler or a final block may begin after any node of what it guards. The final block is laid out twice, for those who fall through and for those who leave (unless it holds another try), so that neither sees the other's names."""
        at = self._link(preds, self._node("try", s, scope, text="try"))
        first, mine = len(self.nodes), self._function
        inside = lambda: [n.id for n in self.nodes[first:] if n.function == mine]
        ok = self._block(s.body, at, scope)
        body = at + inside()
        if s.orelse:
            ok = self._block(s.orelse, ok, scope)
        for h in s.handlers:
            caught = self._link(body, self._node("except", h, scope, moves=[Move({h.name}, [])] if h.name else [], looks=[h.type], text="except"))
            ok = ok + self._block(h.body, caught, scope)
        if not s.finalbody:
            return ok
        left = at + inside()
        if ok and not any(isinstance(n, (ast.Try, ast.TryStar, *Def, ast.ClassDef)) for x in s.finalbody for n in own(x)):
            self._block(s.finalbody, left, scope)
            return self._block(s.finalbody, ok, scope)
        ends = self._block(s.finalbody, ok + left, scope)
        return ends if ok else []

    def _closures(self) -> None:
        """A function reads names from around it also as they are where it is called there, and at the end of what is around it."""
        preds: dict[int, list[int]] = {}
        for a, b, _ in self.cfg:
            preds.setdefault(b, []).append(a)
        called: dict[tuple[int, str], list[int]] = {}
        for n in self.nodes:
            for e in n.looks:
                for c in calls_in(e):
                    if isinstance(c.func, ast.Name):
                        called.setdefault((n.function, c.func.id), []).append(n.id)
        for f in self.functions:
            before = [p for i in called.get((f.scope, f.name), []) for p in preds.get(i, [])]
            self._link(list(dict.fromkeys([*before, *self.exits.get(f.scope, [])])), f.entry, "closure")

    # --- data: worked out when it is asked for, as many callers need control alone

    @cached_property
    def summary(self) -> Taint:
        """What gets through the functions, without sources, sinks and sanitizers."""
        return Taint(self, every=True)

    @cached_property
    def calls(self) -> dict[int, list[ast.Call]]:
        """The calls of each node."""
        out: dict[int, list[ast.Call]] = {}
        for n in self.nodes:
            if found := [c for e in n.looks for c in calls_in(e)]:
                out[n.id] = found
        return out

    @cached_property
    def flows(self) -> dict[tuple[int, str], list[int]]:
        """(definition, name) to its readers. Definitions are nodes, or merges, numbered after the nodes."""
        flows: dict[tuple[int, str], list[int]] = {}
        self.merges = 0
        size = len(self.nodes)
        block, last, chains = [-1] * size, [], []
        for n in self.nodes:
            p = self.prev.get(n.id, [])
            if len(p) != 1 or len(self.next[p[0]]) != 1:
                chain, i = [], n.id
                while True:
                    chain.append(i)
                    block[i] = len(chains)
                    follow = self.next.get(i, [])
                    if len(follow) != 1 or len(self.prev[follow[0]]) != 1 or block[follow[0]] >= 0:
                        break
                    i = follow[0]
                chains.append(chain)
        heads = {c[0]: b for b, c in enumerate(chains)}
        after = [[heads[x] for x in dict.fromkeys(self.next.get(c[-1], []))] for c in chains]
        wanted: set[str] = set()
        for chain in chains:
            local: set[str] = set()
            for i in chain:
                wanted |= self.nodes[i].reads - local
                local |= self.nodes[i].writes
            last.append(local)
        up = dominators(0, after)
        edge = frontiers(up, after)
        homes: dict[str, list[int]] = {}
        for b, local in enumerate(last):
            for v in local & wanted:
                homes.setdefault(v, []).append(b)
        merges: list[dict[str, int]] = [{} for _ in chains]
        for v, work in homes.items():  # a merge where ways from different definitions meet
            work = list(work)
            while work:
                for m in edge[work.pop()]:
                    if v not in merges[m]:
                        merges[m][v] = size + self.merges
                        self.merges += 1
                        work.append(m)
        below: list[list[int]] = [[] for _ in chains]
        for b, d in enumerate(up):
            if d >= 0 and d != b:
                below[d].append(b)
        held: dict[str, list[int]] = {}
        walk = [(0, True)]
        while walk:  # down the dominators, each block with the definitions that hold where it begins
            b, enter = walk.pop()
            writes = [*merges[b], *(v for i in chains[b] for v in self.nodes[i].writes)]
            if not enter:
                for v in writes:
                    held[v].pop()
                continue
            for v, m in merges[b].items():
                held.setdefault(v, []).append(m)
            for i in chains[b]:
                n = self.nodes[i]
                for v in sorted(n.reads):
                    if held.get(v):
                        flows.setdefault((held[v][-1], v), []).append(i)
                for v in n.writes:
                    held.setdefault(v, []).append(i)
            for m in after[b]:
                for v, x in merges[m].items():
                    if held.get(v) and held[v][-1] != x:
                        flows.setdefault((held[v][-1], v), []).append(x)
            walk.append((b, False))
            walk += [(c, True) for c in below[b]]
        for f in self.functions:  # what a function writes into other scopes is read there at any time
            for v in f.shared:
                outside = [n.id for n in self.nodes if v in n.reads and n.function != f.id]
                for n in self.nodes[f.entry : f.end]:
                    if n.function == f.id and v in n.writes:
                        flows.setdefault((n.id, v), []).extend(outside)
        return flows

    @property
    def dfg(self) -> list[tuple[int, int, str]]:
        """(definition, reader, name) for every definition that reaches a reader."""
        out = []
        for d, v in self.flows:
            if d < len(self.nodes):
                seen, work = {d}, [d]
                while work:
                    for x in self.flows.get((work.pop(), v), ()):
                        if x not in seen or x == d:
                            if x < len(self.nodes):
                                out.append((d, x, v))
                            elif x not in seen:
                                work.append(x)
                            seen.add(x)
        return sorted(set(out), key=lambda e: (e[1], e[2], e[0]))

    def trace(self, sources: Iterable[str], sinks: Iterable[str], sanitizers: dict[str, int] | Iterable[str] = ()) -> list[tuple[int, int, int, bool]]:
        return Taint(self, sources, sinks, sanitizers).trace()

    # --- names

    def full(self, callee: str) -> set[str]:
        """What a dotted name may stand for."""
        head, _, rest = callee.partition(".")
        return {callee} | {f"{h}.{rest}" if rest else h for h in self.aliases.get(head, ())}

    def local(self, call: ast.Call) -> tuple[list[Function], bool, bool]:
        """Functions of this file that a call may run; whether it is by bare name; whether it can be no other function."""
        if isinstance(call.func, ast.Name):
            return ([] if call.func.id in self.aliases else self.by_name.get(call.func.id, [])), True, True
        if isinstance(call.func, ast.Attribute) and dotted(call.func).split(".")[0] not in self.aliases:
            mine = isinstance(call.func.value, ast.Name) and call.func.value.id in ("self", "cls")
            return [f for f in self.by_name.get(call.func.attr, []) if f.method], False, mine
        return [], False, False


@lru_cache(65_536)
def holds(text: str, wanted: tuple[str, ...]) -> bool:
    """Whether any wanted text stands in a text; kept across files, whose lines repeat."""
    return any(s in text for s in wanted)


@lru_cache(65_536)
def _match(callee: str, wanted: tuple[str, ...]) -> str | None:
    return next((s for s in wanted if callee == s or s.startswith(".") and callee.endswith(s) or callee.endswith("." + s)), None)


def matches(callee: str, wanted: Iterable[str]) -> str | None:
    """The first wanted name that a dotted callee is: equal to it, or ending with it (after a dot)."""
    return (_match if len(callee) <= 1_000 else _match.__wrapped__)(callee, tuple(wanted))


def places(call: ast.Call) -> Iterator[tuple[ast.AST, str]]:
    """Arguments with their places: a position, a keyword, or * where it may be any."""
    loose = False
    for i, a in enumerate(call.args):
        loose = loose or isinstance(a, ast.Starred)
        yield a, "*" if loose else str(i)
    for k in call.keywords:
        yield k.value, k.arg or "*"


class Taint:
    """The flow of marked values through a file.

    Facts are (definition, name, origin, clean, function): the name holds there what came from the origin, cleaned by the
    sanitizers whose bits are set. function: into whose parameter it was last handed (its result is handed on by the
    summary, that of any other value by all calls). sanitizers: name to bits; a plain name list cleans bit 1. every: also
    functions that nothing in the file calls get a summary, which only those who ask for it itself need.
    """

    def __init__(self, flow: Flow, sources: Iterable[str] = (), sinks: Iterable[str] = (), sanitizers: dict[str, int] | Iterable[str] = (), every: bool = False):
        self.flow, self.sources, self.sinks = flow, tuple(sources), tuple(sinks)
        self.sanitizers = dict(sanitizers) if isinstance(sanitizers, dict) else dict.fromkeys(sanitizers, 1)
        self.through: list[dict[str, set[int]]] = [{} for _ in flow.functions]  # of each function: parameters that reach its result, and the bits they are cleaned by
        self._callee: dict[int, tuple] = {}
        self._cache: dict[int, tuple] = {}
        self.visited: dict[object, set[int]] | None = None  # of each origin the nodes that its facts are at, where asked for
        self.callers: dict[str, list[int]] = {}
        self.calls = flow.calls
        for i, calls in self.calls.items():
            for c in calls:
                for f in self.callee(c)[1][0]:
                    self.callers.setdefault(f"{f.id}()", []).append(i)
                if not self.callee(c)[1][0] and dotted(c.func):
                    self.callers.setdefault(f"={dotted(c.func)}", []).append(i)
        self._summaries({f.id for f in flow.functions if f.returns and (every or f"{f.id}()" in self.callers)})

    def callee(self, c: ast.Call) -> tuple:
        """(bits of the sanitizer it is, or 0; its local functions)."""
        got = self._callee.get(id(c))
        if got is None:
            full = self.flow.full(dotted(c.func)) if dotted(c.func) else set()
            bits = next((self.sanitizers[m] for x in sorted(full) if (m := matches(x, self.sanitizers))), 0)
            got = self._callee[id(c)] = (bits, self.flow.local(c))
        return got

    def _summaries(self, of: set[int]) -> None:
        todo = deque(f for f in self.flow.functions if f.id in of)
        waiting = {f.id for f in todo}
        while todo:
            f = todo.popleft()
            waiting.discard(f.id)
            before = {p: set(b) for p, b in self.through[f.id].items()}
            for _, name, origin, clean, _ in self._run([(f.entry, p, p, 0, f.id) for p in (*f.params, *(x for x in (f.star, f.stars) if x))], inside=f.id):
                if name == "return":
                    self.through[f.id].setdefault(origin, set()).add(clean)
            if self.through[f.id] != before:
                self._forget(f)
                for i in self.callers.get(f"{f.id}()", ()):
                    g = self.flow.nodes[i].function
                    if g in of and g not in waiting:
                        waiting.add(g)
                        todo.append(self.flow.functions[g])

    def _forget(self, f: Function) -> None:
        """Drops what was worked out with the summary of f: of nodes that call it, and of those whose values are not among what they look at."""
        calling = set(self.callers.get(f"{f.id}()", ()))
        self._cache = {i: x for i, x in self._cache.items() if i not in calling and self.flow.nodes[i].kind not in ("case", "parameters")}

    def parts(self, e: ast.AST, clean: int, hot: bool) -> Iterator[tuple[str | None, int]]:
        """What an expression's value is made of: names (None: a source), each with the bits it is cleaned by. hot: whether the statement holds a source."""
        if isinstance(e, ast.Name):
            yield e.id, clean
        if not hot and isinstance(e, (ast.Name, ast.Constant)):  # nothing is inside
            return
        if hot and isinstance(e, (ast.Name, ast.Attribute, ast.Subscript, ast.Call)):
            text = ast.unparse(e)
            if any(s in text and not any(s in ast.unparse(x) for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr)) for s in self.sources):
                yield None, clean
        if isinstance(e, ast.Call):
            bits, (functions, bare, sure) = self.callee(e)
            if bits:
                clean |= bits
            elif functions:
                for f in functions:
                    yield f"{f.id}()", clean
                if sure:
                    for f in functions:
                        for a, params in f.bound(e, bare):
                            for more in set().union(*(self.through[f.id].get(p, ()) for p in params)):
                                yield from self.parts(a, clean | more, hot)
                    return
            elif dotted(e.func):
                yield f"={dotted(e.func)}", clean
        known = self.flow.tests.get((e.test.lineno, e.test.col_offset)) if isinstance(e, ast.IfExp) else None
        for x in ast.iter_child_nodes(e) if known is None else [e.body if known else e.orelse]:
            if isinstance(x, (ast.expr, ast.keyword, ast.comprehension)):
                yield from self.parts(x, clean, hot)

    def _hot(self, n: Node) -> bool:
        return holds(n.text, self.sources) if len(n.text) <= 1_000 else any(s in n.text for s in self.sources)

    def _made(self, n: Node) -> tuple:
        """What the node does with what it reads: [(what, clean, name written)], [(what, clean, sink)], [(what, clean, parameter)], [(what, clean)] of its result."""
        got = self._cache.get(n.id)
        if got is None:
            hot = self._hot(n)
            writes = [(w, c, x) for m in n.moves for v in m.values for w, c in set(self.parts(v, 0, hot)) for x in m.writes]
            sinks, params = [], []
            for call in self.calls.get(n.id, ()):
                args = [*call.args, *(k.value for k in call.keywords)]
                if any(matches(x, self.sinks) for x in self.flow.full(dotted(call.func))):
                    sinks += [(w, c, call) for a in args for w, c in set(self.parts(a, 0, hot))]
                functions, bare, _ = self.callee(call)[1]
                for f in functions:
                    for a, into in f.bound(call, bare):
                        params += [(w, c, (f, p)) for w, c in set(self.parts(a, 0, hot)) for p in into]
            result = list(set(self.parts(n.looks[0], 0, hot))) if n.kind == "return" and n.looks else []
            args = [(w, c, (call, place)) for call in self.calls.get(n.id, ()) if not self.callee(call)[0] for a, place in places(call) for w, c in set(self.parts(a, 0, hot))]
            got = self._cache[n.id] = (writes, sinks, params, result, args)
        return got

    def _run(self, start: list[tuple], inside: int | None = None, ports: bool = False) -> Iterator[tuple]:
        """Facts that follow from the start's: (node, name, origin, clean, steps), name being 'return' for results and 'sink' for sinks; the fewest steps first. inside: only that function, calls taken by their summaries. ports: values end at calls (name: the call and the argument's place), sinks (the call) and results."""
        flow, size = self.flow, len(self.flow.nodes)
        best: dict[tuple, int] = {}
        work: deque[tuple[tuple, int]] = deque()

        def put(fact: tuple, steps: int, near: bool) -> None:
            if steps < best.get(fact, steps + 1):
                best[fact] = steps
                if self.visited is not None:
                    self.visited.setdefault(fact[2], set()).add(fact[0])
                (work.appendleft if near else work.append)((fact, steps))

        for fact in start:
            put(fact, 1, False)
        told: set[tuple] = set()
        while work:
            fact, steps = work.popleft()
            if best[fact] < steps:
                continue
            d, name, origin, clean, ctx = fact
            for i in self.callers.get(name, ()) if d < 0 else flow.flows.get((d, name), ()):
                if i >= size:  # a merge
                    put((i, name, origin, clean, ctx), steps, True)
                    continue
                n = flow.nodes[i]
                if inside is not None and n.function != inside:
                    continue
                writes, sinks, params, result, args = self._made(n)
                for m in n.moves:
                    if m.keeps and name in m.writes:
                        put((i, name, origin, clean, ctx), steps, True)
                for what, more, x in writes:
                    if what == name:
                        put((i, x, origin, clean | more, ctx), steps + 1, False)
                for what, more, call in sinks:
                    if what == name:
                        yield i, call if ports else "sink", origin, clean | more, steps
                for what, more, port in args if ports else ():
                    if what == name:
                        yield i, port, origin, clean | more, steps
                for what, more in result:
                    if what == name:
                        if inside is not None or ports:
                            yield i, "return", origin, clean | more, steps
                        elif n.function != ctx:
                            put((-1, f"{n.function}()", origin, clean | more, ctx), steps, True)
                            if (n.function, origin, clean | more) not in told:
                                told.add((n.function, origin, clean | more))
                                yield i, "return", origin, clean | more, steps
                if inside is None and not ports:
                    for what, more, (f, p) in params:
                        if what == name:
                            put((f.entry, p, origin, clean | more, f.id), steps + 1, False)

    def seeds(self) -> tuple[list[tuple], list[tuple], list[tuple]]:
        """Facts that sources begin, sinks that are given a source at once, and functions that return one: (node, clean) each."""
        start, direct, given = [], [], []
        for n in self.flow.nodes:
            if self._hot(n):
                writes, sinks, params, result, _ = self._made(n)
                start += [(n.id, x, n.line, c, -2) for what, c, x in writes if what is None]
                start += [(f.entry, p, n.line, c, f.id) for what, c, (f, p) in params if what is None]
                direct += [(n, c) for what, c, _ in sinks if what is None]
                given += [(n, c) for what, c in result if what is None]
        return start, direct, given

    def trace(self) -> list[tuple[int, int, int, bool]]:
        """(source line, sink line, steps, sanitized) of every pair that a flow joins. sanitized: every flow between them is cleaned; steps: the writes of the shortest flow that is not, or where all are of the shortest one."""
        found: dict[tuple[int, int], tuple[bool, int]] = {}

        def put(a: int, b: int, clean: int, steps: int) -> None:
            found[a, b] = min(found.get((a, b), (True, 1 << 60)), (bool(clean), steps))

        start, direct, given = self.seeds()
        for n, c in direct:
            put(n.line, n.line, c, 0)
        start += [(-1, f"{n.function}()", n.line, c, -2) for n, c in given]
        for i, name, origin, clean, steps in self._run(start):
            if name == "sink":
                put(origin, self.flow.nodes[i].line, clean, steps)
        return [(a, b, steps, clean) for (a, b), (clean, steps) in sorted(found.items())]

    def returning(self) -> list[str]:
        """Functions whose result carries a source."""
        start, _, given = self.seeds()
        hit = {n.function for n, _ in given}
        start += [(-1, f"{n.function}()", n.line, c, -2) for n, c in given]
        hit |= {self.flow.nodes[i].function for i, name, *_ in self._run(start) if name == "return"}
        return [f.name for f in self.flow.functions if f.id in hit]

    def ports(self) -> list[tuple[str, str, int, str, int, str, str, str, int]]:
        """What reaches what within the functions: (function, start, its line, start's name, end's line, end, end's name, place, clean).

        start: param, source, or result (of a call: its name); end: sink (which of the sinks), argument (the call's name and
        the argument's place) or return. Calls are not followed: their functions may be in other files. The module's own
        statements are the function <module>. Of several ways the cleaning of each is given.
        """
        flow = self.flow
        label = lambda f: "<module>" if f < 0 else flow.functions[f].name
        start: list[tuple] = []
        out: dict[tuple, None] = {}

        def end(i: int, name, origin: tuple, clean: int) -> None:
            n = flow.nodes[i]
            if name == "return":
                if n.function >= 0 and origin[0] != -2:
                    out[(*origin[1:], n.line, "return", label(n.function), "", clean)] = None
                return
            call, place = name if isinstance(name, tuple) else (name, "")
            sink = None if isinstance(name, tuple) else next(m for x in sorted(flow.full(dotted(call.func))) if (m := matches(x, self.sinks)))
            out[(*origin[1:], call.lineno, "sink" if sink else "argument", sink or dotted(call.func), place, clean)] = None

        for f in flow.functions:
            start += [(f.entry, p, (f.id, f.name, "param", f.line, p), 0, f.id) for p in (*f.params, *(x for x in (f.star, f.stars) if x))]
        for n in flow.nodes:
            if self._hot(n):
                origin = (n.function, label(n.function), "source", n.line, "")
                writes, sinks, _, result, args = self._made(n)
                start += [(n.id, x, origin, c, -2) for what, c, x in writes if what is None]
                for what, c, port in [*sinks, *args]:
                    if what is None:
                        end(n.id, port, origin, c)
                for what, c in result:
                    if what is None:
                        end(n.id, "return", origin, c)
        for name, at in self.callers.items():
            callee = flow.functions[int(name[:-2])].name if name.endswith("()") else name[1:]
            for i in dict.fromkeys(at):
                n = flow.nodes[i]
                origin = (n.function, label(n.function), "result", n.line, callee)
                writes, sinks, _, result, args = self._made(n)
                start += [(i, x, origin, c, -2) for what, c, x in writes if what == name]
                for what, c, port in [*sinks, *args]:
                    if what == name:
                        end(i, port, origin, c)
                for what, c in result:
                    if what == name:
                        end(i, "return", origin, c)
        for i, name, origin, clean, _ in self._run(start, ports=True):
            end(i, name, origin, clean)
        return [(f, kind, line, name, at, what, whom, place, clean) for f, kind, line, name, at, what, whom, place, clean in out]
