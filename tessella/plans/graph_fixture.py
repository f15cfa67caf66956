"""A small code property graph that meets every pattern and its near misses, built from nested statements."""

from __future__ import annotations

OP = "<operator>."


class Builder:
    """Collects nodes (schemas.CPG_NODES) and edges (schemas.CPG_EDGES). Statements are tuples:

    ("local", name, line, col) ("=", op, line, left, right) ("call", name, line, *args) ("on", name, line, receiver, *args) ("id", name, line, col)
    ("lit", code, line) ("ctl", kind, line, code, condition, *body) ("ret", line, value); op is the end of an operator's name.
    """

    def __init__(self):
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []

    def node(self, label, name=None, code=None, full=None, method=None, file=None, kind=None, line=None, col=None, ix=None) -> int:
        self.nodes.append((len(self.nodes) + 1, label, name, code, full, method, file, kind, line, col, ix))
        return len(self.nodes)

    def edge(self, src: int, dst: int, kind: str) -> None:
        self.edges.append((len(self.edges) + 1, src, dst, kind))

    def method(self, name: str, file: str, params: list[tuple], *body) -> None:
        m = self.node("METHOD", name, full=f"{file}:{name}", file=file, line=1, col=1)
        scope: dict[str, int] = {}
        for i, (p, line, col) in enumerate(params):
            scope[p] = self.node("METHOD_PARAMETER_IN", p, p, line=line, col=col, ix=i + 1)
            self.edge(m, scope[p], "AST")
        block = self.node("BLOCK", line=1, col=1)
        self.edge(m, block, "AST")
        for s in body:
            self.edge(block, self.make(s, scope), "AST")

    def make(self, s: tuple, scope: dict[str, int], ix: int | None = None) -> int:
        kind = s[0]
        if kind == "local":
            scope[s[1]] = self.node("LOCAL", s[1], s[1], line=s[2], col=s[3])
            return scope[s[1]]
        if kind == "id":
            n = self.node("IDENTIFIER", s[1], s[1], line=s[2], col=s[3], ix=ix)
            self.edge(n, scope[s[1]], "REF")
            return n
        if kind == "lit":
            return self.node("LITERAL", None, s[1], line=s[2], col=40, ix=ix)
        if kind in ("=", "call", "on"):
            name = OP + s[1] if kind == "=" else s[1]
            n = self.node("CALL", name, f"{s[1]}(...)", method=f"lib:{name}", line=s[2], col=1, ix=ix)
            for i, a in enumerate(s[3:]):
                x = self.make(a, scope, i + (kind != "on"))
                self.edge(n, x, "AST")
                self.edge(n, x, "ARGUMENT")
            return n
        if kind == "ret":
            n = self.node("RETURN", None, "return", line=s[1], col=1)
            self.edge(n, self.make(s[2], scope, 1), "AST")
            return n
        _, what, line, code, condition, *body = s
        n = self.node("CONTROL_STRUCTURE", None, code, kind=what, line=line, col=1)
        if condition:
            c = self.make(condition, scope, 1)
            self.edge(n, c, "AST")
            self.edge(n, c, "CONDITION")
        inner = self.node("BLOCK", line=line, col=2)
        self.edge(n, inner, "AST")
        made = [self.make(b, scope) for b in body]
        for b in made:
            self.edge(inner, b, "AST")
            self.edge(n, b, "CDG")
        return n


def build() -> tuple[list[tuple], list[tuple]]:
    g = Builder()
    i, lit = (lambda n, line, col=9: ("id", n, line, col)), (lambda c, line: ("lit", c, line))
    less = lambda a, b, line: ("=", "lessThan", line, a, b)
    asn = lambda n, v, line, col=1: ("=", "assignment", line, i(n, line, col), v)
    # a fixed value, a mutated one, a parameter of each kind
    g.method("values", "a.cpp", [("p", 1, 12), ("q", 1, 19)], ("local", "x", 2, 5), asn("x", lit("1", 2), 2, 5), ("local", "y", 3, 5), asn("y", lit("1", 3), 3, 5), asn("y", i("x", 4), 4), asn("q", lit("2", 5), 5), ("ret", 6, i("p", 6)))
    # sum gathers, n steps, x = x + 1 does both; k changes by two operators
    loop = ("ctl", "WHILE", 14, "while (n < q && x < 9 && k < 9)", ("=", "logicalAnd", 14, less(i("n", 14), i("q", 14), 14), ("=", "logicalAnd", 14, less(i("x", 14), lit("9", 14), 14), less(i("k", 14), lit("9", 14), 14))),
            ("=", "assignmentPlus", 15, i("sum", 15), i("n", 15)), ("=", "postIncrement", 16, i("n", 16)), asn("x", ("=", "addition", 17, i("x", 17), lit("1", 17)), 17),
            ("=", "postIncrement", 18, i("k", 18)), ("=", "assignmentPlus", 19, i("k", 19), lit("2", 19)), ("=", "assignmentPlus", 20, i("w", 20), lit("2", 20)))
    heads = [("local", v, 10 + j, 5) for j, v in enumerate(("sum", "n", "x"))] + [asn(v, lit("0", 10 + j), 10 + j, 5) for j, v in enumerate(("sum", "n", "x"))]
    g.method("loops", "a.cpp", [("q", 9, 10)], *heads, ("local", "k", 13, 5), asn("k", lit("0", 13), 13, 5), ("local", "w", 13, 9), asn("w", lit("0", 13), 13, 9), loop)
    # only the update assigns it, so it gathers nothing; a DO loop does neither
    g.method("near", "a.cpp", [], ("local", "z", 24, 5), ("ctl", "FOR", 25, "for (;z < 3;)", less(i("z", 25), lit("3", 25), 25), asn("z", ("=", "addition", 26, i("z", 26), lit("1", 26)), 26)),
             ("local", "u", 27, 5), asn("u", lit("0", 27), 27, 5), ("ctl", "DO", 28, "do", less(i("u", 30), lit("3", 30), 30), ("=", "assignmentPlus", 29, i("u", 29), i("z", 29)), ("=", "postIncrement", 29, i("u", 29))))
    # walkers by index and by call, holders of the last and of the best value
    walk = ("ctl", "FOR", 38, "for (j; it)", ("=", "logicalAnd", 38, less(i("j", 38), lit("9", 38), 38), ("on", "hasNext", 38, i("it", 38))),
            asn("last", ("=", "indirectIndexAccess", 39, i("a", 39), i("j", 39)), 39), ("on", "next", 40, i("it", 40)), asn("own", ("=", "addition", 41, i("own", 41), i("j", 41)), 41),
            ("ctl", "IF", 42, "if (best < last) best = last;", less(i("best", 42), i("last", 42), 42), asn("best", i("last", 43), 43)), asn("five", lit("5", 44), 44), asn("got", ("call", "read", 45, lit("0", 45)), 45))
    names = ("j", "it", "last", "own", "best", "five", "got")
    g.method("walks", "b.cpp", [("a", 31, 10)], *[("local", v, 32, 5 + 4 * k) for k, v in enumerate(names)], asn("best", lit("0", 36), 36), walk)
    flags = [("local", v, 50, 5 + 4 * k) for k, v in enumerate(("f", "h", "t", "mixed"))]
    # f stays up; h comes down again; t goes the other way; mixed is set back by another literal of the same sense
    g.method("flags", "b.cpp", [], *flags, asn("f", lit("false", 51), 51), asn("f", lit("true", 52), 52), asn("h", lit("false", 53), 53), asn("h", lit("true", 54), 54), asn("h", lit("false", 55), 55),
             asn("t", lit("1", 56), 56), asn("t", lit("0", 57), 57), asn("mixed", lit("false", 58), 58), asn("mixed", lit("true", 59), 59), asn("mixed", lit("0", 60), 60))
    # sorted, sorted and pushed to, pushed to, only an argument of a push
    g.method("boxes", "b.cpp", [("s", 61, 9)], ("local", "v", 62, 5), ("local", "w", 63, 5), ("local", "e", 64, 5), ("call", "std::sort", 65, ("on", "begin", 65, i("s", 65))), ("call", "sort", 66, i("v", 66)), ("on", "push_back", 67, i("v", 67), i("e", 67)), ("on", "append", 68, i("w", 68), lit("1", 68)))
    # swap by a third; a follower whose leader moves on; a dependent; recursion; a branch on a parameter
    g.method("swap", "c.cpp", [("a", 70, 9), ("b", 70, 16)], ("local", "tmp", 71, 5), asn("tmp", i("a", 72), 72), asn("a", i("b", 73), 73), asn("b", i("tmp", 74), 74),
             ("local", "fol", 75, 5), asn("fol", i("a", 76), 76), asn("a", lit("3", 77), 77), ("local", "dep", 78, 5), asn("dep", ("=", "addition", 78, i("b", 78), lit("1", 78)), 78, 5), ("call", "swap", 79, i("dep", 79), i("b", 79)),
             ("ctl", "IF", 80, "if (b) { } else if (a) { } else { }", i("b", 80), asn("tmp", lit("1", 81), 81), asn("fol", lit("1", 82), 82)), ("ctl", "IF", 83, "if (a) { } else { }", i("a", 83), asn("tmp", lit("2", 83), 83)),
             ("ctl", "IF", 84, "if (a) { elsewhere(); }", i("a", 84)), ("ctl", "IF", 85, None, i("a", 85)), ("ctl", "SWITCH", 86, "switch (a)", i("a", 86), asn("tmp", lit("4", 87), 87)))
    g.method("hidden", "<empty>", [("p", 90, 9)], ("local", "x", 91, 5), asn("x", i("p", 91), 91, 5), ("ctl", "FOR", 92, "for (;;)", None))
    g.method("lost", "gone.cpp", [("p", 95, 9)], ("ret", 96, i("p", 96)))
    # both arms of the first IF of swap lead to its last line
    first_if = next(n for n in g.nodes if n[1] == "CONTROL_STRUCTURE" and n[8] == 80)[0]
    arms = [e[2] for e in g.edges if e[1] == first_if and e[3] == "CDG"]
    after = next(n for n in g.nodes if n[1] == "CONTROL_STRUCTURE" and n[8] == 86)[0]
    for a in arms:
        g.edge(a, after, "POST_DOMINATE")
    one = next(n for n in g.nodes if n[1] == "CONTROL_STRUCTURE" and n[8] == 83)[0]
    g.edge(next(e[2] for e in g.edges if e[1] == one and e[3] == "CDG"), after, "POST_DOMINATE")
    return g.nodes, g.edges


def sources(nodes: list[tuple]) -> list[tuple[str, str, str]]:
    """(path, language, code) of files in which every named node stands on its line (two of them without some lines)."""
    text: dict[str, dict[int, str]] = {}
    owner, out = {}, []
    for n in nodes:
        if n[1] == "METHOD":
            owner = {"file": n[6]}
        if owner["file"] not in ("<empty>", "gone.cpp") and n[8]:
            line = text.setdefault(owner["file"], {})
            word = n[3] if n[1] == "CONTROL_STRUCTURE" else n[2]
            if word and not word.startswith(OP):
                line[n[8]] = f"{line.get(n[8], '')} {word}"
    for file, lines in text.items():
        out.append((file, "C++", "\r\n".join(lines.get(k, "") for k in range(1, max(lines) + 1))))
    return out
