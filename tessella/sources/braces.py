"""A structural tree of C++, Java and JavaScript sources: no grammar, but literals, comments, brackets, statements and words with their bytes.

Types are our own: source, block { }, parens ( ), brackets [ ], statement, comment, string, character, number, keyword, name, operator. A closing bracket that doesn't
match, or one left open, makes the whole file an ERROR node, as broken code is.
"""

from __future__ import annotations

import re

# Reserved words of each language.
KEYWORDS = {
    "C++": "alignas auto bool break case catch char class const constexpr continue default delete do double else enum explicit extern false float for friend goto if inline int long namespace new nullptr operator private protected public return short signed sizeof static struct switch template this throw true try typedef typename union unsigned using virtual void volatile while",
    "Java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while",
    "JavaScript": "async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield",
}
# End of fixed values.
_TOKEN = re.compile(
    rb"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?)|(?P<character>'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<open>[{(\[])|(?P<close>[})\]])|(?P<end>;)|(?P<operator>[^\s\w{}()\[\];\"'`]+?)",
    re.S,
)
_KINDS = {b"{": ("block", b"}"), b"(": ("parens", b")"), b"[": ("brackets", b"]")}


def brace_tree(code: str, language: str) -> list[tuple]:
    """(node_id, parent_id, preorder, type, is_named, start_byte, end_byte) in pre-order; SyntaxError for brackets that don't match. A statement runs to its semicolon or to the end of its block."""
    raw, words = code.encode(), {w.encode() for w in KEYWORDS[language].split()}
    out: list[list] = [[0, None, 0, "source", True, 0, len(raw)]]
    open_: list[tuple[int, bytes]] = [(0, b"")]  # nodes that hold what follows: brackets and statements

    def add(kind: str, start: int, end: int, named: bool = True) -> int:
        out.append([len(out), open_[-1][0], len(out), kind, named, start, end])
        return len(out) - 1

    def finish(end: int) -> None:
        if out[open_[-1][0]][3] == "statement":
            out[open_.pop()[0]][6] = end

    last = 0
    for m in _TOKEN.finditer(raw):
        kind, text, start, end = m.lastgroup, m.group(), m.start(), m.end()
        holder = out[open_[-1][0]][3]
        if kind == "close":
            finish(last)
            if len(open_) < 2 or open_[-1][1] != text:
                raise SyntaxError("brackets don't match")
            out[open_.pop()[0]][6] = end
            if text == b"}":  # a block ends the statement it belongs to, unless the statement goes on
                after = raw[end:].lstrip()[:5]
                if not after.startswith((b"else", b"catch", b"while", b"final", b";", b",", b")", b".")):
                    finish(end)
        else:
            if kind not in ("comment", "end") and holder in ("source", "block"):
                open_.append((add("statement", start, end), b""))
            if kind == "open":
                name, close = _KINDS[text]
                open_.append((add(name, start, end), close))
            elif kind == "end":
                finish(end)
            else:
                add("keyword" if text in words else "name" if kind == "word" else kind, start, end, kind != "operator")
        last = end
    finish(last)
    if len(open_) > 1:
        raise SyntaxError("a bracket is left open")
    return [tuple(x) for x in out]
