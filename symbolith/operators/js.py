"""JavaScript and TypeScript without a grammar: a tokenizer and a walk over its tokens.

The tokenizer knows strings, templates, comments and regular expressions; the walk knows
brackets. That is enough to tell declarations from uses. Divergences from a full parser: type
annotations with arrow types in parameter lists are skipped by bracket depth, and generated
or minified code may give fewer names. Text that can't be balanced falls back to line rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from .rules import MEMBER_EXPORT

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<id>[A-Za-z_$][\w$]*|\#[A-Za-z_$][\w$]*)"""
    r"""|(?P<num>\d[\w.]*)|(?P<op>=>|===?|!==?|<=|>=|\.\.\.|\?\.|&&|\|\||\?\?|[{}()\[\];,.:?=<>+\-*/%!&|^~@])""",
    re.S | re.A,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.A)
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    at: int


class Unbalanced(ValueError):
    pass


def tokens(code: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, 1
    while at < len(code):
        m = None
        if code[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX) and code[at : at + 2] not in ("//", "/*"):
            m = _REGEX.match(code, at)
            kind = "regex"
        if m is None:
            m = _TOKEN.match(code, at)
            kind = m.lastgroup if m else ""
        if m is None:
            raise Unbalanced(f"unexpected {code[at]!r} in line {line}")
        if kind != "space":
            out.append(Token(kind, m[0], line, at))
        line += m[0].count("\n")
        at = m.end()
    return out


def _partners(ts: list[Token]) -> dict[int, int]:
    """Index of the closing bracket of each opening one."""
    stack, out = [], {}
    for i, t in enumerate(ts):
        if t.kind == "op" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "op" and t.text in _CLOSE:
            if not stack or ts[stack[-1]].text != _CLOSE[t.text]:
                raise Unbalanced(f"bracket in line {t.line}")
            out[stack.pop()] = i
    if stack:
        raise Unbalanced("bracket at the end")
    return out


class Found(NamedTuple):
    category: str
    name: str
    line: int
    stage: int  # order of categories of definitions within a file
    at: int = 0
    end: int = 0
    owner: str = ""
    signature: str = ""  # if it isn't what stands from ``at`` to ``end``


def _pattern_names(ts: list[Token], a: int, z: int) -> Iterator[Token]:
    """Names bound by a destructuring pattern between two brackets."""
    depth = 0
    for i in range(a + 1, z):
        t, nxt, prev = ts[i], ts[i + 1], ts[i - 1]
        depth += (t.text in _OPEN) - (t.text in _CLOSE)
        if t.kind == "id" and nxt.text != ":" and prev.text in ("{", "[", ",", ":", "..."):
            yield t


def _declarators(ts: list[Token], pair: dict[int, int], i: int) -> Iterator[tuple[list[Token], bool, tuple[int, int] | None]]:
    """Names, whether a function is assigned, and the tokens of its parameters, for each declarator from ``i`` on."""
    while i < len(ts):
        if ts[i].text in ("{", "["):
            names, i = list(_pattern_names(ts, i, pair[i])), pair[i] + 1
        elif ts[i].kind == "id":
            names, i = [ts[i]], i + 1
        else:
            return
        if i < len(ts) and ts[i].text == ":":  # a type
            while i < len(ts) and ts[i].text not in ("=", ",", ";"):
                i = pair.get(i, i) + 1
        function, given = False, None
        if i < len(ts) and ts[i].text == "=":
            i += 1
            j = i + (i < len(ts) and ts[i].text == "async")
            function = j < len(ts) and ts[j].text == "function"
            k = j
            opening = next((z for z in range(j + 1, min(j + 4, len(ts))) if ts[z].text == "("), None) if function else j
            if opening is not None and opening < len(ts):
                given = (opening, pair.get(opening, opening) + 1)  # the parameters, or the only one
            if k < len(ts) and ts[k].text == "(":
                k = pair[k] + 1
                if k < len(ts) and ts[k].text == ":":
                    while k < len(ts) and ts[k].text not in ("=>", ";", "{", ","):
                        k = pair.get(k, k) + 1
                function = function or (k < len(ts) and ts[k].text == "=>")
            elif k + 1 < len(ts) and ts[k].kind == "id":
                function = function or ts[k + 1].text == "=>"
            line = ts[i].line if i < len(ts) else 0
            while i < len(ts) and ts[i].text not in (",", ";", ")", "}", "]"):
                new_line = ts[i].line != line and ts[i].kind == "id" and ts[i - 1].kind in ("id", "num", "str") or ts[i].text in ("const", "let", "var", "export") and ts[i].line != line
                if new_line or (ts[i].line != line and ts[i - 1].text in (")", "}", "]") and ts[i].kind == "id"):
                    break
                i = pair.get(i, i)
                line = ts[i].line
                i += 1
        yield names, function, given
        if i >= len(ts) or ts[i].text != ",":
            return
        i += 1


def parse(code: str) -> list[Found]:
    """Definitions and exports in order of stage: functions, variables, classes, methods, types, exports."""
    ts = tokens(code)
    pair = _partners(ts)
    out: list[Found] = []
    end = lambda i: ts[min(i, len(ts) - 1)].at
    text = lambda i: ts[i].text if 0 <= i < len(ts) else ""
    for i, t in enumerate(ts):
        if t.kind != "id" or text(i - 1) in (".", "?."):
            continue
        if t.text == "function":
            j = i + 1 + (text(i + 1) == "*")
            named = j < len(ts) and ts[j].kind == "id"
            first = i - (text(i - 1) == "async")
            statement = text(first - 1) in ("", ";", "{", "}", "export", "default", ")") or (i and ts[i - 1].line != t.line)
            if named and statement:
                out.append(Found("functions", ts[j].text, ts[j].line, 0, ts[first].at, end(pair.get(j + 1, j + 1) + 1)))
        elif t.text in ("const", "let", "var") and text(i + 1) not in ("enum", ":"):
            for names, function, given in _declarators(ts, pair, i + 1):
                sig = code[ts[given[0]].at : end(given[1])].strip() if function and given else "()"
                for n in names:
                    sort = ("functions", f"const {n.text} = {sig} =>") if function else ("variables", "")
                    out.append(Found(sort[0], n.text, n.line, 1 if t.text != "var" else 2, t.at, n.at, signature=sort[1]))
        elif t.text == "class" and i + 1 < len(ts) and ts[i + 1].kind == "id" and text(i + 1) != "extends":
            name = ts[i + 1].text
            j = i + 2
            while j < len(ts) and ts[j].text != "{":
                j = pair.get(j, j) + 1
            out.append(Found("classes", name, ts[i + 1].line, 3, t.at, end(j)))
            k = j + 1
            while j in pair and k < pair[j]:
                opening = k + 1
                if text(opening) == "<":  # type parameters
                    while opening < pair[j] and text(opening) not in ("(", "{", ";", "="):
                        opening += 1
                if ts[k].kind == "id" and text(opening) == "(" and pair[opening] + 1 <= pair[j]:
                    z = pair[opening] + 1
                    while z < pair[j] and ts[z].text not in ("{", ";", "}", "="):
                        z += 1
                    if text(z) == "{" and ts[k].text != "constructor":
                        out.append(Found("functions", ts[k].text.lstrip("#"), ts[k].line, 4, ts[k].at, end(z), name))
                    k = z
                k = pair.get(k, k) + 1
        elif t.text in ("interface", "type", "enum") and i + 1 < len(ts) and ts[i + 1].kind == "id" and text(i + 2) in ("{", "=", "<", "extends"):
            out.append(Found("classes", ts[i + 1].text, ts[i + 1].line, 5, t.at, end(i + 2)))
        elif t.text == "export":
            out += _exports(ts, pair, i)
    return sorted(out, key=lambda f: f.stage)


def _exports(ts: list[Token], pair: dict[int, int], i: int) -> list[Found]:
    j = i + 1
    while j < len(ts) and ts[j].text in ("default", "async", "abstract", "declare"):
        j += 1
    if j >= len(ts):
        return []
    t = ts[j]
    one = lambda x: Found("exports", x.text, x.line, 6, ts[i].at, x.at)
    if t.text == "{":
        return [one(ts[k]) for k in range(j + 1, pair[j]) if ts[k].kind == "id" and ts[k - 1].text in ("{", ",") and ts[k].text != "type"]
    if t.text in ("const", "let", "var") and ts[j + 1].text != "enum":
        return [one(n) for names, _, _ in _declarators(ts, pair, j + 1) for n in names]
    if t.text in ("function", "class", "interface", "type", "enum"):
        k = j + 1 + (ts[j + 1].text == "*" if j + 1 < len(ts) else 0)
        return [one(ts[k])] if k < len(ts) and ts[k].kind == "id" else []
    return [one(t)] if t.kind == "id" and ts[j - 1].text == "default" else []


def symbols(code: str) -> tuple[list[tuple[str, str, int, int]], bool]:
    """(category, name, line, pass) of a text and whether it was parsed; () if it can't be."""
    try:
        found = parse(code)
    except Unbalanced:
        return [], False
    return [(f.category, f.name, f.line, k) for k, f in enumerate(found)], True


def skeleton(code: str) -> list[tuple[str, str, str, int]]:
    """(kind, owner, signature, line) of functions, classes, methods and exports, each export once."""
    out, exported = [], set()
    members = [Found("exports", m[1], k + 1, 7, 0, 0) for k, x in enumerate(code.split("\n")) if (m := re.match(MEMBER_EXPORT, x))]
    for f in [*parse(code), *members]:
        if f.category == "exports":
            if f.name not in exported:
                out.append(("export", "", f.name, f.line))
                exported.add(f.name)
        elif f.category in ("functions", "classes"):
            sig = re.sub(r"\s+", " ", f.signature or code[f.at : f.end]).strip(" {")
            kind = "class" if f.category == "classes" else "method" if f.owner else "function"
            out.append((kind, f.owner, sig if kind != "class" else f.name, f.line))
    return out
