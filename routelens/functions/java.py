"""Methods of Java sources: a lexer and a stack of scopes give each method's place, name and parameter types.

Comments, strings, characters and text blocks never count as code. Scopes are bodies of types and of code; a method begins in
a body of a type (anonymous and local ones too) and ends with its body, or at the semicolon if it has none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_FIELDS = {"name": StringType(), "key": StringType(), "signature": StringType(), "first_line": IntegerType(), "last_line": IntegerType(), "begin": IntegerType(), "end": IntegerType()}
METHODS = ArrayType(StructType([StructField(name, kind) for name, kind in _FIELDS.items()]))
_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?(?:(?<!\\)\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>(?:[^\W\d]|\$)[\w$]*)|(?P<other>\d[\w.]*|.)""", re.S)
#: The language's modifiers, and words before a parenthesis that don't name a method.
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
NOT_NAMES = frozenset("if for while switch catch synchronized return new super this else do try assert throw case yield".split())


@dataclass
class Scope:
    kind: str  # type, enum (while its constants last) or code
    name: str = ""
    method: dict | None = None
    head: list = field(default_factory=list)  # what stood before the brace, if it lies within parentheses
    depth: int = 0


def _without_annotations(head: list[tuple[str, int]]) -> list[tuple[str, int]]:
    out, i = [], 0
    while i < len(head):
        if head[i][0] == "@" and i + 1 < len(head) and head[i + 1][0] != "interface":
            i += 2
            while i + 1 < len(head) and head[i][0] == ".":
                i += 2
            if i < len(head) and head[i][0] == "(":
                i = _closing(head, i) + 1
        else:
            out.append(head[i])
            i += 1
    return out


def _closing(head: list[tuple[str, int]], at: int) -> int:
    depth = 0
    for i in range(at, len(head)):
        depth += {"(": 1, ")": -1}.get(head[i][0], 0)
        if not depth:
            return i
    return len(head) - 1


def _parts(tokens: list[str]) -> Iterator[list[str]]:
    """Tokens between commas outside of all brackets."""
    depth, part = 0, []
    for t in tokens:
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(t, 0)
        if t == "," and not depth:
            yield part
            part = []
        else:
            part.append(t)
    yield part


def _parameter(tokens: list[str]) -> tuple[str, str] | None:
    """(simple type, type as written) of a parameter; None for none and for a receiver."""
    tokens = [t for t, _ in _without_annotations([(t, 0) for t in tokens]) if t != "final"]
    if not tokens or tokens[-1] == "this":
        return None
    written, words, dims, depth = [], [], 0, 0
    last = max((i for i, t in enumerate(tokens) if t[0].isalpha() or t[0] in "_$"), default=-1)
    lone = sum(t[0].isalpha() or t[0] in "_$" for t in tokens) == 1
    for i, t in enumerate(tokens):
        if i == last and not lone:
            continue
        depth += t == "<"
        if not depth:
            if t == "[":
                dims += 1
            elif t[0].isalpha() or t[0] in "_$":
                words.append(t)
        depth -= t == ">"
        written.append(t)
    text = re.sub(r"^(?:[\w$]+\.)+(?=[\w$])", "", "".join(f" {t} " if t in ("extends", "super") else t for t in written))
    if text.endswith("..."):
        dims, text = dims + 1, text[:-3] + "[]"
    return (words[-1] if words else "") + "[]" * dims, text


def _method(head: list[tuple[str, int]], owner: Scope, body: bool) -> dict | None:
    """Name and types of the method that ``head`` declares in ``owner``; None if it declares none."""
    bare = _without_annotations(head)
    words = [t for t, _ in bare]
    p = words.index("(") if "(" in words else 0
    if p < 1 or "=" in words[:p] or "new" in words[:p] or words[p - 1] in NOT_NAMES or not (words[p - 1][0].isalpha() or words[p - 1][0] in "_$"):
        return None
    name, before, q = words[p - 1], words[: p - 1], _closing(bare, p)
    kind = [t for t in before if t not in MODIFIERS]
    if kind and kind[0] == "<":  # type parameters
        depth = 0
        for i, t in enumerate(kind):
            depth += {"<": 1, ">": -1}.get(t, 0)
            if not depth:
                kind = kind[i + 1 :]
                break
    if kind[-1:] == ["."] or (not kind and not (body and (name == owner.name or not owner.name))) or words[q + 1 : q + 2] not in ([], ["throws"], ["default"], ["["]):
        return None
    found = [x for x in map(_parameter, _parts(words[p + 1 : q])) if x]
    return {"name": name, "key": f"{name}({','.join(x[0] for x in found)})", "signature": f"{name}({', '.join(x[1] for x in found)})", "begin": head[0][1]}


def _opened(head: list[tuple[str, int]], owner: Scope) -> Scope:
    """The scope that a brace after ``head`` opens in ``owner``."""
    words = [t for t, _ in _without_annotations(head)]
    depth = 0
    for i, t in enumerate(words):
        depth += {"(": 1, ")": -1}.get(t, 0)
        declares = t in ("class", "interface", "enum") and words[i - 1 : i] != ["."] or t == "record" and words[i + 2 : i + 3] in (["("], ["<"])
        if declares and not depth and i + 1 < len(words):
            return Scope("enum" if t == "enum" else "type", words[i + 1])
    if owner.kind == "enum":
        return Scope("type")
    if owner.kind == "type" and (found := _method(head, owner, True)):
        return Scope("code", method=found)
    if words[-1:] == [")"] and "new" in words:
        last = len(words) - 1 - words[::-1].index("new")
        inside = words[last + 1 :]
        if "(" in inside and _closing([(t, 0) for t in inside], inside.index("(")) == len(inside) - 1:
            return Scope("type")
    return Scope("code")


def methods(source: str) -> list[dict]:
    """name, key (name and simple types), signature (types as written), first and last line (from 1), begin and end (code
    points, end exclusive) of each method, outer ones first."""
    found, scopes, head, depth = [], [Scope("type")], [], 0
    lines = [m.start() for m in re.finditer("\n", source)]

    def add(method: dict, end: int) -> None:
        method |= {"end": end, "first_line": bisect_left(lines, method["begin"]) + 1, "last_line": bisect_left(lines, end - 1) + 1}
        found.append(method)

    for m in _TOKEN.finditer(source):
        t, at, owner = m[0], m.start(), scopes[-1]
        if m.lastgroup == "skip":
            continue
        if m.lastgroup == "text":
            head.append(('"', at))
        elif t == "{":
            scope = _opened(head, owner)
            scope.head, scope.depth = (head, depth) if depth else ([], 0)
            scopes.append(scope)
            head, depth = [], 0
        elif t == "}":
            if len(scopes) > 1:
                scopes.pop()
                if owner.method:
                    add(owner.method, m.end())
                head, depth = owner.head, owner.depth
        elif t == ";" and not depth:
            if owner.kind == "type" and (declared := _method(head, owner, False)):
                add(declared, m.end())
            elif owner.kind == "enum":
                owner.kind = "type"
            head = []
        elif t == "," and owner.kind == "enum" and not depth:
            head = []
        else:
            depth = max(0, depth + {"(": 1, ")": -1}.get(t, 0))
            head.append((t, at))
    return sorted(found, key=lambda x: x["begin"])


@F.pandas_udf(METHODS)
def java_methods(sources: pd.Series) -> pd.Series:
    """The methods of each source; null for a null one."""
    return pd.Series([None if s is None else methods(s) for s in sources], dtype=object)


def method_range(source: Column, head: Column, length: Column) -> Column:
    """struct<first, last> of lines from 0: where the text ``head`` begins, or else the first line that equals its first line
    up to the closing parenthesis; ``length`` lines on. Null if there is neither."""
    first = F.trim(F.element_at(F.split(head, "\n"), 1))
    line = F.array_position(F.transform(F.split(source, "\n"), lambda x: F.trim(F.substring_index(x, ")", 1))), first) - 1
    at = F.instr(source, head)
    start = F.when(at > 0, F.size(F.split(F.substring(source, F.lit(1), at - 1), "\n")) - 1).when(line >= 0, line.cast("int"))
    return F.when(start.isNotNull(), F.struct(start.alias("first"), (start + length).cast("int").alias("last")))
