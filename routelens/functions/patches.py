"""Patches, signatures and model responses as columns; pandas functions where lines have to be aligned.

A null argument gives null everywhere. Texts are lists of lines split at the newline, so a last line without one is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from routelens.functions.text import JAVA_WORDS, reverse_diff

#: Roots that source paths are taken from, in order; prefixes of names that keep their sense.
ROOTS = ("source/", "src/main/java/", "src/")
PREFIXES = ("get", "set", "is", "has", "add", "remove", "create", "delete", "update", "find", "to", "from", "parse", "build", "init", "check", "test")
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_SIGNATURE = re.compile(r"([A-Za-z_$][\w$]*)\s*\(([^()]*)\)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


# responses, identifiers and labels


def embedding_of(response: Column) -> Column:
    """array<double> of an embedding response: the first of data[0].embedding, embedding, embeddings, vector, vectors."""
    found = [F.from_json(F.get_json_object(response, f"$.{p}"), "array<double>") for p in ("data[0].embedding", "embedding", "embeddings", "vector", "vectors")]
    return F.coalesce(*found)


def token_logprobs(response: Column) -> Column:
    """array<double> of the answer's token log probabilities, from the choice or else from its message."""
    kind = "array<struct<token:string,logprob:double>>"
    found = [F.from_json(F.get_json_object(response, p), kind) for p in ("$.choices[0].logprobs.content", "$.choices[0].message.logprobs.content")]
    return F.filter(F.transform(F.coalesce(*found), lambda x: x["logprob"]), lambda x: x.isNotNull())


def mean_nll(logprobs: Column) -> Column:
    """Mean negative log likelihood; null for no tokens. Its exponential is the perplexity."""
    return F.when(F.size(logprobs) > 0, -F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs))


def slug_of(item: Column, dialect: str = "last") -> Column:
    """The slug of slug__view: before the "last" or the "first" double underscore; the whole without one."""
    head = {"last": r"^(?s)(.*)__", "first": r"^(?s)(.*?)__"}[dialect]
    return F.when(item.contains("__"), F.regexp_extract(item, head, 1)).otherwise(item)


def slug_fold(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit("unknown"))


def markdown_escape(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.to_json(F.struct(*parts)))


def number_ranges(c: Column) -> Column:
    """array<int> of a list such as "1-3,5", sorted and distinct; parts that aren't numbers are left out."""
    part = lambda x, i: F.try_element_at(F.split(F.trim(x), r"\s*-\s*"), F.lit(i)).try_cast("int")
    spread = lambda x: F.when(part(x, -1) >= part(x, 1), F.sequence(part(x, 1), part(x, -1))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(c, ","), spread))))


def relative_path(path: Column) -> Column:
    """From the first of the known source roots that the path holds; else the path."""
    out = path
    for root in reversed(ROOTS):
        at = F.instr(path, root)
        out = F.when(at > 0, F.substring(path, at, F.char_length(path))).otherwise(out)
    return out


def test_verdict(output: Column) -> Column:
    """"passed", "failed", "compile" or "unknown" from a test log; a log without a count is unknown."""
    count = F.regexp_extract(output, r"Failing tests:\s*(\d+)", 1)
    return F.when(output.isNull(), None).when(output.rlike(r"(?i)compil\w* (error|fail)|BUILD FAILED"), "compile").when(count == "", "unknown").when(count.cast("int") == 0, "passed").otherwise("failed")


# checks of patches with built-in functions


def patch_info(patch: Column) -> Column:
    """struct<path, additions, deletions> of a unified diff, or of one that undoes it (whose names have changed sides)."""
    lines = F.split(patch, "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return F.struct(F.regexp_extract(patch, r"(?m)^\+\+\+ (?:[ab]/)?(\S+)", 1).alias("path"), count("+").alias("additions"), count("-").alias("deletions"))


def hunk_order_ok(patch: Column) -> Column:
    """Whether no deletion follows an addition within a run of changes."""
    body = F.filter(F.split(patch, "\n"), lambda x: ~x.rlike(r"^(\+\+\+|---) "))
    return ~F.array_join(F.transform(body, lambda x: F.when(F.substring(x, 1, 1) == "", " ").otherwise(F.substring(x, 1, 1))), "").rlike(r"\+-")


# alignment of lines


def _texts(f: Callable) -> Callable:
    """A pandas function of string columns from one of strings; null when an argument is."""

    def over(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    return over


def signature_text(text: str) -> str | None:
    """name(type,...): generics, annotations, modifiers and parameter names removed; None without a parameter list."""
    flat = re.sub(r"@\w+(?:\([^()]*\))?", " ", text)
    while (cut := re.sub(r"<[^<>]*>", "", flat)) != flat:
        flat = cut
    m = _SIGNATURE.search(flat)
    if not m:
        return None
    kinds = []
    for part in filter(None, (p.strip() for p in m[2].split(","))):
        words = [w for w in part.replace("...", "[] ").split() if w != "final"]
        kinds.append((words[0] if words else "").rsplit(".", 1)[-1] + ("[]" if len(words) > 1 and words[-1].endswith("[]") and not words[0].endswith("[]") else ""))
    return f"{m[1]}({','.join(kinds)})"


def _bare(lines: list[str]) -> list[tuple[int, str]]:
    """Lines that carry code, without indent: blank ones and lone braces don't count."""
    return [(i, s) for i, x in enumerate(lines) if (s := x.strip()) and s not in "{}"]


def locate(source: str, block: str) -> list[tuple[int, int]]:
    """(first, last) line of every place in ``source`` whose code lines are those of ``block``; from 0."""
    have, want = _bare(source.split("\n")), [s for _, s in _bare(block.split("\n"))]
    if not want:
        return []
    codes = [s for _, s in have]
    return [(have[i][0], have[i + len(want) - 1][0]) for i, x in enumerate(codes[: len(codes) - len(want) + 1]) if x == want[0] and codes[i : i + len(want)] == want]


def diff_text(before: str, after: str, path: str, context: int = 3) -> str:
    """Unified diff; empty for equal texts. What both ends share is cut off before lines are aligned."""
    a, b = before.split("\n"), after.split("\n")
    if a == b:
        return ""
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]), strict=False)) if x != y), min(len(a), len(b)) - head)
    low = max(0, head - context)
    more = min(tail, context)
    x, y = a[low : len(a) - tail + more], b[low : len(b) - tail + more]
    out = [f"--- a/{path}", f"+++ b/{path}"]
    for group in SequenceMatcher(None, x, y, autojunk=False).get_grouped_opcodes(context):
        i, j, n, m = group[0][1], group[0][3], group[-1][2] - group[0][1], group[-1][4] - group[0][3]
        out.append(f"@@ -{low + i + (n > 0)},{n} +{low + j + (m > 0)},{m} @@")
        for tag, i1, i2, j1, j2 in group:
            if tag == "equal":
                out += [" " + s for s in x[i1:i2]]
            else:
                out += ["-" + s for s in x[i1:i2]] + ["+" + s for s in y[j1:j2]]
    return "\n".join(out)


def apply_diff(body: str, patch: str) -> str:
    """``body`` after all hunks in order; "error" when one fits nowhere. Lines are compared without indent, at the place
    that the header names or else at the first one after the last hunk."""
    lines, hunks = body.split("\n"), []
    for line in patch.split("\n"):
        if m := _HUNK.match(line):
            hunks.append((int(m[1]), [], []))
        elif hunks:
            sign = line[:1] or " "
            if sign in " -":
                hunks[-1][1].append(line[1:])
            if sign in " +":
                hunks[-1][2].append(line[1:])
    if not hunks:
        return "error" if patch.strip() else body
    out, at = [], 0
    for start, old, new in hunks:
        bare = [x.strip() for x in old]
        fits = lambda i: at <= i <= len(lines) - len(bare) and [x.strip() for x in lines[i : i + len(bare)]] == bare  # noqa: B023, E731
        guess = start - 1 if old else start
        i = guess if fits(guess) else next((i for i in range(at, len(lines) - len(bare) + 1) if fits(i)), -1)
        if i < 0:
            return "error"
        out += lines[at:i] + new
        at = i + len(old)
    return "\n".join(out + lines[at:])


def anonymize(text: str) -> str:
    """Names that aren't words of the language, numbered by kind in order of first use; a telling prefix stays."""
    named: dict[str, str] = {}
    counts: dict[str, int] = {}

    def rename(m: re.Match) -> str:
        name = m[0]
        if name in JAVA_WORDS:
            return name
        if name not in named:
            rest = text[m.end() : m.end() + 8].lstrip(" ")
            kind = "Method" if rest.startswith("(") else "Class" if name[0].isupper() else "Var"
            n = counts[kind] = counts.get(kind, -1) + 1
            prefix = next((p for p in PREFIXES if name.lower().startswith(p)), None)
            named[name] = f"{prefix}{kind}{n}" if prefix else f"{kind.upper()}_{n}"
        return named[name]

    return _NAME.sub(rename, text)


def split_rewrites(text: str) -> list[tuple[str, str]]:
    """(signature, code) of each part headed by ###; without heads the whole text under the signature it begins with."""
    parts = re.split(r"(?m)^###[ \t]*(\S.*)$", text)
    if len(parts) == 1:
        return [(signature_text(text) or "", text.strip())] if text.strip() else []
    return [(head.strip(), code.strip()) for head, code in zip(parts[1::2], parts[2::2], strict=True)]


def _string_function(f: Callable, *, arity: int) -> Callable:
    """``f`` over string columns, with Arrow transfer."""
    if arity == 1:

        def one(a: pd.Series) -> pd.Series:
            return _texts(f)(a)

        return F.pandas_udf(one, StringType())
    if arity == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return _texts(f)(a, b)

        return F.pandas_udf(two, StringType())

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _texts(f)(a, b, c)

    return F.pandas_udf(three, StringType())


signature_key = _string_function(signature_text, arity=1)
anonymize_patch = _string_function(anonymize, arity=1)
apply_unified_diff = _string_function(apply_diff, arity=2)
unified_diff = _string_function(diff_text, arity=3)


@F.pandas_udf(StructType([StructField("patch", StringType()), StructField("applied", StringType())]))
def diff_applied(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.DataFrame:
    """struct<patch, applied>: the unified diff, and ``before`` after its hunks, both in one Python worker."""
    patch = _texts(diff_text)(before, after, path)
    return pd.DataFrame({"patch": patch, "applied": _texts(apply_diff)(before, patch)})


@F.pandas_udf(StructType([StructField("patch", StringType()), StructField("applied", StringType())]))
def diff_undone(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.DataFrame:
    """struct<patch, applied>: the diff that undoes a unified diff, and ``after`` after its hunks, both in one Python worker."""
    patch = _texts(lambda *texts: reverse_diff(diff_text(*texts)))(before, after, path)
    return pd.DataFrame({"patch": patch, "applied": _texts(apply_diff)(after, patch)})


@F.pandas_udf(ArrayType(StringType()))
def code_lines(text: pd.Series) -> pd.Series:
    """Lines that carry code, as ``locate`` compares them."""
    return _texts(lambda t: [s for _, s in _bare(t.split("\n"))])(text)


@F.pandas_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])))
def locate_block(source: pd.Series, block: pd.Series) -> pd.Series:
    return _texts(lambda s, b: [{"first": i, "last": j} for i, j in locate(s, b)])(source, block)


@F.pandas_udf(ArrayType(StructType([StructField("signature", StringType()), StructField("code", StringType())])))
def rewrite_blocks(text: pd.Series) -> pd.Series:
    return _texts(lambda t: [{"signature": s, "code": c} for s, c in split_rewrites(t)])(text)
