"""Text and patch functions as columns; pandas functions only where a pattern needs a callback."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of Java that the obfuscator leaves alone.
JAVA_WORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true false try void volatile while var record String Object Integer Boolean List Map Set".split())
_NAME = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*\b")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_code_fences(c: Column) -> Column:
    """The body between a first and a last fence line; other texts as they are."""
    body = F.regexp_extract(c, r"(?s)\A\s*```[^\n]*\n(.*?)\n?```\s*\z", 1)
    return F.when(c.rlike(r"(?s)\A\s*```[^\n]*\n.*```\s*\z"), body).otherwise(c)


def code_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)```[a-zA-Z]*\n(.*?)```"), F.lit(1))


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def detect_format(c: Column) -> Column:
    return F.when(c.contains("<<<<<<< SEARCH"), "edit").when(c.contains("###"), "rewrite").otherwise("edit")


def search_replace_blocks(c: Column) -> Column:
    """array<struct<search, replace>> of all marked blocks in order."""
    p = r"(?s)<<<<<<< SEARCH\n(.*?)\n?=======\n(.*?)\n?>>>>>>> REPLACE"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("search"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("replace"))


def apply_search_replace(body: Column, search: Column, replace: Column) -> Column:
    """``body`` with every occurrence replaced, or "error" when it isn't there."""
    return F.when(F.contains(body, search), F.replace(body, search, replace)).otherwise("error")


def patch_features(c: Column) -> Column:
    lines = F.split(c, "\n")
    added = F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))
    removed = F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))
    has = lambda p: F.exists(F.concat(added, removed), lambda x: x.rlike(p))
    return F.struct(
        F.size(added).alias("additions"), F.size(removed).alias("deletions"), F.size(F.filter(lines, lambda x: x.startswith("@@"))).alias("hunks"),
        has(r"\bif\s*\(").alias("condition"), has(r"\b(for|while)\s*\(").alias("loop"), has(r"\breturn\b").alias("returns"), has(r"\bnull\b").alias("null_check"), has(r"\b(try|catch|throw)\b").alias("exception"),
    )


def number_lines(c: Column, start: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda x, i: F.concat(x, F.lit(" // Line "), (i + start).cast("string"))), "\n")


def chunk_tokens(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` white-space tokens that share ``overlap`` with the one before."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - overlap), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, F.lit(size)), " "))


def parse_test_output(c: Column) -> Column:
    count = F.regexp_extract(c, r"Failing tests:\s*(\d+)", 1)
    return F.struct(F.when(count != "", count.cast("int")).alias("failing"), F.regexp_extract_all(c, F.lit(r"(?m)^\s+- (\S+)"), F.lit(1)).alias("names"))


def modeling_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("edit"), "edit").when(low.rlike("rewrite|rew|gen"), "rewrite").otherwise("unknown")


@F.pandas_udf(StringType())
def hash_identifiers(texts: pd.Series) -> pd.Series:
    """Names that aren't words of the language become ID_ and eight hex digits of their SHA-1."""
    sub = lambda m: m[0] if m[0] in JAVA_WORDS else f"ID_{hashlib.sha1(m[0].encode()).hexdigest()[:8]}"
    return texts.map(lambda t: None if t is None else _NAME.sub(sub, t))


def reverse_diff(text: str) -> str:
    """The unified diff that undoes a patch: sides swapped, deletions before additions in each run."""
    out, minus, plus = [], [], []

    def flush() -> None:
        out.extend(minus + plus)
        minus.clear()
        plus.clear()

    for line in text.split("\n"):
        if line.startswith(("--- ", "+++ ")):
            flush()
            if line[0] == "+":  # names swap places
                last = out.pop() if out and out[-1].startswith("--- ") else None
                out.append("--- " + line[4:])
                out.append("+++ " + (last or "--- ")[4:])
            else:
                out.append(line)
        elif m := re.match(r"@@ -(\S+) \+(\S+) @@(.*)", line):
            flush()
            out.append(f"@@ -{m[2]} +{m[1]} @@{m[3]}")
        elif line.startswith("+"):
            minus.append("-" + line[1:])
        elif line.startswith("-"):
            plus.append("+" + line[1:])
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


@F.pandas_udf(StringType())
def reverse_patch(texts: pd.Series) -> pd.Series:
    """``reverse_diff`` of each patch; null for a null one."""
    return texts.map(lambda t: None if t is None else reverse_diff(t))
