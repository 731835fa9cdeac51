"""Checks and repairs of patches, edits and model answers, as columns of built-in functions (no Python workers).

A null argument gives null unless a docstring says otherwise. Lines are split at the newline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.functions import text as T

#: Characters that end a line of code, and the length beyond which another end counts as cut off.
LINE_ENDS, CUT_LENGTH = ";,{})]:", 75


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row; within a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _first(c: Column, test) -> Column:
    """Place of the first line that passes, from 1; null for none."""
    return F.nullif(F.array_position(F.transform(c, test), True), F.lit(0))


def search_replace_error(signature: Column, search: Column, replace: Column) -> Column:
    """What makes an edit invalid: signature, search, replace or identical; null if nothing does. Nulls count as empty."""
    empty, bare = lambda c: F.coalesce(c, F.lit("")) == "", lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(empty(signature), "signature").when(empty(search), "search").when(empty(replace), "replace").when(bare(search) == bare(replace), "identical")


def rewrite_error(signature: Column, code: Column) -> Column:
    """What makes a rewritten method invalid: signature, code or braces; null if nothing does. Nulls count as empty."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(signature), "signature").when(empty(code), "code").when(~(code.contains("{") & code.contains("}")), "braces")


def join_cut_lines(code: Column) -> Column:
    """Code whose lines were cut off at about 80 characters, joined again.

    A line is cut if it has over 75 characters, ends with none of ; , { } ) ] : and the next one is neither blank, deeper nor
    begins with {. A cut line takes the next one whole, which can't be cut itself then.
    """
    bare = lambda x: F.regexp_replace(x, r"\s+$", "")
    indent = lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))

    def cut(line: Column, after: Column) -> Column:
        goes_on = after.rlike(r"^\s*[^\s{]") & (indent(after) <= indent(line))
        long = (F.length(bare(line)) > CUT_LENGTH) & ~F.substring(bare(line), -1, 1).isin(*LINE_ENDS)
        return F.when(long & F.coalesce(goes_on, F.lit(False)), "1").otherwise("0")

    def joined(pairs: Column) -> Column:
        # from the left, each cut line (J) takes its next one (S): a pattern over one letter a line does the fold
        marks = F.split(F.regexp_replace(F.array_join(F.transform(pairs, lambda p: cut(p["line"], p["after"])), ""), "1.", "JS"), "")
        text = lambda p, mark: F.when(mark == "J", F.concat(bare(p["line"]), F.regexp_replace(p["after"], r"^\s+", ""))).when(mark != "S", p["line"])
        return F.array_join(F.zip_with(pairs, F.slice(marks, F.lit(1), F.size(pairs)), text), "\n")

    pairs = lambda lines: F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda x, y: F.struct(x.alias("line"), y.alias("after")))
    return F.when(code.isNotNull(), _with(_with(_lines(code), pairs), joined))


def adjust_indent(original: Column, new: Column) -> Column:
    """``new`` shifted so that its first line that isn't blank is indented as that of ``original``. Blank lines, and lines
    that have too few spaces to lose, stay as they are."""
    spaces = lambda c: F.coalesce(F.length(F.regexp_extract(F.get(F.filter(_lines(c), lambda x: x.rlike(r"\S")), F.lit(0)), "^( *)", 1)), F.lit(0))

    def moved(x: Column, shift: Column) -> Column:
        less = F.repeat(F.lit(" "), -shift)
        return F.when(~x.rlike(r"\S") | (shift == 0), x).when(shift > 0, F.concat(F.repeat(F.lit(" "), shift), x)).when(F.startswith(x, less), F.substring(x, 1 - shift, F.length(x))).otherwise(x)

    return _with(spaces(original) - spaces(new), lambda shift: F.array_join(F.transform(_lines(new), lambda x: moved(x, shift)), "\n"))


def diff_error(patch: Column) -> Column:
    """The first thing that makes a unified diff malformed, or null: empty, from (no --- line), to (no +++), hunk (no @@), order
    (of those), then header, number (a start below 1) or prefix, with the line after a colon. A null patch is empty."""
    full, short = r"^@@ -(\d+),(\d+) \+(\d+),(\d+) @@", r"^@@ -(\d+) \+(\d+) @@"
    start = lambda x, side: F.regexp_extract(x, rf"^@@ .*?\{side}(\d+)", 1).cast("long")
    of = lambda x: F.when(~x.rlike(full) & ~x.rlike(short), F.concat(F.lit("header: "), x)).when((start(x, "-") < 1) | (start(x, "+") < 1), F.concat(F.lit("number: "), x))
    first = lambda found: F.get(found, F.lit(0))

    def error(lines: Column) -> Column:
        source, target, hunk = _first(lines, lambda x: x.startswith("---")), _first(lines, lambda x: x.startswith("+++")), _first(lines, lambda x: x.startswith("@@"))
        wrong = first(F.filter(F.transform(F.filter(lines, lambda x: x.startswith("@@")), of), lambda x: x.isNotNull()))
        odd = first(F.filter(F.slice(lines, F.coalesce(hunk, F.lit(1)).cast("int"), F.size(lines)), lambda x: (x != "") & ~x.startswith("@@") & ~x.rlike(r"^[ +\\-]")))
        out = F.when(source.isNull(), "from").when(target.isNull(), "to").when(hunk.isNull(), "hunk").when(~((source < target) & (target < hunk)), "order")
        return out.when(wrong.isNotNull(), wrong).when(odd.isNotNull(), F.concat(F.lit("prefix: "), odd))

    return F.when(F.coalesce(~patch.rlike(r"\S"), F.lit(True)), "empty").otherwise(_with(_lines(patch), error))


def hunk_bodies(patch: Column) -> Column:
    """array<struct<header, lines>>: each hunk up to the next header, or to a line that begins with diff or Index:."""

    def bodies(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("@@"), i)), lambda i: i.isNotNull())
        return _with(heads, lambda heads: F.zip_with(heads, F.slice(heads, F.lit(2), F.size(heads)), lambda at, end: body(lines, at, end)))

    def body(lines: Column, at: Column, end: Column) -> Column:
        whole = F.slice(lines, at + 2, F.coalesce(end, F.size(lines)) - at - 1)
        return F.struct(F.get(lines, at).alias("header"), _with(whole, upto).alias("lines"))

    def upto(whole: Column) -> Column:
        end = _first(whole, lambda x: x.rlike("^(diff|Index:)"))
        return F.slice(whole, F.lit(1), F.coalesce(end.cast("int") - 1, F.size(whole)))

    return F.when(patch.isNotNull(), _with(_lines(patch), bodies))


def hunks(patch: Column) -> Column:
    """array<struct<header, deletions, additions, context>>."""
    of = lambda body, sign: F.transform(F.filter(body, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, 2, F.length(x)))
    context = lambda body: F.transform(F.filter(body, lambda x: x.startswith(" ")), lambda x: F.substring(x, 2, F.length(x)))
    return F.transform(hunk_bodies(patch), lambda h: F.struct(h["header"].alias("header"), of(h["lines"], "-").alias("deletions"), of(h["lines"], "+").alias("additions"), context(h["lines"]).alias("context")))


def hunk_count_errors(patch: Column) -> Column:
    """array<int>: hunks (from 0) whose lines aren't as many, on both sides, as their header says.

    An automaton runs over a hunk's lines with what is left of either side; it goes wrong where a side has nothing left, and
    a hunk is right if nothing is left at its end. Empty lines count as context, as mail programs strip their blank, but for
    those after all lines are used up; lines that begin with a backslash count nothing.
    """

    def left(header: Column, side: str) -> Column:
        count = F.regexp_extract(header, rf"^@@ .*?\{side}\d+(?:,(\d+))?", 1)
        return F.when(count == "", 1).otherwise(F.try_to_number(count, F.lit("999999999"))).cast("int")

    def step(state: Column, line: Column) -> Column:
        kind = F.substring(line, 1, 1)
        over = (state["old"] <= 0) & (state["new"] <= 0)
        old = F.when((kind == "\\") | (kind == "+") | ((kind == "") & over), 0).otherwise(1)
        new = F.when((kind == "\\") | (kind == "-") | ((kind == "") & over), 0).otherwise(1)
        return F.struct((state["old"] - old).alias("old"), (state["new"] - new).alias("new"))

    def wrong(h: Column, i: Column) -> Column:
        end = F.aggregate(h["lines"], F.struct(left(h["header"], "-").alias("old"), left(h["header"], "+").alias("new")), step)
        return F.when(F.coalesce((end["old"] != 0) | (end["new"] != 0), F.lit(True)), i)

    return F.filter(F.transform(hunk_bodies(patch), wrong), lambda i: i.isNotNull())


def reversal_error(original: Column, reverse: Column) -> Column:
    """The first thing in which ``reverse`` doesn't undo ``original``: hunks, or additions, deletions or context with the hunk's
    number (from 0) after a colon; null if it does."""
    of = lambda x, y: F.when(x["deletions"] != y["additions"], "additions").when(x["additions"] != y["deletions"], "deletions").when(x["context"] != y["context"], "context")

    def first(sides: Column) -> Column:
        said = F.transform(F.zip_with(sides["a"], sides["b"], of), lambda what, i: F.concat(what, F.lit(": "), i.cast("string")))
        return F.when(F.size(sides["a"]) != F.size(sides["b"]), "hunks").otherwise(F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0)))

    return _with(F.struct(hunks(original).alias("a"), hunks(reverse).alias("b")), first)


def misplaced_deletions(patch: Column) -> Column:
    """How often, within hunks, a deletion comes right after an addition."""
    letter = lambda x: F.when(x.startswith("+") & ~x.startswith("+++"), "+").when(x.startswith("-") & ~x.startswith("---"), "-").otherwise(" ")
    count = lambda h: F.regexp_count(F.array_join(F.transform(h["lines"], letter), ""), F.lit(r"\+-"))
    return F.aggregate(F.transform(hunk_bodies(patch), count), F.lit(0), lambda s, x: s + x)


def apply_all(bodies: Column, edits: Column) -> Column:
    """Each body after the edit (search, replace) at its place; an empty array as soon as one doesn't fit."""
    out = F.transform(bodies, lambda b, i: F.coalesce(T.apply_search_replace(b, F.get(edits, i)["search"], F.get(edits, i)["replace"]), F.lit("error")))
    return F.when(F.array_contains(out, "error"), F.array().cast("array<string>")).otherwise(out)


def apply_in_order(body: Column, edits: Column) -> Column:
    """``body`` after all edits (search, replace), each on what the one before left; "error" once one doesn't fit."""
    return F.aggregate(edits, body, lambda b, e: F.when(b == "error", b).otherwise(T.apply_search_replace(b, e["search"], e["replace"])))


def block_check(query: Column, answer: Column) -> Column:
    """struct<functions, edits, same>: fenced blocks in the query's section of functions, against edits in the answer; null for
    a query without that section."""
    head = "### Buggy functions"
    at = F.instr(query, head)
    functions = F.regexp_count(F.substring(query, at + len(head), F.length(query)), F.lit(r"```\w+"))
    edits = F.regexp_count(answer, F.lit(r"<<<<<<<\s+SEARCH"))
    return F.when((at > 0) & answer.isNotNull(), F.struct(functions.alias("functions"), edits.alias("edits"), (functions == edits).alias("same")))
