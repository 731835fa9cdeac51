"""Model answers to unified diffs: strategies are tried in order, each failure is kept, and nothing is raised.

Each source is lexed once and meets its patches by one sorted join on the path; what is left is one row a patch, which a small
fold turns to a diff.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.functions import patches as P
from routelens.functions.java import java_methods
from routelens.operators.shared import written

#: The strategies, in the order in which they are tried.
METHOD, FILE, MANUAL = "method_scoped_exact", "file_scoped_exact", "manual_review"
#: What is kept of a method's place.
_PLACE = ("first_line", "last_line", "begin", "end")
_OUTCOME = "strategy string, located int, tried array<struct<strategy:string,block:int,quality:string>>, diff string"


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _shifted(code: str, indent: int) -> str:
    """``code`` with its first line that isn't blank at ``indent``; blank lines and those too far left stay as they are."""
    lines = code.split("\n")
    shift = indent - next((_indent(x) for x in lines if x.strip()), indent)
    return "\n".join(x if not x.strip() or _indent(x) < -shift else " " * shift + x if shift > 0 else x[-shift:] for x in lines)


def _placed(source: str | None, blocks: list, ms: list, scope: str) -> tuple[list[tuple[int, int, str]], tuple[int, str] | None]:
    """Line ranges and new text of all blocks by one strategy, or the first block that has no single place, and why."""
    out = []
    for n, (block, m) in enumerate(zip(blocks, ms, strict=True)):
        if source is None:
            return [], (n, "no_file")
        if scope == METHOD and m is None:
            return [], (n, "method_not_found")
        found = P.locate(source, block["search"] or "")
        if scope == METHOD:
            found = [(i, j) for i, j in found if i >= m["first_line"] - 1 and j <= m["last_line"] - 1]
        if len(found) != 1:
            return [], (n, "exact_ambiguous" if found else "not_found")
        if any(i <= found[0][1] and found[0][0] <= j for i, j, _ in out):
            return [], (n, "overlapping")
        out.append((*found[0], block["replace"] or ""))
    return sorted(out), None


def _edited(source: str | None, blocks: list, ms: list) -> tuple[str, int, list, str | None]:
    """(strategy, blocks placed, failures, source after the edit): the first strategy that places every block."""
    tried = []
    for scope in (METHOD, FILE):
        changes, failure = _placed(source, blocks, ms, scope)
        if failure is None:
            lines = (source or "").split("\n")
            for first, last, text in reversed(changes):
                lines[first : last + 1] = text.split("\n")
            return scope, len(changes), tried, "\n".join(lines)
        tried.append({"strategy": scope, "block": failure[0], "quality": failure[1]})
    return MANUAL, 0, tried, None


def _rewritten(source: str, blocks: list, ms: list) -> tuple[str, int, list, str]:
    """The source with each method that is there replaced; of methods within each other the outer one."""
    out, at, located = [], 0, 0
    for m, text in sorted(((m, b["replace"] or "") for b, m in zip(blocks, ms, strict=True) if m), key=lambda x: x[0]["begin"]):
        if m["begin"] >= at:
            line = source[source.rfind("\n", 0, m["begin"]) + 1 : m["begin"]]
            out += [source[at : m["begin"]], _shifted(text, _indent(line + "x")).lstrip(" ")]
            at, located = m["end"], located + 1
    return METHOD, located, [], "".join(out) + source[at:]


def _named(blocks: list, keys: list | None, places: list | None) -> list[dict | None]:
    """The first method that each block names, or None."""
    at: dict[str, int] = {}
    for n, key in enumerate(() if keys is None else keys):
        at.setdefault(key, n)
    found = [at.get(P.signature_text(b["signature"] or "")) for b in blocks]
    return [None if n is None else dict(zip(_PLACE, map(int, places[n * len(_PLACE) : (n + 1) * len(_PLACE)]), strict=True)) for n in found]


def _outcome(source: pd.Series, kind: pd.Series, path: pd.Series, blocks: pd.Series, keys: pd.Series, places: pd.Series) -> pd.DataFrame:
    out = []
    for s, k, p, bs, *ms in zip(source, kind, path, blocks, keys, places, strict=True):
        bs = list(bs)
        found = _named(bs, *ms)
        if k == "edit" and (bs or s is not None):
            strategy, located, tried, after = _edited(s, bs, found)
        elif k == "rewrite" and s is not None:
            strategy, located, tried, after = _rewritten(s, bs, found)
        else:
            strategy, located, tried, after = MANUAL, 0, [], None
        out.append((strategy, located, tried, None if after is None or s is None else P.diff_text(s, after, p)))
    return pd.DataFrame(out, columns=["strategy", "located", "tried", "diff"])


def normalize(patches: DataFrame, files: DataFrame, with_source: bool = False) -> DataFrame:
    """Per patch: id, strategy, located (blocks that found their place), tried, diff; its source too, if asked for.

    ``patches`` needs id, path, kind ("edit" or "rewrite") and blocks (array of signature, search, replace; a rewrite's code is
    in replace), ``files`` path and source; other columns are ignored.

    An edit is placed by the method its block names (``method_scoped_exact``), or else by the whole file
    (``file_scoped_exact``); a strategy holds if each block has exactly one place, and else gives way to the next. A rewrite
    replaces its method and knows the first strategy alone; methods that aren't there are passed over. ``tried`` keeps each
    failure: strategy, block (from 0) and quality (no_file, method_not_found, not_found, exact_ambiguous or overlapping). When
    all fail the strategy is ``manual_review`` and the diff null. A rewrite is shifted to the indentation of its method.

    Lines are compared without indent, blank ones and lone braces left out. Patches of unknown kind and rewrites of unknown
    files go to manual review as well. Null or empty blocks give an empty diff. Repeated patches give one row each; of files
    that repeat a path one counts.

    The join is never a broadcast: sources compress so well that their exchanged size says little of what they fill in memory.
    """
    texts = files.groupBy("path").agg(F.min("source").alias("source")).withColumn("ms", java_methods("source"))
    places = F.flatten(F.transform("ms", lambda m: F.array(*(m[c] for c in _PLACE))))
    sources = written(texts.select("path", "source", F.transform("ms", lambda m: m["key"]).alias("keys"), places.alias("places")), "sources")  # lexed once
    p = patches.select("id", "path", "kind", F.coalesce("blocks", F.array()).alias("blocks"))
    held = p.join(sources.hint("merge"), "path", "left")
    fold = F.pandas_udf(_outcome, _OUTCOME)
    got = held.select("id", "source", fold("source", "kind", P.relative_path(F.col("path")), "blocks", "keys", "places").alias("x"))
    return got.select("id", *["source"] * with_source, "x.*")


def failure_report(normalized: DataFrame) -> DataFrame:
    """id and text of a report for each patch that no strategy placed: a line for each attempt, in order."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["strategy"], F.lit(": block "), (x["block"] + 1).cast("string"), F.lit(", "), x["quality"])
    head = F.concat(F.lit("Patch "), F.col("id").cast("string"), F.lit(" needs a manual review"))
    return normalized.where(F.col("strategy") == MANUAL).select("id", F.array_join(F.concat(F.array(head), F.transform("tried", line)), "\n").alias("report"))


def report_rows(normalized: DataFrame) -> DataFrame:
    """id, status (success, empty, ambiguous or failed), strategy, detail: a report's row for each patch.

    empty is a diff without changes, ambiguous a manual review whose last attempt found several places; detail is the last
    attempt's block and quality.
    """
    last = F.try_element_at("tried", F.lit(-1))
    status = F.when((F.col("strategy") != MANUAL) & (F.coalesce("diff", F.lit("")) != ""), "success").when(F.col("strategy") != MANUAL, "empty").when(last["quality"] == "exact_ambiguous", "ambiguous").otherwise("failed")
    return normalized.select("id", status.alias("status"), "strategy", F.concat(F.lit("block "), (last["block"] + 1).cast("string"), F.lit(": "), last["quality"]).alias("detail"))


def report_summary(reports: DataFrame) -> DataFrame:
    """status, strategy, n and share of all."""
    counted = reports.groupBy("status", "strategy").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each status and strategy
    return counted.select("status", "strategy", "n", (F.col("n") / total).alias("share"))
