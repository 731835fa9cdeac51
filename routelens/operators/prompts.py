"""What a prompt says about a bug, assembled from its functions and messages, and templates filled with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import text as T

#: What stands for a missing comment, exception and test, and the parts that each kind of query fills in.
NO_COMMENT, NO_ERROR, NO_TEST = "This function has no comment.", "This function has no exception info.", "This function has no failed test."
PARTS = {"agent": ("BUGGY_COMMENT", "ERROR_MESSAGE", "FAILED_TEST", "BUGGY_CODE"), "no_comment": ("ERROR_MESSAGE", "FAILED_TEST", "BUGGY_CODE"), "no_test": ("BUGGY_COMMENT", "ERROR_MESSAGE", "BUGGY_CODE"), "no_test_message": ("BUGGY_COMMENT", "FAILED_TEST", "BUGGY_CODE"), "pure": ("BUGGY_CODE",)}


def bug_info(functions: DataFrame, messages: DataFrame, numbered: bool = False) -> DataFrame:
    """Per slug: buggy_comment, error_message, failed_test, buggy_code, func_num, method_names, method_signatures, locations.

    ``functions`` needs slug, comment, buggy_code, path, start_line, end_line, method_name and method_sig, ``messages`` slug,
    exception_info and test_method. Functions come in order of path, first line and signature, messages in order of their
    texts. A path is given from behind ``<slug>_buggy`` on; with ``numbered`` it stands before each function, whose lines
    are numbered. Null comments and slugs without messages get a standing text; null messages are left out. Null slugs are left
    out; slugs without functions have no row. A slug's functions are gathered in one row, as its prompt holds them all.
    """
    slug = F.col("slug").cast("string")
    path = F.element_at(F.split(F.trim("path"), F.concat(F.lit(r"\Q"), slug, F.lit(r"_buggy\E")), 2), -1)
    line = F.struct(
        path.alias("file_path"), F.col("start_line").cast("long").alias("start_line"), F.trim("method_sig").alias("buggy_function"), F.col("end_line").cast("long").alias("end_line"), F.trim("method_name").alias("name"),
        F.coalesce(F.trim("comment"), F.lit(NO_COMMENT)).alias("comment"), F.coalesce("buggy_code", F.lit("")).alias("code"),
    )
    held = functions.where("slug is not null").groupBy("slug").agg(F.array_sort(F.collect_list(line)).alias("fs"))
    fenced = lambda f: F.concat(f["file_path"], F.lit("\n```java\n"), T.number_lines(f["code"], f["start_line"]), F.lit("\n```\n")) if numbered else F.concat(F.lit("```java\n"), f["code"], F.lit("\n```\n"))
    comment = lambda f: F.when(f["comment"] != "", F.concat(F.lit("   "), f["comment"], F.lit("\n"))).otherwise("")
    place = lambda f: F.struct(f["buggy_function"].alias("buggy_function"), f["file_path"].alias("file_path"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"))
    said = messages.where("slug is not null").groupBy("slug").agg(*(F.array_join(F.array_sort(F.collect_list(c)), "\n").alias(c) for c in ("exception_info", "test_method")))
    joined = lambda f: F.array_join(F.transform("fs", f), "")
    return held.join(said, "slug", "left").select(
        "slug", joined(comment).alias("buggy_comment"), F.coalesce("exception_info", F.lit(NO_ERROR)).alias("error_message"), F.coalesce("test_method", F.lit(NO_TEST)).alias("failed_test"), joined(fenced).alias("buggy_code"), F.size("fs").alias("func_num"),
        F.array_distinct(F.transform("fs", lambda f: f["name"])).alias("method_names"), F.array_distinct(F.transform("fs", lambda f: f["buggy_function"])).alias("method_signatures"), F.transform("fs", place).alias("locations"),
    )


def build_query(mode: str, template: str) -> Column:
    """The template of a mode with its ``{PART}`` marks filled from the columns of ``bug_info``; all parts but the comment are
    stripped. Marks of parts that the mode leaves out stay."""
    if mode not in PARTS:
        raise ValueError(f"mode is one of {', '.join(PARTS)}")
    out = F.lit(template)
    for part in PARTS[mode]:
        value = F.col(part.lower())
        out = F.replace(out, F.lit("{" + part + "}"), value if part == "BUGGY_COMMENT" else F.regexp_replace(value, r"\A\s+|\s+\z", ""))
    return out
