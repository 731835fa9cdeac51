"""Model answers parsed to edits or rewrites, with the error kept in place of one raised; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.functions import diffs as D
from routelens.functions import text as T

#: Words that may stand before a method's type.
_MODIFIERS = "public|private|protected|static|final|synchronized|abstract|native"
_EDITS = "array<struct<signature:string,search:string,replace:string,error:string>>"
_REWRITES = "array<struct<signature:string,code:string,error:string>>"


def signature_of_code(code: Column) -> Column:
    """The first text that looks like a method's head: modifiers (or a line's indent), a type, a name and a parameter list, its
    white space made single; empty without one."""
    found = F.regexp_extract(code, rf"(?:^|\s)((?:(?:{_MODIFIERS})\s+)*[\w<>\[\],.]+\s+\w+\s*\([^)]*\))", 1)
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def signature_of_query(query: Column) -> Column:
    """The head of the first fenced method after "### Buggy functions" of a query; empty without one."""
    return signature_of_code(F.regexp_extract(query, r"(?is)###\s*Buggy functions.*?```java\s*(.*?)```", 1))


def edits_of(answer: Column) -> Column:
    """array<signature, search, replace, error> of an answer: its marked blocks, within fences if it has any; the n-th block takes
    the n-th ### heading (empty if there are fewer). error is what makes the edit invalid (see ``search_replace_error``)."""
    fences = T.code_blocks(answer)
    inner = F.when(F.exists(fences, lambda x: x.contains("<<<<<<< SEARCH")), F.array_join(fences, "\n")).otherwise(answer)

    def parsed(text: Column) -> Column:
        heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^###[ \t]*(\S.*)$"), F.lit(1)), F.trim)
        blocks = T.search_replace_blocks(text)
        one = lambda b, head: F.struct(F.coalesce(head, F.lit("")).alias("signature"), b["search"].alias("search"), b["replace"].alias("replace"), D.search_replace_error(head, b["search"], b["replace"]).alias("error"))
        return F.zip_with(blocks, F.slice(heads, F.lit(1), F.size(blocks)), one)

    return D._with(inner, parsed).cast(_EDITS)


def rewrites_of(answer: Column, query: Column) -> Column:
    """array<signature, code, error> of an answer: its fenced blocks, or else the whole text, with cut lines joined. The n-th takes
    the n-th ### heading, or the head of its code, or that of the query. error is what makes it invalid (see ``rewrite_error``)."""
    fences = T.code_blocks(answer)
    heads = F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)^###[ \t]*(\S.*)$"), F.lit(1)), F.trim)
    bodies = F.when(F.size(fences) > 0, fences).when(answer.rlike(r"\S"), F.array(F.trim(answer))).otherwise(F.array().cast("array<string>"))
    given = lambda c: F.when(c != "", c)

    def one(code: Column, head: Column) -> Column:
        joined = D.join_cut_lines(code)
        signature = F.coalesce(given(head), given(signature_of_code(joined)), given(signature_of_query(query)), F.lit(""))
        return F.struct(signature.alias("signature"), joined.alias("code"), D.rewrite_error(signature, joined).alias("error"))

    return D._with(F.struct(bodies.alias("bodies"), heads.alias("heads")), lambda x: F.zip_with(x["bodies"], F.slice(x["heads"], F.lit(1), F.size(x["bodies"])), one)).cast(_REWRITES)


def parse_answer(answer: Column, query: Column, kind: Column | None = None) -> Column:
    """struct<kind, ok, error, edits, rewrites>: an answer by its kind ("edit" or "rewrite"; found from the text where null).

    An unknown kind, and a null answer, aren't raised: ok is false and error says why; both arrays are empty then. Invalid
    blocks stay, each with its own error.
    """
    kind = F.coalesce(kind, T.detect_format(answer)) if kind is not None else T.detect_format(answer)
    error = F.when(answer.isNull(), "no answer").when(~kind.isin("edit", "rewrite"), F.concat(F.lit("unknown kind: "), kind))
    pick = lambda test, value, ddl: F.when(error.isNull() & test, value).otherwise(F.array().cast(ddl))
    return F.struct(
        F.when(answer.isNotNull(), kind).alias("kind"), error.isNull().alias("ok"), error.alias("error"), pick(kind == "edit", edits_of(answer), _EDITS).alias("edits"), pick(kind == "rewrite", rewrites_of(answer, F.coalesce(query, F.lit(""))), _REWRITES).alias("rewrites")
    )
