"""Texts cut to a budget of tokens."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=held, special_tokens={})


def token_number(text: Column | str, ranks: str, pattern: str) -> Column:
    """Tokens of a text by a file of byte-level ranks; null for a null one."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks, pattern).encode_ordinary
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count(text)


def halves_within(text: str, limit: int, encoding) -> tuple[list[str], list[int]]:
    """Pieces of at most ``limit`` tokens each that join to ``text``, and their tokens: what has more is cut at its middle token, again and again.

    A token may end within a character; a cut moves back to where that character begins, and ahead only if that is the start.
    A single character can't be cut, so it may hold more than ``limit`` tokens.
    """
    done, tokens, todo = [], [], [text]
    while todo:
        part = todo.pop()
        ids = encoding.encode_ordinary(part)
        if len(ids) <= limit or len(part) == 1:
            done.append(part)
            tokens.append(len(ids))
            continue
        raw, at = part.encode(), len(encoding.decode_bytes(ids[: max(1, len(ids) // 2)]))
        cut = at
        while cut and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        if not cut:
            cut = at
            while raw[cut] & 0xC0 == 0x80:
                cut += 1
        todo += [raw[cut:].decode(), raw[:cut].decode()]
    return done, tokens


def halved_counted(text: Column | str, limit: int, ranks: str, pattern: str) -> Column:
    """struct<pieces, tokens>: a text halved until each piece is within ``limit`` tokens (1 at least), and each piece's tokens;
    an empty text is one empty piece, both are null for a null one. Joined in order the pieces are the text.

    The counts are those that the halving ends with, so neither a second Python worker nor a row a piece is needed for them.
    """

    @F.pandas_udf(StructType([StructField("pieces", ArrayType(StringType())), StructField("tokens", ArrayType(IntegerType()))]))
    def pieces(texts: pd.Series) -> pd.DataFrame:
        encoding = _encoding(ranks, pattern)
        cut = [(None, None) if t is None else halves_within(t, max(1, limit), encoding) for t in texts]
        return pd.DataFrame({"pieces": pd.Series([p for p, _ in cut], dtype=object), "tokens": pd.Series([n for _, n in cut], dtype=object)})

    return pieces(text)


def halved(text: Column | str, limit: int, ranks: str, pattern: str) -> Column:
    """array<string>: the pieces of ``halved_counted``; null for a null text."""
    return halved_counted(text, limit, ranks, pattern)["pieces"]
