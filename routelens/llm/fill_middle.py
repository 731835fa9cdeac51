"""Fill-in-middle transformation by a parallel automaton scan (operator 12).

A token is a run of white space with the run of other characters after it, or white space at the end of a text. Over code
points this is an automaton of three states: START, SPACE (in white space) and WORD; a token begins where the automaton
leaves START and where it goes from WORD to SPACE. A chunk of a text is a function of the state in which it is entered: for
each entry state it has an exit state and a number of tokens begun. Composition of such functions is associative, so a
prefix scan over a document's chunks gives each chunk's entry state and the tokens before it, whatever order chunks were
read in.

A document of one chunk is scanned, cut and written in its own task, without an exchange. Longer ones are dealt out chunk by
chunk: each chunk emits its function, the scan composes a document's functions (a few numbers a chunk), the chunks that hold
the two cuts are selected by token number, and only those are scanned again for the places. No text is scanned as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, chunks, materialize, text_bytes

START, SPACE, WORD = range(3)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a chunk.
CHUNK = 1 << 16

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Tokens begun by the first character of a chunk: by entry state, for a word's character and for white space.
_BEGINS = np.array([[1, 1], [0, 0], [0, 1]], np.int64)
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def chunk_function(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exit state, tokens begun) for each of the three entry states; an empty chunk leaves the state as it is."""
    if not len(data):
        return np.arange(3), np.zeros(3, np.int64)
    space = _IS_SPACE[data]
    inner = np.count_nonzero(space[1:] & ~space[:-1])
    return np.full(3, SPACE if space[-1] else WORD), inner + _BEGINS[:, int(space[0])]


def compose(exits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of chunk functions (rows) by doubling: row i becomes the function of chunks 0 to i."""
    exits, counts, step = exits.copy(), counts.copy(), 1
    while step < len(exits):
        first, then = exits[:-step], exits[step:]
        counts[step:] = counts[:-step] + np.take_along_axis(counts[step:], first, 1)
        exits[step:] = np.take_along_axis(then, first, 1)
        step *= 2
    return exits, counts


def token_starts(data: np.ndarray, state: int) -> np.ndarray:
    """Byte places at which tokens begin in a chunk entered in ``state``."""
    space = _IS_SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    if len(data):
        begins[0] = bool(_BEGINS[state, int(space[0])])
    return np.flatnonzero(begins)


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the sha256 of ``seed:doc_id``; a null id is written null."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def chosen_form(h: tuple[int, int, int, int], plain: bool, rate: int, spm: int) -> str:
    return "plain" if plain or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"


def chosen_cuts(h: tuple[int, int, int, int], n: int) -> tuple[int, int]:
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b)


def _arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return (p + prefix + s + suffix if form == "psm" else s + suffix + p + prefix) + m + middle


def _whole(seed: int, rate: int, spm: int):
    """Rows (doc_id, text) of one chunk each to finished rows."""
    markers = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                first = int(offsets[i])
                block = data[first : int(offsets[j])]
                space, bounds = _IS_SPACE[block], offsets[i : j + 1] - first
                begins = np.zeros(len(block), bool)
                begins[1:] = space[1:] & ~space[:-1]
                begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
                starts = np.flatnonzero(begins)
                base = np.searchsorted(starts, bounds)
                out: list[list] = [[], [], [], [], [], []]
                for r in range(j - i):
                    text, n = block[bounds[r] : bounds[r + 1]], int(base[r + 1] - base[r])
                    whole = text.tobytes()
                    h = draws(ids[i + r], seed)
                    form, before, middle, output = chosen_form(h, not n or any(x in whole for x in markers), rate, spm), None, None, whole
                    if form != "plain":
                        a, b = (int(starts[base[r] + x] - bounds[r]) if x < n else len(text) for x in chosen_cuts(h, n))
                        before, middle = code_points(text[:a]), code_points(text[a:b])
                        output = _arranged(form, whole[:a], whole[a:b], whole[b:])
                    for column, x in zip(out, (ids[i + r], n, form, before, middle, output.decode()), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

    return rows


def _split(size: int):
    """Rows (key, doc_id, text) to a row for each chunk of ``size`` code points: key, doc_id, c, plain, chunk."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int32()), ("marked", pa.bool_()), ("chunk", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                marked = any(x in text for x in (PREFIX, SUFFIX, MIDDLE))
                for c in range(-(-len(text) // size)):
                    yield pa.RecordBatch.from_pylist([{"key": key, "doc_id": doc, "c": c, "marked": marked, "chunk": text[c * size : (c + 1) * size].encode()}], schema=schema)

    return rows


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's function and code points."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int32()), ("marked", pa.bool_()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("chars", pa.int64())])
    for b in batches:
        data, offsets = text_bytes(b.column(4))
        parts = [data[offsets[i] : offsets[i + 1]] for i in range(len(b))]
        functions = [chunk_function(x) for x in parts]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array([f[0].tolist() for f in functions], schema.field("exits").type), pa.array([f[1].tolist() for f in functions], schema.field("counts").type), pa.array([code_points(x) for x in parts], pa.int64())], schema=schema
        )


def _selection(seed: int, rate: int, spm: int):
    """A document's chunk functions to the chunks that hold its cuts: which cut, c, the chunk's entry state, the token wanted
    in it (null: the text's end), and the code points before it."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("cut", pa.int32()), ("c", pa.int32()), ("state", pa.int32()), ("token", pa.int64()), ("before", pa.int64())])

    def select(table: pa.Table) -> pa.Table:
        table = table.sort_by("c")
        exits, counts = (np.array(table.column(x).to_pylist(), np.int64) for x in ("exits", "counts"))
        exits, counts = compose(exits, counts)
        chars = np.concatenate(([0], np.cumsum(table.column("chars").to_numpy())))
        state, before = np.concatenate(([START], exits[:-1, START])), np.concatenate(([0], counts[:, START]))
        key, n, h = table.column("key")[0].as_py(), int(before[-1]), draws(table.column("doc_id")[0].as_py(), seed)
        form = chosen_form(h, table.column("marked")[0].as_py(), rate, spm)
        out = []
        for cut, x in enumerate(chosen_cuts(h, n) if form != "plain" else (n,)):
            c = int(np.searchsorted(before, x, "right")) - 1 if x < n else len(state) - 1
            out.append({"key": key, "n": n, "form": form, "cut": cut, "c": c, "state": int(state[c]), "token": int(x - before[c]) if x < n else None, "before": int(chars[c] if x < n else chars[-1])})
        return pa.Table.from_pylist(out, schema=schema)

    return select


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Selected chunks to the code points before each cut."""
    for b in batches:
        data, offsets = text_bytes(b.column(7))
        state, token, before = (b.column(i).to_pylist() for i in (4, 5, 6))
        place = []
        for i in range(len(b)):
            part = data[offsets[i] : offsets[i + 1]]
            place.append(before[i] if token[i] is None else before[i] + code_points(part[: token_starts(part, state[i])[token[i]]]))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(place, pa.int64())], ["key", "n", "form", "cut", "place"])


def _giants(docs: DataFrame, seed: int, rate: int, spm: int, chunk: int) -> DataFrame | None:
    """Finished rows of the documents of several chunks; None if there are none."""
    long = materialize(docs.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "giants")
    if not long.limit(1).count():
        return None
    parts = materialize(long.mapInArrow(_split(chunk), "key long, doc_id long, c int, marked boolean, chunk binary").repartition("key", "c"), "chunks")
    functions = parts.mapInArrow(_functions, "key long, doc_id long, c int, marked boolean, exits array<int>, counts array<long>, chars long")
    wanted = functions.groupBy("key").applyInArrow(_selection(seed, rate, spm), "key long, n long, form string, cut int, c int, state int, token long, before long")
    held = wanted.join(parts.select("key", "c", "chunk"), ["key", "c"]).select("key", "n", "form", "cut", "state", "token", "before", "chunk")
    cuts = held.mapInArrow(_places, "key long, n long, form string, cut int, place long").groupBy("key").agg(F.min("n").alias("n"), F.min("form").alias("form"), F.min("place").alias("a"), F.max("place").alias("b"))
    got = long.join(cuts, "key")
    prefix, middle, suffix = F.expr("substring(text, 1, int(a))"), F.expr("substring(text, int(a + 1), int(b - a))"), F.expr("substring(text, int(b + 1))")
    marker = {x: F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    psm = F.concat(marker[PREFIX], prefix, marker[SUFFIX], suffix, marker[MIDDLE], middle)
    spm_ = F.concat(marker[SUFFIX], suffix, marker[PREFIX], prefix, marker[MIDDLE], middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    cut = F.col("form") != "plain"
    return got.select("doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n (tokens), form, prefix_chars, middle_chars (code points; null if plain), output (the new text).

    ``rate`` percent of documents are cut in three, ``spm`` percent of those put the suffix first; draws come from the sha256
    of seed and doc_id alone, so equal ids are cut by the same draws. ``docs`` needs doc_id and text; other columns are
    ignored, whatever their names. A null text is empty; empty texts and texts that hold a marker stay plain. A null doc_id
    draws by the word null. Repeated rows each get a row. Texts of any length are handled whole, those over ``chunk`` code
    points in parallel; ``chunk`` never changes a result. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = docs.where(F.length("text") <= chunk).mapInArrow(_whole(seed, rate, spm), _DDL)
    long = _giants(docs, seed, rate, spm, chunk)
    return out if long is None else out.unionByName(long)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which ``fill_in_middle`` made ``output``."""
    p, s, m = (f"locate('{x}', {output})" for x in (PREFIX, SUFFIX, MIDDLE))
    width = {x: len(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    psm = f"concat(substring({output}, {width[PREFIX] + 1}, {s} - {width[PREFIX] + 1}), substring({output}, {m} + {width[MIDDLE]}), substring({output}, {s} + {width[SUFFIX]}, {m} - {s} - {width[SUFFIX]}))"
    spm = f"concat(substring({output}, {p} + {width[PREFIX]}, {m} - {p} - {width[PREFIX]}), substring({output}, {m} + {width[MIDDLE]}), substring({output}, {width[SUFFIX] + 1}, {p} - {width[SUFFIX] + 1}))"
    return F.expr(f"case {form} when 'plain' then {output} when 'psm' then {psm} else {spm} end")
