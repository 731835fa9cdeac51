"""Document fingerprints by invertible Bloom lookup sketches (operator 7), in DataFrame and SQL functions only.

A text's units are its paragraphs (lines, cut every ``UNIT`` characters), each a 64-bit digest. Digests are dealt to pages of
about six, and each page is a small sketch: three sub-tables of cells with count, XOR of digests and XOR of check sums.
Sketches of two versions subtract cell by cell; peeling (take a cell that holds one digest, remove it from its three
cells, again) recovers the digests that differ. A page whose peeling fails is retried with larger tables. Likeness is
shared digests over all digests, from what peeling recovered; a page that no retry opens is compared digest by digest.
Digests are split into pages bit by bit, so a text of n units costs n log n steps.

The edited text needs the next document. Rows are dealt by ranges of doc_id, whose bounds are quantiles of the ids that
are there, and the first document of each range is sent to the range before too, so one exchange of the texts does for
any number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Characters of a unit at most; cells of a sub-table at first and in the retries; rows of a range; the most ranges.
UNIT, CELLS, RETRIES, RANGE_ROWS, MOST_RANGES = 256, 16, (64, 1024), 1024, 1 << 16
_ROUNDS = 40


def _check(x: str) -> str:
    return f"(xxhash64({x}) & 4294967295L)"


def _places(keys: str, key: str, count: str, cells: int) -> str:
    """Each digest with its count, its check sum and its cell in each of the three sub-tables."""
    three = ", ".join(f"'p{j}', cast(shiftrightunsigned({key}, {12 * j}) & {cells - 1}L as int)" for j in range(3))
    return f"transform({keys}, z -> named_struct('c', {count}, 'k', {key}, 'h', {_check(key)}, {three}))"


_PUT = "named_struct('c', a.c + e.c, 'k', a.k ^ e.k, 'h', a.h ^ e.h)"


def _build(digests: str, cells: int) -> str:
    cell = f"aggregate(b, named_struct('c', 0, 'k', 0L, 'h', 0L), (a, e) -> if(e.p{{j}} = i, {_PUT}, a))"
    tables = ", ".join(f"transform(sequence(0, {cells - 1}), i -> {cell.format(j=j)})" for j in range(3))
    return f"element_at(transform(array({_places(digests, 'z', '1', cells)}), b -> concat({tables})), 1)"


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, r) -> named_struct('c', p.c - r.c, 'k', p.k ^ r.k, 'h', p.h ^ r.h))"


def _peel(sketch: str, cells: int) -> str:
    """Number of digests recovered from a difference; null when cells are left that peeling can't open."""
    pure = f"array_distinct(transform(filter(s.cells, z -> (z.c = 1 or z.c = -1) and z.h = {_check('z.k')}), z -> named_struct('c', z.c, 'k', z.k)))"
    gone = ", ".join(f"transform(slice(s.cells, {1 + j * cells}, {cells}), (y, i) -> aggregate(b, y, (a, e) -> if(e.p{j} = i, {_PUT}, a)))" for j in range(3))
    removed = f"element_at(transform(array({_places('p', 'z.k', '(0 - z.c)', cells)}), b -> concat({gone})), 1)"
    step = f"element_at(transform(array({pure}), p -> if(size(p) = 0, named_struct('cells', s.cells, 'n', s.n, 'live', false), named_struct('cells', {removed}, 'n', s.n + size(p), 'live', true))), 1)"
    done = "s -> if(forall(s.cells, z -> z.c = 0 and z.k = 0L and z.h = 0L), s.n, cast(null as int))"
    return f"aggregate(sequence(1, {_ROUNDS}), named_struct('cells', {sketch}, 'n', 0, 'live', true), (s, i) -> if(s.live, {step}, s), {done})"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _bits(digests: str) -> str:
    """log2 of the pages of a text: 3 to 6 digests a page on average."""
    return f"cast(greatest(0, ceil(log2(greatest(1, size({digests})) / 6D))) as int)"


def paged(digests: str, bits: str) -> str:
    """Digests in 2**bits pages by their first bits, split by one bit after the other."""
    half = "filter(p, x -> (shiftrightunsigned(x, 64 - j) & 1L) = {i}L)"
    return f"aggregate(slice(sequence(1, 40), 1, {bits}), array({digests}), (a, j) -> flatten(transform(a, p -> array({half.format(i=0)}, {half.format(i=1)}))))"


def units(text: str) -> str:
    return f"array_distinct(transform(regexp_extract_all({text}, '[^\\n]{{1,{UNIT}}}', 0), x -> xxhash64(x)))"


def pages(text: str) -> str:
    """Digests of a text's units by page."""
    return _let(units(text), "d", paged("d", _bits("d")))


def sketch(pages: str) -> str:
    return f"transform({pages}, d -> {_build('d', CELLS)})"


def written(pages: str) -> str:
    """A fingerprint as a string: the number of pages, then each cell as count.digests.checks (empty: nothing)."""
    return f"concat(size({pages}), ':', array_join(transform(flatten({pages}), z -> if(z.c = 0 and z.k = 0L, '', concat_ws('.', z.c, hex(z.k), hex(z.h)))), ','))"


def likeness(u: str, v: str, s: str, t: str) -> str:
    """Shared digests over all digests of two texts with pages u, v and sketches s, t (0 to 1; two empty texts: 1).

    Sketches of different numbers of pages don't subtract, so the pages of both are then made anew at the larger number.
    """
    n = f"greatest(size({s}), size({t}))"
    again = lambda x: f"if(size({x}) = {n}, {x}, {paged(f'flatten({x})', f'cast(round(log2({n})) as int)')})"
    anew = [_subtract(_let("pu[g]", "d", _build("d", c)), _let("pv[g]", "d", _build("d", c))) for c in (CELLS, *RETRIES)]
    first = f"if(size({s}) = size({t}), {_subtract(f'{s}[g]', f'{t}[g]')}, {anew[0]})"
    tries = [_peel(x, c) for x, c in zip((first, *anew[1:]), (CELLS, *RETRIES), strict=True)]
    last = "size(array_except(pu[g], pv[g])) + size(array_except(pv[g], pu[g]))"
    differ = f"aggregate(transform(sequence(0, {n} - 1), g -> coalesce({', '.join(tries)}, {last})), 0, (a, x) -> a + x)"
    both = "(size(flatten(pu)) + size(flatten(pv)))"
    share = _let(differ, "d", _let(both, "b", "if(b = 0, 1D, (b - d) / cast(b + d as double))"))
    return _let(again(u), "pu", _let(again(v), "pv", share))


_KEY = ("known", "doc_id", "h")


def _bounds(base: DataFrame, ranges: int) -> list[tuple[bool, int, int]]:
    """Keys that cut the table into ranges of about equal rows: at most ``ranges`` rows, from an exchange of the keys alone."""
    keys = base.select(*_KEY).repartitionByRange(ranges, *_KEY)
    least = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*_KEY)).alias("k")).select("k.*").collect()
    return sorted((r["known"], r["doc_id"] if r["known"] else 0, r["h"]) for r in least)[1:]


def _range(bounds: list[tuple[bool, int, int]]) -> str:
    """Number of bounds that are at most the row's key, by binary search in constant arrays."""
    if not bounds:
        return "0"
    known, ids, hashes = (f"cast(split('{','.join(str(x).lower() for x in column)}', ',') as array<{kind}>)" for column, kind in zip(zip(*bounds, strict=True), ("boolean", "bigint", "bigint"), strict=True))
    at = "lo + shiftleft(1, j)"
    bound = f"named_struct('a', get({known}, {at} - 1), 'b', get({ids}, {at} - 1), 'c', get({hashes}, {at} - 1))"
    own = "named_struct('a', known, 'b', coalesce(doc_id, 0L), 'c', h)"
    return f"aggregate(sequence({len(bounds).bit_length() - 1}, 0, -1), 0, (lo, j) -> if({at} <= {len(bounds)} and {bound} <= {own}, {at}, lo))"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and following (the text of the next document by doc_id, the first after the last), range and turn."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"known": F.col("doc_id").isNotNull(), "h": F.xxhash64("text")})
    ranges = max(1, min(MOST_RANGES, docs.count() // RANGE_ROWS))
    base = base.withColumn("range", F.expr(_range(_bounds(base, ranges) if ranges > 1 else [])))
    # at most MOST_RANGES rows
    firsts = base.groupBy("range").agg(F.min(F.struct(*_KEY)).alias("first"))
    along = Window.orderBy("range")
    firsts = firsts.select("range", "first", F.lag("range").over(along).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    to = firsts.select("first", F.coalesce("before", "last").alias("also"))
    rows = base.join(F.broadcast(to), (base["h"] == to["first.h"]) & base["doc_id"].eqNullSafe(to["first.doc_id"]), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("turn"))
    ghost = F.struct(F.col("also").alias("range"), F.lit(1).alias("turn"))
    at = F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("at")
    rows = rows.select("doc_id", "h", "text", at).select("doc_id", "h", "text", "at.range", "at.turn")
    return rows.withColumn("following", F.lead("text").over(_order()))


def _order() -> WindowSpec:
    return Window.partitionBy("range").orderBy("turn", F.col("doc_id").asc_nulls_first(), "h", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty; two
    texts without units have likeness 1. Documents come by ascending doc_id, nulls first, and rows that repeat a doc_id by
    a hash of the text, so such rows are dealt over ranges too (but for exact repeats). Any ids do, however far apart. A
    table of one row is its own next document. Very long texts are handled whole. An empty table gives an empty result.
    """
    rows = with_next(docs).withColumn("n", F.char_length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - half).cast("int")), F.substring("following", F.lit(1), half))
    rows = rows.withColumn("u", F.expr(pages("text"))).withColumn("s", F.expr(sketch("u")))
    rows = rows.withColumns({"v": F.lead("u").over(_order()), "t": F.lead("s").over(_order())}).where("turn = 0")
    rows = rows.withColumn("edited", edited).select("doc_id", "n", "u", "s", "v", "t", "edited").withColumn("w", F.expr(pages("edited"))).withColumn("r", F.expr(sketch("w")))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.expr(written("s")).alias("fingerprint"),
        F.expr(written("r")).alias("edited_fingerprint"),
        F.expr(likeness("u", "w", "s", "r")).alias("near_edited"),
        F.expr(likeness("u", "v", "s", "t")).alias("near_next"),
    )
