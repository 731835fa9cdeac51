"""Personal data by fixed patterns and bootstrapped contextual extraction (operator 8), in DataFrame and SQL functions only.

Base kinds are matched by Java patterns that never backtrack over long runs; spans come from splitting the text by the
same pattern, as both walk the same matches, and from running sums of the pieces' lengths. Sums, overlaps and masking cost
n log n steps for n matches. The base spans are the seeds of the method:
1. every identifier-like token (it holds a digit or an @) is an instance; the two words before it are its pattern, where
   words that are identifier-like themselves count as one;
2. pattern and instance scores follow each other over the graph of their pairs: a pattern's score is the share of its
   distinct instances' scores, smoothed toward 0; an instance is a seed (1) or takes one minus the product of its patterns'
   misses. ``rounds`` rounds are grouped sums and equi-joins, partial before their exchange;
3. patterns of at least ``least_seeds`` distinct instances that are seeds or believed by ``least_score``, and of a score of
   ``least_score``, mark their other instances of a similar size as new spans. What one pattern finds supports another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import digest_columns, materialize, small_side

#: Base kinds in order, their patterns, and characters without which none matches.
KINDS = ("email", "ip", "card", "phone", "context")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "text like '%@%'", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "text like '%+%'"}
_TOKEN = r"(?<![^\x20\n\t\r])[^\x20\n\t\r0-9@]*+[0-9@][^\x20\n\t\r]*+"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPANS = "array<struct<s:int,e:int,sb:int,eb:int,v:string,b:string>>"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(a: str, put: str) -> str:
    """Running sums or maxima of an array by doubling: log n passes. put: SQL of x and y together."""
    return f"aggregate(slice(sequence(0, 30), 1, cast(ceil(log2(greatest(1, size({a})))) as int)), {a}, (q, j) -> transform(q, (x, i) -> if(i >= shiftleft(1, j), {put.format(x='x', y='q[i - shiftleft(1, j)]')}, x)))"


_SUM, _MAX = "{x} + {y}", "greatest({x}, {y})"


def _spans(text: str, pattern: str) -> str:
    """array<struct<s, e, sb, eb, v, b>> of all matches: start and end in code points and in bytes, the match, and up to 80
    characters before it."""
    p = _quoted(pattern)
    ends = {c: _running(f"transform(v, (z, i) -> {f}_length(z) + {f}_length(y[i]))", _SUM) for c, f in (("ce", "char"), ("be", "octet"))}
    left = "if(char_length(y[i]) >= 80 or i = 0, right(y[i], 80), right(concat(right(y[i - 1], 80), right(v[i - 1], 80), y[i]), 80))"
    each = f"transform(v, (z, i) -> named_struct('s', ce[i] - char_length(z), 'e', ce[i], 'sb', be[i] - octet_length(z), 'eb', be[i], 'v', z, 'b', {left}))"
    some = _let(f"split({text}, {p}, -1)", "y", _let(ends["ce"], "ce", _let(ends["be"], "be", each)))
    return _let(f"regexp_extract_all({text}, {p}, 0)", "v", f"if(size(v) = 0, cast(array() as {_SPANS}), {some})")


def _overlaps(spans: str, z: str) -> str:
    """Whether z overlaps one of ``spans``: struct of arrays s (starts in order) and e (running maxima of the ends)."""
    at = "lo + shiftleft(1, j)"
    before = f"aggregate(sequence(cast(log2(greatest(1, size({spans}.s))) as int), 0, -1), 0, (lo, j) -> if({at} <= size({spans}.s) and get({spans}.s, {at} - 1) < {z}.e, {at}, lo))"
    return _let(before, "k", f"k > 0 and get({spans}.e, k - 1) > {z}.s")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    """Whether the digits of v pass the Luhn sum: every second one from the right doubled, less 9 beyond 9."""
    d = _digits(v)
    one = "(ascii(c) - 48)"
    return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> if(i % 2 = 0, {one}, if({one} > 4, {one} * 2 - 9, {one} * 2))), 0, (a, y) -> a + y) % 10 = 0"


_FITS = {
    "email": "true",
    "ip": "forall(split(z.v, '[.]'), y -> char_length(ltrim('0', y)) <= 3 and cast(right(concat('000', ltrim('0', y)), 3) as int) <= 255)",
    "card": f"char_length({_digits('z.v')}) between 14 and 19 and {_luhn('z.v')}",
    "phone": f"char_length({_digits('z.v')}) between 10 and 15",
}


def base_spans() -> dict[str, str]:
    """SQL of array<struct<s, e, sb, eb, v, b>> of each base kind over column ``text``; other texts cost one look for a needed character."""
    return {k: f"if({_NEEDS[k]}, filter({_spans('text', p)}, z -> {_FITS[k]}), cast(array() as {_SPANS}))" for k, p in _PATTERNS.items()}


def _joint_base(own: dict[str, str]) -> str:
    """SQL of array<struct<s, e, sb, eb, kind>> of all kinds' spans; own: SQL of each kind's."""
    return "concat(" + ", ".join(f"transform({sql}, z -> named_struct('s', z.s, 'e', z.e, 'sb', z.sb, 'eb', z.eb, 'kind', {i}))" for i, sql in enumerate(own.values())) + ")"


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, base (array of s, e, sb, eb, kind) and seen (identifier-like tokens: s, e, sb, eb, v, left, seed) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = F.expr(f"if(text rlike '[0-9@]', {_spans('text', _TOKEN)}, cast(array() as {_SPANS}))")
    rows = digest_columns(rows).withColumns({**{f"own_{k}": F.expr(sql) for k, sql in base_spans().items()}, "tokens": tokens})
    rows = rows.withColumn("base", F.expr(_joint_base({k: f"own_{k}" for k in _PATTERNS})))
    in_order = "array_sort(transform(base, z -> named_struct('s', z.s, 'e', z.e)))"
    rows = rows.withColumn("taken", F.expr(_let(in_order, "o", f"named_struct('s', o.s, 'e', {_running('o.e', _MAX)})")))
    words = r"lower(regexp_replace(regexp_extract(z.b, r'((?:[^\x20\n\t\r]+[\x20\t]+){1,2})$', 1), r'[\x20\t]+', ' '))"
    left = rf"regexp_replace({words}, r'[^\x20]*[0-9@][^\x20]*', '#')"
    mark = lambda spans, seed: f"transform({spans}, z -> named_struct('s', z.s, 'e', z.e, 'sb', z.sb, 'eb', z.eb, 'v', z.v, 'left', {left}, 'seed', {seed}))"
    others = f"filter(tokens, z -> not {_overlaps('taken', 'z')})"
    seeds = ", ".join(mark(f"own_{k}", "true") for k in _PATTERNS)
    seen = f"filter(concat({seeds}, {mark(others, 'false')}), z -> z.left <> '')"
    return rows.withColumn("seen", F.expr(seen)).select("doc_id", "h1", "h2", "base", "seen")


def _patterns(pairs: DataFrame, rounds: int, least_seeds: int, least_score: float) -> DataFrame:
    """Patterns (left) that are trusted. pairs: distinct (left, v, seed, size)."""
    scored = pairs.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        of_left = scored.groupBy("left").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"))
        of_value = pairs.where("not seed").join(of_left, "left").groupBy("v").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("belief"))
        scored = materialize(pairs.join(of_value, "v", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)))).drop("belief"), "beliefs")
    sure = F.col("score") >= least_score
    trusted = scored.groupBy("left").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.count_if(sure).alias("support"), F.min(F.when(sure, F.col("size"))).alias("low"), F.max(F.when(sure, F.col("size"))).alias("high"))
    return trusted.where((F.col("support") >= least_seeds) & (F.col("trust") >= least_score))


def contextual_spans(found: DataFrame, rounds: int = 2, least_seeds: int = 3, least_score: float = 0.6) -> DataFrame:
    """doc_id, h1, h2 and more (array of s, e, sb, eb, kind) of the rows in which trusted patterns find something new."""
    seen = found.where(F.size("seen") > 0).select("doc_id", "h1", "h2", F.explode("seen").alias("z")).select("doc_id", "h1", "h2", "z.*")
    pairs = seen.groupBy("left", "v").agg(F.bool_or("seed").alias("seed"), F.char_length(F.first("v")).alias("size"))
    trusted = _patterns(materialize(pairs, "pairs"), rounds, least_seeds, least_score)
    near = (F.char_length("v") * 2 >= F.col("low")) & (F.char_length("v") <= F.col("high") * 2)
    new = seen.where("not seed").join(trusted, "left").where(near)
    span = F.struct("s", "e", "sb", "eb", F.lit(len(_PATTERNS)).alias("kind"))
    return new.groupBy("doc_id", "h1", "h2").agg(F.array_sort(F.collect_set(span)).alias("more"))


def _joined(spans: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort(transform({spans}, z -> named_struct('s', z.s, 'kind', z.kind, 'e', z.e))), z -> concat(element_at(array({names}), z.kind + 1), ':', z.s, ':', z.e)), ',')")


def find_pii(docs: DataFrame, **method) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans.

    ``docs`` needs doc_id and text; other columns are ignored. Spans are kind:start:end in code points. A null text counts
    as empty: no spans, the digest of nothing. Rows that repeat a doc_id with the same text get the same spans each. A
    null doc_id is kept. Equal spans of two kinds both stay. Very long texts are handled whole. An empty table gives an
    empty result. ``method``: see contextual_spans.
    """
    found = materialize(_found(docs), "found")
    more = materialize(contextual_spans(found, **method), "more").select(F.col("doc_id").alias("d"), F.col("h1").alias("a"), F.col("h2").alias("b"), "more")
    rows = found.join(more, found["doc_id"].eqNullSafe(more["d"]) & (found["h1"] == more["a"]) & (found["h2"] == more["b"]), "left")
    rows = rows.withColumn("more", F.coalesce("more", F.expr("cast(array() as array<struct<s:int,e:int,sb:int,eb:int,kind:int>>)")))
    count = lambda spans, i: F.expr(f"cast(size(filter({spans}, z -> z.kind = {i})) as long)")
    return rows.select("doc_id", *(count("base", i).alias(f"n_{k}") for i, k in enumerate(_PATTERNS)), count("more", len(_PATTERNS)).alias("n_context"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("concat(base, more)").alias("spans"))


def mask_pii(docs: DataFrame, **method) -> DataFrame:
    """``docs`` with every span of find_pii in ``text`` replaced by its kind in brackets; overlapping spans merge under the
    first one's kind. All other columns stay, whatever their names, and a column n_chars follows the new text where that
    changed. Null texts stay null; repeated rows and a null doc_id are kept. An empty table gives an empty result."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    more = contextual_spans(materialize(_found(docs), "found"), **method)
    more = small_side(more.select(F.col("doc_id").alias("d"), F.col("h1").alias("a"), F.col("h2").alias("b"), "more"), "more")
    # the given row travels in one column, so no name of it can clash with those made here
    rows = digest_columns(docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.join(more, rows["doc_id"].eqNullSafe(more["d"]) & (rows["h1"] == more["a"]) & (rows["h2"] == more["b"]), "left")
    none = "cast(array() as array<struct<s:int,e:int,sb:int,eb:int,kind:int>>)"
    spans = f"array_sort(transform(concat({_joint_base(base_spans())}, coalesce(more, {none})), z -> named_struct('s', z.sb, 'e', z.eb, 'kind', z.kind)))"
    rows = rows.withColumn("spans", F.expr(spans)).select("row", "text", "spans")
    labels = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    cut = lambda begin, length: f"cast(substring(raw, {begin} + 1, {length}) as string)"
    label = f"element_at(array({labels}), z.kind + 1)"
    each = f"if(i = 0, concat({cut('0', 'z.s')}, {label}), if(z.s >= get(ends, i - 1), concat({cut('get(ends, i - 1)', 'z.s - get(ends, i - 1)')}, {label}), ''))"
    whole = f"concat(array_join(transform(spans, (z, i) -> {each}), ''), {cut('get(ends, size(ends) - 1)', 'octet_length(text)')})"
    masked = _let("cast(text as binary)", "raw", _let(_running("spans.e", _MAX), "ends", whole))
    rows = rows.withColumn("masked", F.expr(f"if(size(spans) = 0, row.text, {masked})"))
    new = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.char_length("masked").cast("long")).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("masked")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
