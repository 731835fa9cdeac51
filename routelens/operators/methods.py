"""Methods in tables of source files: location by signature, the file that holds one, and edits matched to functions.

Sources are read once, each in its own row; what is joined and exchanged are names, keys and places, never texts (but for the
methods among which a search block has to find its file, once each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import patches as P
from routelens.functions.java import java_methods
from routelens.operators.shared import written

#: Lengths of the pieces by which signatures are found in each other: each signature uses the longest that fits it.
PIECES = (16, 8, 4, 2, 1)
#: Ids that a group's array holds about at most, and ids of a run in which edits meet functions. Parquet packs 504 values behind one
#: header, so runs of that length repeat byte for byte.
GROUP, RUN = 16_384, 504


def method_table(files: DataFrame) -> DataFrame:
    """Per method of each source: path, place (from 0, outer methods first), name, key, signature, first_line, last_line, begin, end.

    ``files`` needs path and source; other columns are ignored. Null and empty sources have no methods; repeated rows repeat theirs.
    """
    found = files.select("path", F.posexplode(java_methods("source")).alias("place", "m"))
    return found.select("path", "place", "m.*")


def locate_methods(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted method: id, path, found, first_line, last_line, signature (as declared), begin, end.

    ``wanted`` needs id, path and signature: name and simple parameter types must agree; modifiers, generics, parameter names
    and packages don't count. Of several such methods in a file the first one is taken. Unknown paths, methods that aren't
    there, signatures without parentheses and null ones aren't found. Repeated ids with other signatures or paths get a row each.
    """
    table = method_table(files)
    first = table.groupBy("path", "key").agg(F.min_by(F.struct("first_line", "last_line", "signature", "begin", "end"), "place").alias("m"))
    asked = wanted.select("id", "path", P.signature_key("signature").alias("key"))
    got = asked.join(first, ["path", "key"], "left")
    return got.select("id", "path", F.col("m").isNotNull().alias("found"), "m.first_line", "m.last_line", "m.signature", "m.begin", "m.end")


def source_file_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted method: id, path of the file that holds it, candidates (files that do), chosen ("only", "block" or "first").

    ``files`` needs repo, path and source; ``wanted`` id, repo, signature and block. A posting table of method keys gives the
    files of a signature. Where several hold it, the first (by path) whose method has the block's lines is taken, or the first
    at all when none has or the block is null. Methods that no file holds give a null path and 0 candidates.

    No wanted method meets its candidates: they are counted by signature, and a block's first file comes from an index of the
    methods' runs of code lines, as long as the blocks that are asked for. Texts are exchanged once, a method each.
    """
    held = ["repo", "key"]
    table = files.select("repo", "path", "source", F.explode(java_methods("source")).alias("m"))
    method = table.select("repo", "path", F.col("m.key").alias("key"), F.col("m.begin").alias("begin"), F.expr("substring(source, m.begin + 1, m.end - m.begin)").alias("text"))
    posting = written(method.groupBy("repo", "key", "path").agg(F.min_by("text", "begin").alias("text")), "methods")  # lexed once
    counts = posting.groupBy(held).agg(F.count("path").alias("candidates"), F.min("path").alias("first"))
    asked = wanted.select("id", "repo", P.signature_key("signature").alias("key"), "block").distinct()

    blocks = asked.where("block is not null").select("repo", "key", "block").distinct().withColumn("lines", P.code_lines("block"))
    blocks = blocks.where(F.size("lines") > 0).select("repo", "key", "block", F.size("lines").alias("n"), _run(F.col("lines")).alias("run"))
    lengths = blocks.select("repo", "key", "n").distinct()
    several = posting.join(counts.where("candidates > 1").select(held), held, "left_semi").withColumn("lines", P.code_lines("text"))
    fits = several.select("repo", "key", "path", "lines").join(lengths, held).where(F.size("lines") >= F.col("n"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("lines") - F.col("n") + 1), lambda i: _run(F.slice("lines", i, F.col("n")))))
    index = fits.select("repo", "key", "path", "n", F.explode(runs).alias("run")).groupBy("repo", "key", "n", "run").agg(F.min("path").alias("by_block"))
    placed = blocks.join(index, [*held, "n", "run"]).select("repo", "key", "block", "by_block")

    got = asked.join(counts, held, "left").join(placed, [*held, "block"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    chosen = F.when(F.col("candidates") == 1, "only").when(F.col("by_block").isNotNull(), "block").when(F.col("candidates") > 1, "first")
    return got.select("id", F.coalesce("by_block", "first").alias("path"), "candidates", chosen.alias("chosen"))


def _run(lines: Column) -> Column:
    """What stands for a run of lines: the hash of their text."""
    return F.sha2(F.array_join(lines, "\n"), 256)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _pieces(c: str, size: Column) -> Column:
    """The distinct pieces of that length."""
    return F.expr(f"array_distinct(transform(sequence(1, greatest(1, length({c}) - {size} + 1)), i -> substring({c}, i, {size})))")


def _grouped(ids: DataFrame, held: list[str], name: str) -> DataFrame:
    """Per group of about GROUP ids at most that have the same ``held``: these, deal (the group's number), ids (sorted, a null one last)."""
    counted = ids.groupBy(held).agg(F.count("*").alias("n"))
    dealt = ids.join(counted, held).withColumn("deal", F.expr(f"pmod(xxhash64({name}), ceil(n / {GROUP}))"))
    none = F.array(F.lit(None).cast(ids.schema[name].dataType))
    found = F.array_sort(F.collect_list(name))
    return dealt.groupBy(*held, "deal").agg(F.when(F.bool_or(F.col(name).isNull()), F.concat(found, none)).otherwise(found).alias("ids"))


def match_edits(functions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, function_id, edit_id of each edit that belongs to a function; case_id, unassigned: cases with edits left over).

    ``functions`` needs case_id, function_id and signature, ``edits`` case_id, edit_id and text, which begins with ### and a
    signature. An edit belongs to the functions of its case whose signature, without white space, lies in the edit's. Null
    signatures and edits without one belong to nothing; an empty function signature lies in all of its case.

    No function is compared with all edits: of a signature's pieces the rarest among the case's edits (counted exactly) is
    looked up in an index of the edits' pieces, and only what it finds is compared. A piece that no edit has rules a function out.
    Equal signatures and equal edits of a case are compared once; the pairs of their ids come from the last join, which is
    not exchanged again. There are as many as the product of the copies, so they must be small where they are stored: edits are
    cut in runs of RUN ids, and each function in turn meets a whole run, always in the same order. The runs deal out the work.
    """
    f = functions.where("signature is not null and case_id is not null").select("case_id", "function_id", _bare(F.col("signature")).alias("f"))
    head = F.regexp_extract("text", r"\A###([^\n]+)", 1)
    e = edits.where("case_id is not null").select("case_id", "edit_id", F.when(F.trim(head) != "", _bare(head)).alias("e"))
    # an id's signatures, one or several: what has the same ones is one class
    f_ids = f.groupBy("case_id", "function_id").agg(F.array_sort(F.collect_set("f")).alias("fs"))
    e_ids = e.where("e is not null").groupBy("case_id", "edit_id").agg(F.array_sort(F.collect_set("e")).alias("es"))
    f_classes, e_classes = f_ids.select("case_id", "fs").distinct(), e_ids.select("case_id", "es").distinct()
    of_f, of_e = f_classes.select("case_id", "fs", F.explode("fs").alias("f")), e_classes.select("case_id", "es", F.explode("es").alias("e"))
    size = F.element_at(F.filter(F.array(*map(F.lit, PIECES)), lambda x: x <= F.length("f")), 1)
    f_one = of_f.select("case_id", "f").distinct().withColumn("size", F.when(F.length("f") > 0, size))
    e_one = of_e.select("case_id", "e").distinct()
    sizes = f_one.where("size is not null").select("case_id", "size").distinct()
    index = e_one.join(sizes, "case_id").where("length(e) >= size").select("case_id", "e", "size", F.explode(_pieces("e", "size")).alias("piece"))
    counts = index.groupBy("case_id", "piece").agg(F.count("*").alias("c"))
    asked = f_one.where("size is not null").select("case_id", "f", F.explode(_pieces("f", "size")).alias("piece"))
    held = asked.join(counts, ["case_id", "piece"], "left").groupBy("case_id", "f").agg(F.min_by("piece", F.struct(F.coalesce("c", F.lit(0)), "piece")).alias("piece"), F.min(F.coalesce("c", F.lit(0))).alias("c"))
    met = held.where("c > 0").join(index.select("case_id", "piece", "e"), ["case_id", "piece"]).where(F.contains("e", "f")).select("case_id", "f", "e")
    whole = f_one.where("size is null").select("case_id", "f").join(e_one, "case_id")
    classes = met.unionByName(whole).join(of_f, ["case_id", "f"]).join(of_e, ["case_id", "e"]).select("case_id", "fs", "es").distinct()
    cut = F.expr(f"transform(sequence(0, (size(ids) - 1) div {RUN}), i -> slice(ids, i * {RUN} + 1, {RUN}))")
    runs = _grouped(e_ids, ["case_id", "es"], "edit_id").select("case_id", "es", "deal", F.posexplode(cut).alias("run", "edits"))
    groups = _grouped(f_ids, ["case_id", "fs"], "function_id").select("case_id", "fs", F.col("ids").alias("functions"))
    key, n = ["case_id", "es", "deal", "run"], int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many tasks as partitions are set: what they read is small, what they give isn't
    asking = groups.join(classes, ["case_id", "fs"]).join(runs.select(key), ["case_id", "es"]).select(*key, "functions").repartition(n, *key)
    answers = runs.repartition(n, *key).select(*key, F.explode("edits").alias("edit_id")).hint("shuffle_hash")
    pairs = asking.select(*key, F.explode("functions").alias("function_id")).join(answers, key).select("case_id", "function_id", "edit_id")
    taken = classes.select("case_id", "es").distinct().join(e_ids, ["case_id", "es"]).select("case_id", "edit_id")
    left = e.select("case_id", "edit_id").join(taken, ["case_id", "edit_id"], "left_anti")
    return pairs, left.groupBy("case_id").agg(F.count("*").alias("unassigned"))
