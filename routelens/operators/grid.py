"""The experiment grid as one dataflow: clusterings, samples, votes and metrics of every cell.

Cells share work as their keys allow: a clustering is fitted once for all that sample it, and a sampler runs once for its
largest number of representatives, as its first picks are those of a smaller number. Votes and metrics of all cells are one
grouped aggregation each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.operators import cluster, sample
from routelens.operators.shared import written

CELL = ("algorithm", "k", "sampler", "reps", "voting")
#: Numbers of clusters that one clustering may have; keeps the clusters of all apart under one key.
MOST_CLUSTERS = 1_000_000


def clusterings(vectors: DataFrame, algorithms: list[str], ks: list[int], seed: int = 42) -> DataFrame:
    """algorithm, k, id, cluster_id of every clustering: "kmeans", "bisecting" and "hierarchical" (two levels of about the
    square root of k each) for each k, or "given", the label that the vectors bring, once."""
    parts = []
    for algorithm in algorithms:
        for k in [0] if algorithm == "given" else ks:
            if algorithm == "given":
                rows = vectors.select("vec_id", F.col("label").alias("cluster_id"))
            elif algorithm == "hierarchical":
                side = max(1, round(k**0.5))
                rows = cluster.hierarchical_kmeans(vectors, [side, max(1, k // side)])
                rows = rows.withColumn("cluster_id", F.split("path", "/")[1].cast("int") * 1000 + F.split("path", "/")[2].cast("int"))
            else:
                rows = {"kmeans": cluster.kmeans, "bisecting": cluster.bisecting}[algorithm](vectors, k, seed=seed)
            parts.append(rows.select(F.lit(algorithm).alias("algorithm"), F.lit(k).alias("k"), F.col("vec_id").cast("long").alias("id"), F.col("cluster_id").cast("long").alias("cluster_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def samples(vectors: DataFrame, assigned: DataFrame, samplers: list[str], most: int) -> DataFrame:
    """algorithm, k, sampler, cluster_id, rank, id: up to ``most`` representatives of each cluster of each clustering."""
    found = [tuple(r) for r in assigned.select("algorithm", "k").distinct().orderBy("algorithm", "k").collect()]  # one row a clustering
    names = assigned.sparkSession.createDataFrame([(a, k, i) for i, (a, k) in enumerate(found)], "algorithm string, k int, place long")
    key = (F.col("place") * MOST_CLUSTERS + F.col("cluster_id")).alias("key")
    rows = assigned.join(F.broadcast(names), ["algorithm", "k"]).select(key, "id").join(vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding"), "id")
    rows = written(rows, "members")  # each sampler reads it several times
    out = None
    for sampler in samplers:
        part = sample.representatives(rows, most, sampler, "key", "id").select(F.lit(sampler).alias("sampler"), F.floor(F.col("cluster_id") / MOST_CLUSTERS).alias("place"), (F.col("cluster_id") % MOST_CLUSTERS).alias("cluster_id"), "rank", "id")
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(names), "place").select("algorithm", "k", "sampler", "cluster_id", "rank", "id")


def _chosen() -> Column:
    """The vote of a cluster: by majority or by mean score (lower is better); ties of votes go by the means, then to edit."""
    by_mean = F.when(F.col("mean_e").isNotNull() & (F.col("mean_g").isNull() | (F.round("mean_e", 9) <= F.round("mean_g", 9))), "edit").when(F.col("mean_g").isNotNull(), "gen").otherwise("edit")
    by_votes = F.when(F.col("edit_votes") > F.col("gen_votes"), "edit").when(F.col("gen_votes") > F.col("edit_votes"), "gen").otherwise(by_mean)
    return F.when(F.col("voting") == "majority", by_votes).otherwise(by_mean)


def run_grid(vectors: DataFrame, scores: DataFrame, algorithms: list[str], ks: list[int], samplers: list[str], reps: list[int], votings: list[str], seed: int = 42) -> DataFrame:
    """Per cell: its parameters and key, clusters, total (items with both scores), wins, win_rate, mean_score and oracle_score.

    ``vectors`` needs vec_id and embedding (and label for "given"), ``scores`` slug, e and g. Samplers are "farthest_first" and
    "kdpp", votings "majority" and "mean_score". A representative votes for the strategy of the lower score (e on a tie, what
    there is if one is missing, not at all without both). Each cluster's items take the strategy that its vote chose; it wins
    where no other would score lower. Null vectors and items without a vector take no part; ids must not repeat.
    """
    v = vectors.where("vec_id is not null and embedding is not null")
    assigned = written(clusterings(v, algorithms, ks, seed), "clusterings")
    picked = written(samples(v, assigned, samplers, max(reps)), "samples")
    scored = picked.join(scores.select(F.col("slug").cast("long").alias("id"), "e", "g"), "id", "left")
    each = scored.withColumn("reps", F.explode(F.filter(F.array(*map(F.lit, reps)), lambda r: r >= F.col("rank"))))
    edit = F.col("e").isNotNull() & (F.col("g").isNull() | (F.col("e") <= F.col("g")))
    gen = F.col("g").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("g")))
    votes = each.groupBy("algorithm", "k", "sampler", "reps", "cluster_id").agg(F.count(F.when(edit, 1)).alias("edit_votes"), F.count(F.when(gen, 1)).alias("gen_votes"), F.avg("e").alias("mean_e"), F.avg("g").alias("mean_g"))
    choices = votes.withColumn("voting", F.explode(F.array(*map(F.lit, votings)))).withColumn("chosen", _chosen())
    items = assigned.join(scores.where("e is not null and g is not null").select(F.col("slug").cast("long").alias("id"), "e", "g"), "id")
    # items of a cluster are counted by the strategy that would win before they meet the cells' choices
    sums = items.groupBy("algorithm", "k", "cluster_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("e") <= F.col("g"), 1)).alias("edit_wins"), F.count(F.when(F.col("g") < F.col("e"), 1)).alias("gen_wins"), F.sum("e").alias("e"), F.sum("g").alias("g"), F.sum(F.least("e", "g")).alias("best")
    )
    met = choices.join(sums, ["algorithm", "k", "cluster_id"], "left")
    took = lambda a, b: F.sum(F.when(F.col("chosen") == "edit", F.col(a)).otherwise(F.col(b)))
    cells = met.groupBy(*CELL).agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(took("edit_wins", "gen_wins"), F.lit(0)).alias("wins"), took("e", "g").alias("score"), F.sum("best").alias("best"))
    key = F.concat_ws("_", "algorithm", F.concat(F.lit("k"), "k"), F.lit(f"s{seed}"), "sampler", F.concat(F.lit("r"), "reps"), "voting")
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total"))
    return cells.select(*CELL, key.alias("cell_key"), "clusters", "total", "wins", rate("wins").alias("win_rate"), rate("score").alias("mean_score"), rate("best").alias("oracle_score"))


def remaining_cells(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells whose key isn't among those done."""
    return cells.join(done.select("cell_key").distinct(), "cell_key", "left_anti")
