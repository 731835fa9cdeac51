"""Logical tables of the engine over the star-schema Parquet files.

Each view is plain SQL, so that another engine can run the same definition over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routelens.operators.shared import bounded_batches

#: View name -> (SQL for Spark, SQL for DuckDB); one string where both read it alike.
VIEWS: dict[str, str | tuple[str, str]] = {
    "samples": "select cast(user_id as bigint) as slug, case when event_type = 'click' then 'edit' else 'gen' end as strategy, value, event_id as ord from events where event_type in ('click', 'view')",
    "scores": "select slug, strategy, avg(value) as value from samples where value is not null group by slug, strategy",
    "score_pairs": "select slug, max(case when strategy = 'edit' then value end) as e, max(case when strategy = 'gen' then value end) as g from scores group by slug",
    "assignments": "select vec_id as slug, label as cluster_id from embeddings",
    "dims": (
        "select vec_id, label, pos, cast(x as double) as x from embeddings lateral view posexplode(embedding) t as pos, x",
        "select vec_id, label, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from embeddings",
    ),
    "centroids": "select label, pos, avg(x) as c from dims group by label, pos",
    "closeness": (
        "select d.vec_id, d.label, round(aggregate(zip_with(d.embedding, c.v, (x, y) -> cast(x as double) * y), cast(0 as double), (s, z) -> s + z), 9) as near from embeddings d join (select label, transform(array_sort(collect_list(struct(pos, c))), z -> z.c) as v from centroids group by label) c on c.label = d.label where d.embedding is not null",
        "select d.vec_id, d.label, round(sum(d.x * c.c), 9) as near from dims d join centroids c on d.label = c.label and d.pos = c.pos group by d.vec_id, d.label",
    ),
    "representatives": "select label as cluster_id, rn as rank, vec_id as slug from (select *, row_number() over (partition by label order by near desc, vec_id) as rn from closeness) t where rn <= 3",
    "rep_scores": "select r.cluster_id, r.rank, r.slug, p.e, p.g, case when p.e is null and p.g is null then null when p.g is null or p.e <= p.g then 'edit' else 'gen' end as best from representatives r left join score_pairs p on p.slug = r.slug",
    "votes": "select cluster_id, count(case when best = 'edit' then 1 end) as edit_votes, count(case when best = 'gen' then 1 end) as gen_votes, avg(e) as mean_e, avg(g) as mean_g, count(best) as n_reps_used from rep_scores group by cluster_id",
    "choices": "select cluster_id, edit_votes, gen_votes, case when edit_votes > gen_votes then 'edit' when gen_votes > edit_votes then 'gen' when mean_e is not null and (mean_g is null or mean_e <= mean_g) then 'edit' when mean_g is not null then 'gen' else 'edit' end as chosen from votes",
    "routed": "select a.slug, a.cluster_id, c.chosen, p.e, p.g, case when p.e <= p.g then 'edit' else 'gen' end as best from assignments a join choices c on c.cluster_id = a.cluster_id join score_pairs p on p.slug = a.slug where p.e is not null and p.g is not null",
    "attempts": "select cast(user_id as bigint) as slug, row_number() over (partition by user_id order by ts, event_id) as attempt, event_type = 'purchase' as reward from events",
    "runs": "select cast(user_id as bigint) as slug, date_trunc('day', ts) as run_ts, avg(value) as ppl from events group by user_id, date_trunc('day', ts)",
    "grid": "select l_returnflag as view_name, l_linestatus as algorithm, l_linenumber as k, l_discount as win_rate from lineitem",
    "items": "select concat(cast(doc_id as string), '__', source) as item_id, doc_id as slug, source as view_name, text from documents",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _of(name: str, duck: bool) -> str:
    v = VIEWS[name]
    return (v if isinstance(v, str) else v[duck]).replace("as string", "as varchar" if duck else "as string")


def _needed(sql: str, duck: bool) -> list[str]:
    """Views that ``sql`` reads, directly or through others, in order of definition."""
    import re

    wanted, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\b(?:from|join)\s+(\w+)", todo.pop()))
        for name in words & VIEWS.keys() - wanted:
            wanted.add(name)
            todo.append(_of(name, duck))
    return [v for v in VIEWS if v in wanted]


def with_views(sql: str, duck: bool = False) -> str:
    """``sql`` with the views it reads as common table expressions."""
    views = [f"{v} as ({_of(v, duck)})" for v in _needed(sql, duck)]
    if not views:
        return sql
    return f"with {', '.join(views)}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {', '.join(views)} {sql}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select * from {name}")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run ``sql`` over the files and the views; tables are passed by name, nothing is registered in the catalog."""
    import re

    text = with_views(sql)
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in used})
