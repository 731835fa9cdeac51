"""Queries of the experiment grid, its reports, and work lists; each one SQL text, or a pair (Spark, DuckDB).

The grid is one dataflow: every cell (clusters, representatives a cluster, voting rule) is a row of its joins, so a whole
study costs as many exchanges as one cell. Clusterings of k clusters come from the label modulo k.
"""

from __future__ import annotations

from routelens.plans.reports import r

_KS = "(values (2), (5), (10)) as ks(k)"
_CLUSTERED = f"select a.slug, ks.k, a.cluster_id % ks.k as cluster from assignments a cross join {_KS}"
_PLACED = f"select m.slug, m.k, m.cluster, row_number() over (partition by m.k, m.cluster order by c.near desc, m.slug) as place from ({_CLUSTERED}) m join closeness c on c.vec_id = m.slug"
_BEST = "select slug, e, g, case when e is null and g is null then null when g is null or e <= g then 'edit' else 'gen' end as best from score_pairs"
#: Votes of each (k, reps, cluster); a cell's choice follows from them by its voting rule.
_CELL_VOTES = f"""select p.k, rs.reps, p.cluster, count(case when s.best = 'edit' then 1 end) as ev, count(case when s.best = 'gen' then 1 end) as gv, avg(s.e) as me, avg(s.g) as mg, max(case when p.place = 1 then s.best end) as first_best
 from ({_PLACED}) p join (values (1), (3), (5)) as rs(reps) on p.place <= rs.reps left join ({_BEST}) s on s.slug = p.slug group by p.k, rs.reps, p.cluster"""
_BY_MEAN = "case when me is not null and (mg is null or me <= mg) then 'edit' when mg is not null then 'gen' else 'edit' end"
_CELL_CHOICES = f"""select v.k, v.reps, v.cluster, t.voting, case when t.voting = 'mean_score' then {_BY_MEAN} when t.voting = 'rank1' then coalesce(first_best, 'gen') when ev > gv then 'edit' when gv > ev then 'gen' else {_BY_MEAN} end as chosen
 from ({_CELL_VOTES}) v cross join (values ('majority'), ('mean_score'), ('rank1')) as t(voting)"""
_CELL_KEY = "concat('label|k', cast(c.k as string), '|top|r', cast(c.reps as string), '|', c.voting, '|seed0')"
_CELLS = f"""select c.k, c.reps, c.voting, {_CELL_KEY} as cell_key, count(*) as total, count(distinct c.cluster) as n_clusters, count(case when c.chosen = s.best then 1 end) as wins
 from ({_CLUSTERED}) m join ({_CELL_CHOICES}) c on c.k = m.k and c.cluster = m.cluster join ({_BEST}) s on s.slug = m.slug where s.e is not null and s.g is not null group by c.k, c.reps, c.voting"""
_PREF = "select slug, case when e < g then 'edit' else 'gen' end as pref from score_pairs where e is not null and g is not null"
_PURE = f"select m.k, m.cluster, count(*) as total, greatest(count(case when p.pref = 'edit' then 1 end), count(case when p.pref = 'gen' then 1 end)) as major from ({_CLUSTERED}) m join ({_PREF}) p on p.slug = m.slug group by m.k, m.cluster"
_SEEDED = "md5(concat(cast(slug as string), '-42'))"

QUERIES: dict[str, str | tuple[str, str]] = {
    # the grid
    "experiment_grid": f"select k, reps, voting, cell_key, total, n_clusters, wins, {r('wins / cast(total as double)')} as win_rate from ({_CELLS}) t",
    "experiment_grid_remaining": f"select t.cell_key from ({_CELLS}) t where not exists (select 1 from (select concat('label|k', cast(p_size as string), '|top|r', cast(p_size % 4 + 1 as string), '|majority|seed0') as done from part) d where d.done = t.cell_key)",
    "experiment_best_cells": f"select k, reps, voting, {r('wins / cast(total as double)')} as win_rate from (select *, row_number() over (partition by k order by wins desc, reps, voting) as rn from ({_CELLS}) t) u where rn = 1",
    "experiment_keys": "select distinct concat_ws('_', view_name, algorithm, concat('k', cast(k as string)), concat('seed', case when algorithm in ('F') then '0' else '42' end)) as cluster_key, concat_ws('_', view_name, algorithm, concat('k', cast(k as string)), concat('r', cast(k % 3 + 1 as string))) as sample_key from grid",
    "experiment_summary": f"select count(*) as cells, count(case when win_rate > 0 then 1 end) as succeeded, count(case when win_rate = 0 then 1 end) as failed, {r('avg(win_rate)')} as mean, {r('max(win_rate)')} as best from grid",
    "best_config_cells": f"select g.k, count(*) as n, {r('avg(g.win_rate)')} as mean, {r('min(g.win_rate)')} as low, {r('max(g.win_rate)')} as high from grid g join (select view_name, algorithm, k from (select view_name, algorithm, k, row_number() over (order by round(avg(win_rate), 9) desc, view_name, algorithm, k) as rn from grid group by view_name, algorithm, k) t where rn = 1) b on b.view_name = g.view_name and b.algorithm = g.algorithm and b.k = g.k group by g.k",
    "purity_by_configuration": f"select k, count(*) as clusters, {r('avg(major / cast(total as double))')} as mean_purity, {r('sum(major) / cast(sum(total) as double)')} as weighted_purity from ({_PURE}) t group by k",
    "purity_top_bottom": f"select k, cluster, {r('purity')} as purity, top_place, bottom_place from (select k, cluster, purity, row_number() over (partition by k order by purity desc, cluster) as top_place, row_number() over (partition by k order by purity, cluster) as bottom_place from (select k, cluster, major / cast(total as double) as purity from ({_PURE}) t) u) w where top_place <= 3 or bottom_place <= 3",
    "algorithm_balance": f"select algorithm, count(*) as k, min(size) as smallest, max(size) as largest, {r('avg(size)')} as mean, {r('stddev_pop(size)')} as std0, {r('stddev_pop(size) / avg(size)')} as cv, count(case when size = 1 then 1 end) as singletons from (select 'label' as algorithm, cluster_id, count(*) as size from assignments group by cluster_id union all select 'modulo' as algorithm, slug % 7 as cluster_id, count(*) as size from assignments group by slug % 7) t group by algorithm",
    # samples and work lists; limits are the features
    "sample_without_replacement": f"select cluster_id, slug, place from (select cluster_id, slug, row_number() over (partition by cluster_id order by {_SEEDED}, slug) as place from assignments) t where place <= 5",
    "plot_subsample": f"select slug, cluster_id from assignments order by {_SEEDED}, slug limit 100",
    "max_items": "select doc_id from documents order by doc_id limit 50",
    "requested_items": "select distinct a.user_id as slug from events a where exists (select 1 from embeddings v where v.vec_id = a.user_id and v.label = 3)",
    "without_deprecated": "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)",
    "first_in_folder": "select label, vec_id, place from (select label, vec_id, row_number() over (partition by label order by vec_id) as place from embeddings) t where place <= 5",
    "source_labels": "select doc_id, case when lower(source) like '%web%' then 'web' when lower(source) like '%news%' then 'news' when lower(source) like '%code%' then 'code' else 'unknown' end as model, case when lang = 'en' then 'edit' when lang in ('fr', 'de') then 'gen' else 'unknown' end as task from documents",
    "metadata_projection": "select item_id, slug, view_name, case when view_name is null then 0 else 1 end as has_view from items",
    "concatenated_view": "select doc_id, md5(concat_ws(' ', '# Source', source, '# Language', coalesce(lang, 'none'), '# Text', text)) as digest from documents",
    "marked_text": "select doc_id, md5(concat('// MIXED ', text)) as digest from documents",
    # maps between clusters and members
    "vector_to_cluster": (
        "select cluster_id, slug from assignments where cluster_id is not null",
        "select cluster_id, slug from assignments where cluster_id is not null",
    ),
    "representatives_by_cluster": (
        "select cluster_id, array_join(transform(array_sort(collect_list(struct(rank, slug))), x -> cast(x.slug as string)), ',') as slugs, count(*) as n from representatives group by cluster_id",
        "select cluster_id, string_agg(cast(slug as varchar), ',' order by rank) as slugs, count(*) as n from representatives group by cluster_id",
    ),
    "cluster_export": "select a.cluster_id, a.slug, p.rank, case when p.rank is null then 0 else 1 end as is_representative, case when v.vec_id is null then 0 else 1 end as has_vector from assignments a left join representatives p on p.slug = a.slug and p.cluster_id = a.cluster_id left join embeddings v on v.vec_id = a.slug",
    "distinct_in_order": (
        "select conv_id, array_join(array_distinct(transform(array_sort(collect_list(struct(turn, role))), x -> x.role)), ',') as roles from conversations group by conv_id",
        "select conv_id, string_agg(role, ',' order by first_turn, role) as roles from (select conv_id, role, min(turn) as first_turn from conversations group by conv_id, role) t group by conv_id",
    ),
    "grouped_halves_joined": "select coalesce(a.conv_id, b.conv_id) as conv_id, a.n as user_turns, a.longest as user_longest, b.n as other_turns, b.longest as other_longest from (select conv_id, count(*) as n, max(char_length(text)) as longest from conversations where role = 'user' group by conv_id) a full outer join (select conv_id, count(*) as n, max(char_length(text)) as longest from conversations where role <> 'user' group by conv_id) b on b.conv_id = a.conv_id".replace("char_length", "length"),
    "store_statistics": (
        "select label as folder, count(*) as n, max(size(embedding)) as dims, min(vec_id) as first_id, max(vec_id) as last_id from embeddings group by label",
        "select label as folder, count(*) as n, cast(max(len(embedding)) as int) as dims, min(vec_id) as first_id, max(vec_id) as last_id from embeddings group by label",
    ),
    "negative_inner_product": "select vec_id, label, round(0 - near, 6) as dist from closeness",
    # outcomes
    "pass_count_with_subset": "select count(distinct case when reward then slug end) as passed, count(distinct case when reward and (slug % 3 = 0 or slug % 3 = 1 and slug <= 133) then slug end) as passed_subset, count(distinct slug) as slugs from attempts",
    "result_comparison": f"select before_n, after_n, {r('before_ok / cast(before_n as double)')} as before_rate, {r('after_ok / cast(after_n as double)')} as after_rate, {r('after_ok / cast(after_n as double) - before_ok / cast(before_n as double)')} as delta from (select count(case when attempt = 1 then 1 end) as before_n, count(case when attempt = 1 and reward then 1 end) as before_ok, count(case when attempt = 2 then 1 end) as after_n, count(case when attempt = 2 and reward then 1 end) as after_ok from attempts) t",
    "result_subsets": "select case when fixed = 1 and n = 1 then 'fixed at once' when fixed = 1 then 'fixed' when n >= 3 then 'given up' else 'open' end as subset, count(*) as slugs, min(slug) as first_slug, max(slug) as last_slug from (select slug, count(*) as n, max(case when reward then 1 else 0 end) as fixed from attempts group by slug) t group by 1",
    "error_report": "select user_id, count(*) as errors, min(event_id) as first_error, max(event_id) as last_error from events where event_type = 'error' group by user_id",
    "run_diffs_single": f"select slug, ts1, ts2, diff from (select slug, cast(run_ts as string) as ts1, coalesce(cast(lead(run_ts) over (partition by slug order by run_ts) as string), 'N/A') as ts2, coalesce({r('abs(lead(ppl) over (partition by slug order by run_ts) - ppl)')}, cast(0 as double)) as diff, count(*) over (partition by slug) as n from runs) t where ts2 <> 'N/A' or n = 1",
    "masked_nll": f"select slug, count(*) as tokens, {r('sum(nll)')} as nll, {r('exp(sum(nll) / count(*))')} as ppl from (select user_id as slug, value / 100 as nll, row_number() over (partition by user_id order by event_id) as place from events where value is not null) t where place > 2 group by slug",
    "case_detail": f"select p.slug, {r('p.e')} as e, {r('p.g')} as g, a.cluster_id, c.chosen, t.attempts, t.fixed from score_pairs p join (select slug from score_pairs where e is not null and g is not null order by round(abs(e - g), 9) desc, slug limit 1) w on w.slug = p.slug left join assignments a on a.slug = p.slug left join choices c on c.cluster_id = a.cluster_id left join (select slug, count(*) as attempts, max(case when reward then 1 else 0 end) as fixed from attempts group by slug) t on t.slug = p.slug",
    "project_level_summary": "select project, count(*) as vectors, count(distinct cluster_id) as clusters, max(case when rn = 1 then cluster_id end) as top_cluster, max(case when rn = 1 then n end) as top_n from (select d.source as project, a.cluster_id, c.n, c.rn from assignments a join documents d on d.doc_id = a.slug join (select project, cluster_id, n, row_number() over (partition by project order by n desc, cluster_id) as rn from (select d.source as project, a.cluster_id, count(*) as n from assignments a join documents d on d.doc_id = a.slug group by d.source, a.cluster_id) x) c on c.project = d.source and c.cluster_id = a.cluster_id) t group by project",
    "text_size_statistics": f"select source, lang, count(*) as n, min(n_chars) as smallest, max(n_chars) as largest, {r('avg(n_chars)')} as mean, {r('median(n_chars)')} as median from documents group by source, lang",
    "extreme_texts": "select lang, doc_id, kind from (select lang, doc_id, 'largest' as kind, row_number() over (partition by lang order by n_chars desc, doc_id) as rn from documents union all select lang, doc_id, 'smallest' as kind, row_number() over (partition by lang order by n_chars, doc_id) as rn from documents) t where rn = 1",
}
