"""Report queries as SQL over the adapter views. One text serves both engines unless a pair (Spark, DuckDB) is given.

Tie rules are part of each query: ``<`` sends ties to gen, ``<=`` to edit, as its name's report defines it.
"""

from __future__ import annotations

_R = "round(cast({} as double), 6)"


def r(x: str) -> str:
    return _R.format(x)


_GAP = "case when least(e, g) > 0 then (greatest(e, g) - least(e, g)) / least(e, g) else 0 end"
_PCT = "abs(e - g) / least(e, g) * 100"
_CATEGORY = f"case when {_PCT} < 5 then 'tiny' when {_PCT} < 20 then 'small' when {_PCT} < 50 then 'medium' when {_PCT} < 100 then 'large' else 'huge' end"
_PREF = "select slug, case when e < g then 'edit' else 'gen' end as pref from score_pairs where e is not null and g is not null"
_MEMBER = f"select a.slug, a.cluster_id, p.pref from assignments a join ({_PREF}) p on p.slug = a.slug"
_PURITY = f"select cluster_id, count(*) as total, count(case when pref = 'edit' then 1 end) as edit_count, count(case when pref = 'gen' then 1 end) as gen_count from ({_MEMBER}) m group by cluster_id"
_SIZES = "select cluster_id, count(*) as size from assignments group by cluster_id"
_BUDGET = f"""select v.cluster_id, z.size, v.edit_votes, v.gen_votes, v.mean_e, v.mean_g, b.n, b.be, b.bg, b.gap, b.votes
 from votes v join ({_SIZES}) z on z.cluster_id = v.cluster_id
 left join (select cluster_id, count(*) as n, avg(e) as be, avg(g) as bg, avg(abs(e - g)) as gap, count(case when e < g then 1 end) as votes from rep_scores where e is not null and g is not null group by cluster_id) b on b.cluster_id = v.cluster_id"""
_PPL_RATIO = "case when n is null then 0.5 else 1 / (1 + exp(be - bg)) end"
_PPL_CONF = "case when n is null then 0 else least(abs(bg - be) / 10, 1) end"
_VOTE_RATIO = "case when n is null then 0.5 else 0.5 + (votes / cast(n as double) - 0.5) * least(gap / 0.5, 1) end"
_SIZE_RATIO = "case when n is null then 0.5 else 0.5 + (votes / cast(n as double) - 0.5) * least(size / 10.0, 1) end"
#: The direction comes from means and votes (size trusts the vote), damped toward a half by the weighted confidence.
_HYBRID = "case when n is null then 0.5 else 0.5 + (0.4 / (1 + exp(be - bg)) + 0.6 * votes / cast(n as double) - 0.5) * (0.4 * least(abs(bg - be) / 0.15, 1) + 0.4 * least(gap / 0.5, 1) + 0.2 * least(size / 10.0, 1)) end"
_CLAMPED = f"least(greatest({_HYBRID}, 0.2), 0.8)"
_LABEL = "case when abs(ratio - 0.5) < 0.05 then 'mixed' when ratio > 0.5 then 'edit' else 'gen' end"
_UNIT = ("conv(substring(md5(cast(slug as string)), 1, 8), 16, 10) / 4294967296.0", "cast(('0x' || substring(md5(cast(slug as varchar)), 1, 8)) as bigint) / 4294967296.0")
_WINS = "cast(sum(case when {} then 1 else 0 end) as double) / count(*)"
#: Squared distance of two arrays (Spark).
_ARRAY_DIST = "aggregate(zip_with({}, {}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), cast(0 as double), (s, z) -> s + z)"


def _routing(i: int) -> str:
    return f"select slug, cluster_id, decision, {r('ratio')} as ratio, case when decision = 'mixed' then case when {_UNIT[i]} < ratio then 'edit' else 'gen' end else decision end as modeling_type from (select a.slug, a.cluster_id, b.ratio, {_LABEL} as decision from assignments a join (select cluster_id, {_CLAMPED} as ratio from ({_BUDGET}) q) b on b.cluster_id = a.cluster_id) t"


QUERIES: dict[str, str | tuple[str, str]] = {
    # scores
    "score_mean_by_slug": f"select slug, strategy, {r('value')} as value from scores",
    "score_median_by_slug": f"select slug, strategy, {r('median(value)')} as value, count(*) as n from samples group by slug, strategy",
    "score_stats_by_strategy": f"select strategy, count(*) as n, {r('avg(value)')} as mean, {r('median(value)')} as median, {r('stddev_pop(value)')} as std0, {r('stddev_samp(value)')} as std1, {r('min(value)')} as min_value, {r('max(value)')} as max_value, {r('sum(value)')} as sum_value from samples group by strategy",
    "score_last_wins": f"select slug, strategy, {r('max_by(value, ord)')} as value from samples where value is not null group by slug, strategy",
    "score_pairs": f"select slug, {r('e')} as e, {r('g')} as g from score_pairs where e is not null and g is not null",
    "gap_table": f"select slug, {r('e')} as e, {r('g')} as g, {r(_GAP)} as rel_gap, {r(_PCT)} as pct_gap, {r('abs(e - g) / (e + g)')} as balance_gap, case when e < g then 'edit' else 'gen' end as pref from score_pairs where e is not null and g is not null",
    "gap_categories": f"select {_CATEGORY} as category, count(*) as n, {r(f'avg({_PCT})')} as mean_pct from score_pairs where e is not null and g is not null group by {_CATEGORY}",
    "gap_percentiles": (
        f"select {', '.join(f'{r(f'percentile(p, {q / 100})')} as p{q}' for q in (5, 10, 25, 50, 75, 90, 95))} from (select {_PCT} as p from score_pairs where e is not null and g is not null) t",
        f"select {', '.join(f'{r(f'quantile_cont(p, {q / 100})')} as p{q}' for q in (5, 10, 25, 50, 75, 90, 95))} from (select {_PCT} as p from score_pairs where e is not null and g is not null) t",
    ),
    "gap_topk": f"select slug, {r(_PCT)} as pct_gap from score_pairs where e is not null and g is not null order by {_PCT} desc, slug limit 20",
    "gap_bottomk": f"select slug, {r(_PCT)} as pct_gap from score_pairs where e is not null and g is not null order by {_PCT}, slug limit 20",
    "threshold_sweep": f"select t.threshold, count(case when {_PCT} <= t.threshold then 1 end) as n, {r(f'cast(100 as double) * count(case when {_PCT} <= t.threshold then 1 end) / count(*)')} as pct from score_pairs cross join (values (5), (10), (15), (20), (30), (50)) as t(threshold) where e is not null and g is not null group by t.threshold",
    "missing_rate_by_strategy": f"select count(*) as total, count(case when p.e is null then 1 end) as missing_edit, count(case when p.g is null then 1 end) as missing_gen, {r('count(case when p.e is null then 1 end) / cast(count(*) as double)')} as missing_rate_edit, {r('count(case when p.g is null then 1 end) / cast(count(*) as double)')} as missing_rate_gen from assignments a left join score_pairs p on p.slug = a.slug",
    # clusters
    "cluster_sizes": _SIZES,
    "cluster_size_stats": f"select count(*) as k, min(size) as smallest, max(size) as largest, {r('avg(size)')} as mean, {r('median(size)')} as median, {r('stddev_pop(size)')} as std0, {r('stddev_pop(size) / avg(size)')} as cv from ({_SIZES}) s",
    "cluster_metrics": f"select a.cluster_id, s.strategy, count(s.value) as n, {r('avg(s.value)')} as mean, {r('median(s.value)')} as median, {r('stddev_pop(s.value)')} as std0, {r('min(s.value)')} as low, {r('max(s.value)')} as high from assignments a join scores s on s.slug = a.slug group by a.cluster_id, s.strategy",
    "cluster_deltas": f"select a.cluster_id, count(*) as n, {r('avg(p.e - p.g)')} as mean_delta, {r('median(p.e - p.g)')} as median_delta from assignments a join score_pairs p on p.slug = a.slug where p.e is not null and p.g is not null group by a.cluster_id",
    "cluster_purity": f"select cluster_id, total, edit_count, gen_count, {r('greatest(edit_count, gen_count) / cast(total as double)')} as purity, {r('edit_count / cast(total as double)')} as edit_ratio, case when edit_count > gen_count then 'edit' else 'gen' end as majority from ({_PURITY}) p",
    "purity_summary": f"select count(*) as clusters, {r('avg(purity)')} as mean, {r('median(purity)')} as median, {r('min(purity)')} as low, {r('max(purity)')} as high, {r('stddev_pop(purity)')} as std0, {r('sum(purity * total) / sum(total)')} as weighted, {r('1 - sum(purity * total) / sum(total)')} as misclassified, {r('avg(case when purity >= 0.9 then cast(1 as double) else cast(0 as double) end)')} as share90, {r('avg(case when purity < 0.6 then cast(1 as double) else cast(0 as double) end)')} as share_below60 from (select total, greatest(edit_count, gen_count) / cast(total as double) as purity from ({_PURITY}) p) q",
    "balanced_clusters": f"select cluster_id, n, small, {r('small / cast(n as double)')} as share from (select a.cluster_id, count(*) as n, count(case when {_PCT.replace('e -', 'p.e -').replace(' g)', ' p.g)').replace('least(e, g)', 'least(p.e, p.g)')} <= 20 then 1 end) as small from assignments a join score_pairs p on p.slug = a.slug where p.e is not null and p.g is not null group by a.cluster_id) t where small >= 0.2 * n",
    "outlier_merge_single": f"select a.slug, case when z.size <= 45 then -1 else a.cluster_id end as cluster_id from assignments a join ({_SIZES}) z on z.cluster_id = a.cluster_id",
    "adaptive_reps_table": f"select size, count(*) as clusters, least(greatest(3, cast(floor(size / 3.0) as int)), 7) as reps from (select source, lang, count(*) as size from documents group by source, lang) s group by size",
    "adaptive_reps": f"select cluster_id, size, least(greatest(3, cast(floor(size / 3.0) as int)), 7) as reps from ({_SIZES}) s",
    "cluster_members": (
        "select cluster_id, array_join(transform(array_sort(collect_list(slug)), x -> cast(x as string)), ',') as members from assignments group by cluster_id",
        "select cluster_id, string_agg(cast(slug as varchar), ',' order by slug) as members from assignments group by cluster_id",
    ),
    # representatives and votes
    "representatives": "select cluster_id, rank, slug from representatives",
    "vote_majority": f"select cluster_id, edit_votes, gen_votes, chosen from choices",
    "vote_mean_score": f"select cluster_id, {r('mean_e')} as mean_e, {r('mean_g')} as mean_g, case when mean_e is not null and (mean_g is null or mean_e <= mean_g) then 'edit' when mean_g is not null then 'gen' else 'edit' end as chosen from votes",
    "vote_rank1": "select cluster_id, best as chosen from rep_scores where rank = 1 and best is not null",
    "vote_strict": "select cluster_id, case when count(case when coalesce(e, 1e300) < coalesce(g, 1e300) then 1 end) > count(case when not coalesce(e, 1e300) < coalesce(g, 1e300) then 1 end) then 'edit' else 'gen' end as chosen from rep_scores group by cluster_id",
    "cluster_choice_confidence": f"select cluster_id, chosen, {r('case when edit_votes + gen_votes = 0 then 0 else greatest(edit_votes, gen_votes) / cast(edit_votes + gen_votes as double) end')} as confidence from choices",
    "budget_ppl_gap": f"select cluster_id, {r(_PPL_RATIO)} as ratio, {r(_PPL_CONF)} as confidence from ({_BUDGET}) b",
    "budget_vote_consistency": f"select cluster_id, {r(_VOTE_RATIO)} as ratio from ({_BUDGET}) b",
    "budget_size_adjusted": f"select cluster_id, {r(_SIZE_RATIO)} as ratio from ({_BUDGET}) b",
    "budget_hybrid": f"select cluster_id, {r(_HYBRID)} as ratio from ({_BUDGET}) b",
    "budget_decisions": f"select cluster_id, {r('ratio')} as edit_ratio, {r('1 - ratio')} as gen_ratio, {_LABEL} as decision from (select cluster_id, {_CLAMPED} as ratio from ({_BUDGET}) q) t",
    "selection_statistics": f"select decision, count(*) as n, {r('avg(ratio)')} as mean_ratio, {r('min(ratio)')} as low, {r('max(ratio)')} as high from (select ratio, {_LABEL} as decision from (select {_CLAMPED} as ratio from ({_BUDGET}) q) t) u group by decision",
    # routing
    "routing_table": "select a.slug, a.cluster_id, coalesce(c.chosen, 'gen') as chosen from assignments a left join choices c on c.cluster_id = a.cluster_id",
    "routing_hash_sampled": (_routing(0), _routing(1)),
    "routing_forced": tuple(
        f"select a.slug, a.cluster_id, 'edit' as pure_edit, 'gen' as pure_gen, case when {u} < 0.5 then 'edit' else 'gen' end as even from assignments a" for u in _UNIT
    ),
    "win_rate": f"select count(*) as total, count(case when chosen = best then 1 end) as wins, {r(_WINS.format('chosen = best'))} as win_rate from routed",
    "win_rate_baselines": f"select count(*) as total, {r(_WINS.format('chosen = best'))} as routed, {r(_WINS.format('e <= g'))} as always_edit, {r(_WINS.format('g <= e'))} as always_gen, cast(1 as double) as oracle_rate from routed",
    "regret_metrics": f"select count(*) as total, {r('avg(case when chosen = \'edit\' then e else g end - least(e, g))')} as regret, {r('avg(case when least(e, g) > 0 then (case when chosen = \'edit\' then e else g end - least(e, g)) / least(e, g) end)')} as relative_regret, {r('avg(case when chosen = \'edit\' then e else g end)')} as mean_chosen, {r('avg(least(e, g))')} as mean_oracle from routed",
    "cluster_accuracy_majority": f"select cluster_id, chosen, majority, chosen = majority as correct, {r('agreement')} as agreement from (select cluster_id, min(chosen) as chosen, case when count(case when best = 'edit' then 1 end) >= count(case when best = 'gen' then 1 end) then 'edit' else 'gen' end as majority, {_WINS.format('chosen = best')} as agreement from routed group by cluster_id) t",
    "cluster_accuracy_all": f"select count(*) as clusters, count(case when good = n then 1 end) as all_agree, {r('sum(good) / cast(sum(n) as double)')} as slug_accuracy from (select cluster_id, count(*) as n, count(case when chosen = best then 1 end) as good from routed group by cluster_id) t",
    "overall_metrics": f"select count(*) as slugs, count(p.e) as with_edit, count(p.g) as with_gen, {r('avg(case when c.chosen = \'edit\' then p.e else p.g end)')} as mean_chosen from assignments a left join choices c on c.cluster_id = a.cluster_id left join score_pairs p on p.slug = a.slug",
    # agreement, sets
    "preference_transitions": "select p1 as first_pref, p2 as second_pref, count(*) as n from (select slug, case when avg(case when strategy = 'edit' then value end) < avg(case when strategy = 'gen' then value end) then 'edit' else 'gen' end as p1, case when median(case when strategy = 'edit' then value end) < median(case when strategy = 'gen' then value end) then 'edit' else 'gen' end as p2 from samples group by slug having count(distinct strategy) = 2) t group by p1, p2",
    "overlap_sets": "select count(case when a and b then 1 end) as both_sets, count(case when a and not b then 1 end) as only_first, count(case when b and not a then 1 end) as only_second from (select slug, max(strategy = 'edit' and value < 25) as a, max(strategy = 'gen' and value < 25) as b from samples group by slug) t",
    "jaccard": f"select {r('sum(case when a and b then cast(1 as double) else cast(0 as double) end) / sum(case when a or b then cast(1 as double) else cast(0 as double) end)')} as jaccard from (select slug, max(strategy = 'edit' and value < 25) as a, max(strategy = 'gen' and value < 25) as b from samples group by slug) t",
    "f1_strategies": f"select tp, fp, fn, {r('tp / cast(tp + fp as double)')} as prec, {r('tp / cast(tp + fn as double)')} as recall, {r('2.0 * tp / (2.0 * tp + fp + fn)')} as f1 from (select count(case when chosen = 'edit' and best = 'edit' then 1 end) as tp, count(case when chosen = 'edit' and best = 'gen' then 1 end) as fp, count(case when chosen = 'gen' and best = 'edit' then 1 end) as fn from routed) t",
    "set_intersect": "select user_id as slug from events where event_type = 'click' intersect select user_id as slug from events where event_type = 'view'",
    "set_except": "select o_custkey as slug from orders where o_orderstatus = 'F' except select o_custkey as slug from orders where o_orderstatus = 'P'",
    # order-dependent
    "run_diffs_lead": f"select slug, run_ts, lead(run_ts) over (partition by slug order by run_ts) as next_ts, {r('abs(lead(ppl) over (partition by slug order by run_ts) - ppl)')} as diff from runs",
    "pass_at_1": f"select count(*) as slugs, count(case when reward then 1 end) as passed, {r(_WINS.format('reward'))} as rate from attempts where attempt = 1",
    "pass_at_3": f"select count(*) as slugs, cast(sum(ok) as bigint) as passed, {r('sum(ok) / cast(count(*) as double)')} as rate from (select slug, max(case when reward then 1 else 0 end) as ok from attempts where attempt <= 3 group by slug) t",
    "any_success": "select slug, count(*) as attempts, max(case when reward then 1 else 0 end) as fixed from attempts group by slug",
    "first_success": "select slug, min(case when reward then attempt end) as first_attempt from attempts group by slug",
    "outcome_quadrants": "select click_fixed, view_fixed, count(*) as n from (select user_id, max(case when event_type = 'click' and value > 90 then 1 else 0 end) as click_fixed, max(case when event_type = 'view' and value > 90 then 1 else 0 end) as view_fixed from events group by user_id) t group by click_fixed, view_fixed",
    "first_n_per_group": "select p_brand, p_name, rn from (select p_brand, p_name, p_partkey, row_number() over (partition by p_brand order by p_name, p_partkey) as rn from part) t where rn <= 3",
    "natural_order": "select s_suppkey, lower(split_part(s_name, '#', 1)) as project, cast(split_part(s_name, '#', 2) as int) as number from supplier order by project, number, s_suppkey",
    "dedup_last_wins": f"select user_id, event_type, {r('value')} as value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) t where rn = 1",
    # experiment grid
    "dim_aggregates_grouping_sets": f"select view_name, algorithm, k, {r('avg(win_rate)')} as mean, count(*) as n from grid group by grouping sets ((view_name), (algorithm), (k))",
    "k_impact": f"select view_name, algorithm, k, {r('avg(win_rate)')} as mean, {r('stddev_samp(win_rate)')} as std1, count(*) as n from grid group by view_name, algorithm, k",
    "best_config_per_dim": f"select k, view_name, algorithm, {r('mean')} as mean from (select *, row_number() over (partition by k order by round(mean, 9) desc, view_name, algorithm) as rn from (select k, view_name, algorithm, avg(win_rate) as mean from grid group by k, view_name, algorithm) g) t where rn = 1",
    "k_improvement": f"select view_name, {r('avg(case when k = 7 then win_rate end) - avg(case when k = 1 then win_rate end)')} as improvement from grid group by view_name",
    "grid_cartesian": "select a.n_name as first_axis, b.r_name as second_axis, c.k as third_axis from nation a cross join region b cross join (values (50), (100), (200)) as c(k)",
    # text and work lists
    "unprocessed_anti": "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "union_sources": "select doc_id as id, 'documents' as src from documents union all select item_id as id, 'benchmark' as src from benchmark union all select page_id as id, 'pages' as src from pages",
    "token_counts": ("select doc_id, size(filter(split(text, '[ \\n\\t\\r]+'), x -> x <> '')) as tokens from documents", "select doc_id, len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) as tokens from documents"),
    "line_stats": ("select doc_id, size(split(text, '\\n')) as n_lines, char_length(text) as n_chars, array_max(transform(split(text, '\\n'), x -> char_length(x))) as longest from documents", "select doc_id, len(string_split(text, chr(10))) as n_lines, length(text) as n_chars, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) as longest from documents"),
    "newline_normalize": ("select doc_id, md5(regexp_replace(replace(text, '\\n', '\\r\\n'), '\\r\\n?', '\\n')) as digest from documents", "select doc_id, md5(text) as digest from documents"),
    "identifier_hash": ("select doc_id, concat('ID_', substring(sha1(encode(text, 'UTF-8')), 1, 8)) as hashed from documents", "select doc_id, concat('ID_', substring(sha1(text), 1, 8)) as hashed from documents"),
    "stable_item_ids": "select item_id, slug, view_name from items",
    "modeling_type": "select conv_id, turn, case when lower(text) like '%edit%' then 'edit' when lower(text) like '%rewrite%' or lower(text) like '%gen%' then 'rewrite' else 'unknown' end as kind from conversations",
    "project_distribution": "select source, lang, count(*) as n, row_number() over (partition by source order by count(*) desc, lang) as place from documents group by source, lang",
    # budgets, labels, summaries
    "level_budgets": f"select cluster_id, size, least(4, 1 + cast(floor(size / 25.0) as int)) as level_0, case when size <= 25 then 1 else 2 end as level_1, 1 as level_2 from ({_SIZES}) s",
    "balance_label": f"select {r('cv')} as cv, case when cv < 0.3 then 'very balanced' when cv < 0.5 then 'balanced' when cv < 1.0 then 'uneven' else 'very uneven' end as label from (select stddev_pop(size) / avg(size) as cv from ({_SIZES}) s) t",
    "cluster_gap_analysis": f"select cluster_id, count(*) as n, {r('avg(pct)')} as mean_pct, {r('avg(case when edit then cast(1 as double) else cast(0 as double) end)')} as vote_ratio, {r('avg(case when pct <= 5 then cast(1 as double) else cast(0 as double) end)')} as share_5, {r('avg(case when pct <= 20 then cast(1 as double) else cast(0 as double) end)')} as share_20, cast(floor(least(avg(pct), 99.0) / 10) * 10 as int) as band from (select a.cluster_id, p.e < p.g as edit, abs(p.e - p.g) / least(p.e, p.g) * 100 as pct from assignments a join score_pairs p on p.slug = a.slug where p.e is not null and p.g is not null) t group by cluster_id",
    "transition_statistics": "select first_pref, second_pref, count(*) as n, " + r("avg(pct)") + " as mean_pct, " + r("median(pct)") + " as median_pct, count(case when pct < 5 then 1 end) as below_5, count(case when pct >= 20 then 1 end) as from_20 from (select case when e < g then 'edit' else 'gen' end as first_pref, case when em < gm then 'edit' else 'gen' end as second_pref, abs(e - g) / least(e, g) * 100 as pct from (select slug, avg(case when strategy = 'edit' then value end) as e, avg(case when strategy = 'gen' then value end) as g, median(case when strategy = 'edit' then value end) as em, median(case when strategy = 'gen' then value end) as gm from samples group by slug having count(distinct strategy) = 2) t) u group by first_pref, second_pref",
    "purity_histogram": f"select case when purity >= 0.9 then '0.9' when purity >= 0.8 then '0.8' when purity >= 0.7 then '0.7' when purity >= 0.6 then '0.6' else 'below' end as band, count(*) as clusters, sum(total) as slugs from (select total, greatest(edit_count, gen_count) / cast(total as double) as purity from ({_PURITY}) p) q group by 1",
    "rowwise_argmin": "select slug, case when e is null and g is null then null when g is null or e <= g then 'edit' else 'gen' end as best from score_pairs",
    "four_way_scores": "select slug, " + ", ".join(f"{r(c)} as {c}" for c in ("a", "b", "c", "d")) + ", case when a < b then 'edit' else 'gen' end = case when c < d then 'edit' else 'gen' end as agree from (select user_id as slug, avg(case when event_type = 'click' then value end) as a, avg(case when event_type = 'view' then value end) as b, avg(case when event_type = 'signup' then value end) as c, avg(case when event_type = 'purchase' then value end) as d from events group by user_id) t where a is not null and b is not null and c is not null and d is not null",
    "perplexity_from_logprobs": f"select slug, n_out, n_all, {r('nll_out')} as avg_nll, {r('exp(nll_out)')} as ppl, {r('nll_all')} as avg_nll_io, {r('exp(nll_all)')} as ppl_io from (select user_id as slug, count(case when event_type = 'click' then value end) as n_out, count(value) as n_all, sum(case when event_type = 'click' then value / 100 end) / count(case when event_type = 'click' then value end) as nll_out, sum(value / 100) / count(value) as nll_all from events group by user_id having count(case when event_type = 'click' then value end) > 0) t",
    "mean_with_failed_rows": f"select slug, count(*) as n, {r('sum(x) / count(*)')} as mean from (select user_id as slug, case when event_type = 'error' then null else value end as x from events) t group by slug having count(x) > 0",
    "weighted_mean_pool": f"select label, pos, {r('sum(w * x) / sum(w)')} as x from (select label, pos, x, case when vec_id % 4 <= 0 then 1 else vec_id % 4 end as w from dims) t group by label, pos",
    "batch_statistics": f"select count(*) as bugs, sum(fixed) as fixed, {r('avg(cast(fixed as double))')} as fix_rate, sum(attempts) as attempts, {r('avg(cast(attempts as double))')} as mean_attempts, {r('avg(spent)')} as mean_spent from (select user_id, max(case when event_type = 'purchase' then 1 else 0 end) as fixed, count(*) as attempts, sum(value) as spent from events group by user_id) t",
    "failure_reasons_topk": "select event_type as reason, count(*) as n from events where event_type <> 'purchase' group by event_type order by count(*) desc, event_type limit 5",
    "parallel_statistics": f"select count(*) as workers, {r('sum(busy)')} as total_time, {r('max(busy)')} as wall_time, {r('sum(busy) / max(busy)')} as speedup, {r('sum(busy) / max(busy) / count(*)')} as efficiency from (select user_id % 8 as worker, sum(value) as busy from events group by user_id % 8) t",
    "difficulty_tiers": "select quadrant, slug, diff from (select *, row_number() over (partition by quadrant order by diff desc, slug) as rn from (select slug, case when e < 50 and g < 50 then 'both' when e < 50 then 'edit' when g < 50 then 'gen' else 'neither' end as quadrant, " + r("abs(e - g)") + " as diff from score_pairs where e is not null and g is not null) t) u where rn <= 10",
    "best_worst_config": f"(select 'best' as kind, view_name, algorithm, k, {r('avg(win_rate)')} as mean from grid group by view_name, algorithm, k order by round(avg(win_rate), 9) desc, view_name, algorithm, k limit 1) union all (select 'worst' as kind, view_name, algorithm, k, {r('avg(win_rate)')} as mean from grid group by view_name, algorithm, k order by round(avg(win_rate), 9), view_name, algorithm, k limit 1)",
    "reps_sensitivity": f"select g.k, {r('avg(g.win_rate)')} as mean, count(*) as n from grid g join (select view_name, algorithm from grid group by view_name, algorithm order by round(avg(win_rate), 9) desc, view_name, algorithm limit 1) b on b.view_name = g.view_name and b.algorithm = g.algorithm group by g.k",
    "normalization_summary": "select q.quality, count(t.grade) as n from (values ('high'), ('medium'), ('low'), ('failed')) as q(quality) left join (select case when quality = 1 and toxic = 0 then 'high' when quality = 1 then 'medium' else 'low' end as grade from labels) t on t.grade = q.quality group by q.quality",
    "pass_at_k_by_language": f"select lang, count(*) as slugs, {r('avg(first)')} as pass_1, {r('avg(three)')} as pass_3 from (select lang, source, max(case when rn = 1 then ok else cast(0 as double) end) as first, max(case when rn <= 3 then ok else cast(0 as double) end) as three from (select d.lang, d.source, cast(l.quality as double) as ok, row_number() over (partition by d.lang, d.source order by d.doc_id) as rn from documents d join labels l on l.doc_id = d.doc_id) t group by lang, source) u group by lang",
    "round_robin_fill": "select cluster_id, rank, slug from representatives order by rank, cluster_id limit 25",
    "level_analysis": f"select cluster_id % 2 as level, min(size) as smallest, max(size) as largest, {r('avg(size)')} as mean from ({_SIZES}) s group by cluster_id % 2",
    "slug_counts_per_cluster": "select cluster_id, project, n from (select *, row_number() over (partition by cluster_id order by n desc, project) as rn from (select a.cluster_id, d.source as project, count(*) as n from assignments a join documents d on d.doc_id = a.slug group by a.cluster_id, d.source) t) u where rn <= 10",
    "reps_recommendation": f"select k as reps, {r('win_rate')} as win_rate, case when win_rate - best < -0.005 then '' when 100.0 * k / 8 < 80 then 'recommended' when 100.0 * k / 8 < 100 then 'usable' else 'oversampled' end as recommendation from (select k, avg(win_rate) as win_rate, max(avg(win_rate)) over () as best from grid group by k) t",
    "cache_fifo": "select user_id, first_id from (select user_id, min(event_id) as first_id from events group by user_id) t order by first_id desc limit 100",
    "range_filter": "select p_partkey, p_brand from part where p_brand like 'Brand#%' and p_size between 10 and 20",
    "combination_count": "select count(distinct view_name) * count(distinct algorithm) * count(distinct k) as n from grid",
    "throughput": f"select run_ts, count(*) as done, {r('avg(ppl)')} as mean, {r('cast(86400 as double) / count(*)')} as seconds_each from runs group by run_ts",
    # vectors
    "centroid_by_label": f"select label, pos, {r('c')} as c from centroids",
    "medoid_by_label": f"select label, vec_id, {r('near')} as near from (select *, row_number() over (partition by label order by near desc, vec_id) as rn from closeness) t where rn = 1",
    "farthest_first_r2": (
        f"select label, vec_id, {r('dist')} as dist from (select *, row_number() over (partition by label order by round(dist, 9) desc, vec_id) as rn from (select d.label, d.vec_id, {_ARRAY_DIST.format('d.embedding', 'm.v')} as dist from embeddings d join (select label, cast(embedding as array<double>) as v from embeddings where vec_id in (select vec_id from (select vec_id, row_number() over (partition by label order by near desc, vec_id) as rn from closeness) t where rn = 1)) m on m.label = d.label) p where dist is not null) q where rn = 1",
        f"with pair as (select m.label, d.vec_id, sum((d.x - e.x) * (d.x - e.x)) as dist from (select label, vec_id from (select *, row_number() over (partition by label order by near desc, vec_id) as rn from closeness) t where rn = 1) m join dims e on e.vec_id = m.vec_id join dims d on d.label = m.label and d.pos = e.pos group by m.label, d.vec_id) select label, vec_id, {r('dist')} as dist from (select *, row_number() over (partition by label order by round(dist, 9) desc, vec_id) as rn from pair) t where rn = 1",
    ),
}
