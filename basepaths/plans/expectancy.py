"""Run expectancy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import expectancy as X
from basepaths.operators import value as V
from basepaths.plans import inputs as I
from basepaths.plans.registry import cte, query
from basepaths.sources import fixtures

cte("annotated", """
select *, cast(sum(runs_scored) over (partition by canonical_id, inning, half order by event_order
  rows between current row and unbounded following) as bigint) as runs_remaining_before from pbp""")
cte("states", """
select o.outs, b.bases, count(a.event_id) as n, sum(a.runs_remaining_before) as total,
  (select avg(runs_remaining_before) from annotated x where x.outs_before = o.outs) as outs_mean,
  (select avg(runs_remaining_before) from annotated) as all_mean
from (select cast(unnest(range(3)) as int) as outs) o cross join (select cast(unnest(range(8)) as int) as bases) b
left join annotated a on a.outs_before = o.outs and a.bases_before = b.bases group by o.outs, b.bases""")
cte("re_cells", """
select outs, bases, n as sample_size, total / n as raw_re, coalesce(outs_mean, all_mean) as outs_prior_re,
  20.0::double as prior_pseudocount, (coalesce(total, 0) + 20.0 * coalesce(outs_mean, all_mean)) / (n + 20.0) as smoothed_re
from states""")
cte("valued", """
select a.*, b.smoothed_re as re_before, coalesce(c.smoothed_re, 0.0) as re_after,
  a.runs_scored + coalesce(c.smoothed_re, 0.0) - b.smoothed_re as run_value
from annotated a join re_cells b on b.outs = a.outs_before and b.bases = a.bases_before
left join re_cells c on c.outs = a.outs_after and c.bases = a.bases_after""")


@query("rex1_runs_remaining", """
select canonical_id, inning, half, event_order, runs_remaining_before,
  runs_remaining_before - cast(runs_scored as bigint) as runs_remaining_after from annotated""")
def rex1(spark, sf):
    return I.annotated(spark, sf).select(
        "canonical_id", "inning", "half", "event_order", "runs_remaining_before", "runs_remaining_after"
    )


@query("rex2_run_expectancy", """
select *, concat(outs, ' outs, ', case when bases = 0 then 'empty' else concat(case when bases & 1 > 0 then '1' else '' end,
  case when bases & 2 > 0 then '2' else '' end, case when bases & 4 > 0 then '3' else '' end) end) as state from re_cells
""", "raw_re outs_prior_re smoothed_re")
def rex2(spark, sf):
    return X.estimate_re24(I.annotated(spark, sf))


@query("rex3_run_values", "select canonical_id, event_order, event_type, re_before, re_after, run_value from valued",
       "re_before re_after run_value")
def rex3(spark, sf):
    return X.add_run_values(I.pbp(spark, sf), X.estimate_re24(I.annotated(spark, sf))).select(
        "canonical_id", "event_order", "event_type", "re_before", "re_after", "run_value"
    )


@query("rex4_linear_weights", """
select event_type, count(*) as sample_size, avg(run_value) as linear_weight from valued where is_plate_appearance group by event_type
""", "linear_weight")
def rex4(spark, sf):
    return X.event_linear_weights(I.valued(spark, sf).where("is_plate_appearance"))


cte("rex5_draws", f"""
select canonical_id, r as replicate, len(list_filter({X.poisson_steps()}, lambda t: t <= cast(concat('0x', substr(h, cast(r % 16 as int) * 4 + 1, 4)) as int))) as times from (
  select canonical_id, r, sha256(concat('20260704|', canonical_id, '|', cast(floor(r / 16.0) as int))) as h
  from (select distinct canonical_id from pbp) g cross join (select unnest(range(500)) as r) x) y""")
cte("rex5_sums", """
select replicate, outs, bases, sum(n * times) as n, sum(total * times) as total from rex5_draws join (
  select canonical_id, outs_before as outs, bases_before as bases, count(*) as n, sum(runs_remaining_before) as total from annotated group by all) s using (canonical_id)
where times > 0 group by replicate, outs, bases""")


@query("rex5_bootstrap_intervals", """
select outs, bases, quantile_cont(re, 0.025) as re_low, quantile_cont(re, 0.975) as re_high from (
  select g.outs, g.bases, (coalesce(s.total, 0) + 20.0 * coalesce(o.mean, a.mean)) / (coalesce(s.n, 0) + 20.0) as re
  from (select distinct replicate, outs, bases from rex5_draws cross join (select outs, bases from re_cells) c) g
  join (select replicate, sum(total) / sum(n) as mean from rex5_sums group by replicate) a using (replicate)
  left join (select replicate, outs, sum(total) / sum(n) as mean from rex5_sums group by replicate, outs) o on o.replicate = g.replicate and o.outs = g.outs
  left join rex5_sums s on s.replicate = g.replicate and s.outs = g.outs and s.bases = g.bases) x group by outs, bases""", "re_low re_high")
def rex5(spark, sf):
    return X.bootstrap_re24(I.annotated(spark, sf), replicates=500)


@query("rex6_summary", """
select count(*) filter (where sample_size > 0) as states_observed, min(sample_size) as minimum_state_sample,
  max(sample_size) as maximum_state_sample from re_cells""")
def rex6(spark, sf):
    return X.re24_summary(X.estimate_re24(I.annotated(spark, sf)))


@query("flagship_top_batters", """
select season, player_key, "PA", "wOBA", batting_runs from offense
qualify row_number() over (order by batting_runs desc, season, player_key) <= 25""", "wOBA batting_runs")
def flagship(spark, sf):
    """Who created most batting runs: expectancy, run values, weights, season lines, top 25."""
    events = fixtures.pbp(spark, sf)
    rows = X.add_run_values(events, X.estimate_re24(X.annotate_runs_remaining(events)))
    lines = V.aggregate_offense(rows, V.woba_constants(rows))
    return (
        lines.select("season", "player_key", "PA", "wOBA", "batting_runs")
        .orderBy(F.desc("batting_runs"), "season", "player_key").limit(25)
    )
