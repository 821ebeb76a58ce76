"""Time the headline queries; prints one JSON line.

The stage tables (events, valued, plate_appearances, player tables) are timed as queries of
their own, so no query hides the cost of building them.
"""

from __future__ import annotations

import json
import os
import time

from basepaths import plans
from basepaths.plans import inputs as I
from basepaths.plans import value as PV
from basepaths.session import build_session

STAGES = {
    "stage_events": I.pbp, "stage_valued": I.valued, "stage_plate_appearances": I.plate_appearances, "stage_offense": I.offense,
    "stage_opportunities": I.opportunities, "stage_combined": PV.combined,
}
HEADLINE = (
    "rex1_runs_remaining rex2_run_expectancy rex3_run_values rex4_linear_weights rex5_bootstrap_intervals flagship_top_batters war1_woba_constants "
    "war2_offense_by_player war3_baserunning_steals war6_pooled_advancement war8_double_play_avoidance war10_range_runs war12_fip war14_opponent_adjusted_runs "
    "war20_combined_players tto4_exposures tto7_descriptive_tables tto8_pitcher_penalties tto9_fixed_effect_model tto11_period_payload pos2_position_exposure "
    "pos5_leave_one_out_variants pos7_fielding_transitions sct1_batting_lines sct5_matchups sct6_hitter_game_logs sct9_spray_counts sct10_approach sct14_percentiles "
    "sct19_pythagorean_study evt1_play_classification evt4_half_innings evt6_base_out_states evt9_active_lineup evt14_pitches tto1_pitcher_attribution "
    "ent6_same_time_split ent9_official_matches ent10_series ldr1_position_board ldr3_leader_cards val2_check_list"
).split()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{cpus}]", int(cpus), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    for name, build in STAGES.items():
        timed(name, lambda build=build: build(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda name=name: plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
