"""Scouting tables: player lines, logs, spray, approach, percentiles, records and rankings.

All periods (each season and both together) are built in one job: a row belongs to its season
and to ``combined``, and the period is part of every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions import text as X
from basepaths.functions.lines import count_if, is_in, ratio, ratio0
from basepaths.functions.ranking import ordered_number

# --- fixed values: qualifying rates ---
HITTER_PA_PER_GAME = 1.5
PITCHER_IP_PER_GAME = 0.75
INFIELD = ("Pitcher", "Catcher", "First Base", "Second Base", "Third Base", "Shortstop")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


# --- lines -------------------------------------------------------------------------------

def batting_lines(pas: DataFrame, *keys: str) -> DataFrame:
    """Counts and slash line of every group."""
    sums = {n: F.sum(f"{n}_value") for n in ("AB", "H", "BB", "HBP", "SO", "SF", "TB", "OBP_num", "OBP_den")}
    hits = {label: count_if(F.col("event_type") == e) for label, e in (("1B", "single"), ("2B", "double"), ("3B", "triple"), ("HR", "home_run"))}
    grouped = pas.groupBy(*keys).agg(
        F.count("*").alias("PA"), *[c.alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in hits.items()]
    )
    return grouped.withColumns({
        "BA": ratio("H", "AB"), "OBP": ratio("OBP_num", "OBP_den"), "SLG": ratio("TB", "AB"),
        "OPS": ratio0("OBP_num", "OBP_den") + ratio0("TB", "AB"),
    }).drop("TB", "OBP_num", "OBP_den")


SUMMED_NOT = ("wOBA", "ERA", "FIP", "ERA_minus_FIP", "RA7", "OBP")


def combine_seasons(rows: DataFrame, kind: str) -> DataFrame:
    """Several seasons of a player in one row; a single season stays as it is.

    Numbers add up; wOBA and OBP are weighted by PA, ERA comes from the sums, FIP is weighted
    by batters faced.
    """
    numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("long", "integer", "double") and f.name not in ("season", *SUMMED_NOT)]
    aggregates = [F.max_by("player", "season").alias("player"), F.count("*").alias("seasons"), *[F.sum(c).alias(c) for c in numeric]]
    single = {c: F.any_value(c) for c in SUMMED_NOT if c in rows.columns}
    if kind == "position":
        weighted = {c: ratio(F.sum(zero(c) * zero("PA")), F.sum("PA")) for c in ("wOBA", "OBP")}
    else:
        era = ratio(7 * F.sum("ER"), F.sum("IP"))
        fip = ratio(F.sum(zero("FIP") * zero("FIP_BF")), F.sum("FIP_BF"))
        weighted = {"ERA": era, "FIP": fip, "ERA_minus_FIP": era - fip, "RA7": F.lit(None).cast("double")}
    one = F.count("*") == 1
    rates = [F.when(one, single[c]).otherwise(v).alias(c) for c, v in weighted.items() if c in single]
    return rows.groupBy("player_key").agg(*aggregates, *rates)


# fixed values: field names of the official season lines
OFFICIAL_BATTING = (
    "plateAppearances", "atBat", "hits", "doubles", "triples", "homeRuns", "baseonBalls", "hitByPitch", "strikeOuts",
    "stolenBasesAttempts", "stolenBases", "caughtStealing", "sacrificeFly",
)
OFFICIAL_PITCHING = (
    "appearances", "gamesStarted", "hitsAllowed", "baseOnBalls", "strikeOuts", "numberOfPitches", "strikes", "wins",
    "losses", "earnedRuns",
)


def merge_official_batting(rows: DataFrame) -> DataFrame:
    """Official batting of several seasons with the rates computed again."""
    out = rows.groupBy("player_key").agg(*[F.sum(zero(c)).alias(c) for c in OFFICIAL_BATTING])
    bases = F.col("hits") + F.col("doubles") + 2 * F.col("triples") + 3 * F.col("homeRuns")
    reached = F.col("hits") + F.col("baseonBalls") + F.col("hitByPitch")
    chances = F.col("atBat") + F.col("baseonBalls") + F.col("hitByPitch") + F.col("sacrificeFly")
    return out.withColumns({
        "battingAverage": ratio("hits", "atBat"), "onBasePercentage": ratio(reached, chances), "sluggingPercentage": ratio(bases, "atBat"),
        "opsPercentage": ratio0(reached, chances) + ratio0(bases, "atBat"),
    })


def merge_official_pitching(rows: DataFrame) -> DataFrame:
    """Official pitching of several seasons; innings such as 6.2 are added as outs."""
    whole = F.floor("inningsPitched")
    outs = whole * 3 + F.bround((F.col("inningsPitched") - whole) * 10, 0).cast("bigint")
    out = rows.groupBy("player_key").agg(*[F.sum(zero(c)).alias(c) for c in OFFICIAL_PITCHING], F.sum(outs).alias("outs"))
    innings = F.col("outs") / 3
    return out.withColumn("inningsPitched", innings).withColumns({
        "earnedRunAverage": ratio(7 * F.col("earnedRuns"), innings),
        "whip": ratio(F.col("hitsAllowed") + F.col("baseOnBalls"), innings),
    }).drop("outs")


def official_or(official: str, derived: str) -> Column:
    """Official value unless zero or missing, else the derived one."""
    return F.coalesce(F.nullif(F.col(official), F.lit(0)), F.col(derived), F.lit(0))


def hitting_line(derived: DataFrame, official: DataFrame, contact: DataFrame) -> DataFrame:
    """Public hitting line. ``derived``: player_key and batting line; ``contact``: bunts, GB_pct."""
    rows = derived.join(official.withColumn("_has", F.lit(True)), "player_key", "full_outer").join(contact, "player_key", "left")
    has = F.col("_has").isNotNull()
    pairs = {
        "PA": ("plateAppearances", "PA"), "AB": ("atBat", "AB"), "H": ("hits", "H"), "K": ("strikeOuts", "SO"), "BB": ("baseonBalls", "BB"),
        "HBP": ("hitByPitch", "HBP"), "HR": ("homeRuns", "HR"), "_2B": ("doubles", "2B"), "_3B": ("triples", "3B"),
    }
    lines = rows.select(
        "player_key",
        *[official_or(*p).alias(n) for n, p in pairs.items()],
        zero("stolenBasesAttempts").alias("SBA"), zero("stolenBases").alias("SB"), zero("caughtStealing").alias("CS"),
        zero("bunts").alias("Bunts"),
        *[F.when(has, F.col(o)).otherwise(F.col(d)).alias(d) for o, d in (
            ("battingAverage", "BA"), ("onBasePercentage", "OBP"), ("sluggingPercentage", "SLG"), ("opsPercentage", "OPS"))],
        "GB_pct",
    )
    return lines.where("PA > 0").withColumns({
        "XBH": F.col("_2B") + F.col("_3B") + F.col("HR"), "K_pct": ratio("K", "PA"), "BB_pct": ratio("BB", "PA"),
    }).drop("_2B", "_3B")


def pitching_line(advanced: DataFrame, official: DataFrame, pitched: DataFrame) -> DataFrame:
    """Public pitching line. ``pitched``: player_key, pitches, strikes_seen from the play-by-play."""
    rows = advanced.join(official.withColumn("_has", F.lit(True)), "player_key", "full_outer").join(pitched, "player_key", "left")
    innings = F.coalesce(F.nullif(F.col("inningsPitched"), F.lit(0.0)), F.col("IP"), F.lit(0.0))
    lines = rows.select(
        "player_key", innings.alias("IP"),
        official_or("hitsAllowed", "H_allowed").alias("H"), official_or("baseOnBalls", "BB_allowed").alias("BB"),
        official_or("strikeOuts", "SO_pitching").alias("SO"), official_or("appearances", "G").alias("App"),
        official_or("gamesStarted", "GS").alias("GS"), official_or("numberOfPitches", "pitches").alias("Pitches"),
        official_or("strikes", "strikes_seen").alias("Strikes"), zero("wins").alias("W"), zero("losses").alias("L"),
        F.when(F.col("_has").isNotNull(), F.col("earnedRunAverage")).otherwise(F.col("ERA")).alias("ERA"), F.col("whip").alias("_whip"),
    ).where("IP > 0")
    return lines.withColumns({
        "WHIP": F.coalesce("_whip", ratio(F.col("H") + F.col("BB"), "IP")), "SO7": 7 * F.col("SO") / F.col("IP"), "BB7": 7 * F.col("BB") / F.col("IP"),
        "S_pct": ratio("Strikes", "Pitches"),
    }).drop("_whip")


# --- matchups, context and logs ----------------------------------------------------------

def matchups(pas: DataFrame, *keys: str) -> DataFrame:
    """Line of every batter against every pitcher."""
    return batting_lines(pas, *keys, "batter_key", "pitcher_key")


def local_date(ts: Column) -> Column:
    """Calendar date of a start in the league's zone."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def game_context(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Runs for and against, result and local date of every team's game.

    A team's opponent is the fielding team of its own half-innings, so one grouping of the
    events and a swap of its columns give both views.
    """
    scored = events.groupBy("canonical_id", "season", F.col("batting_team").alias("team"), F.col("fielding_team").alias("opponent")).agg(
        F.sum(zero("runs_scored")).alias("runs")
    )
    sides = F.array(
        F.struct(F.col("team"), F.col("opponent"), F.col("runs").alias("runs"), F.lit(0).cast("bigint").alias("allowed")),
        F.struct(F.col("opponent").alias("team"), F.col("team").alias("opponent"), F.lit(0).cast("bigint").alias("runs"), F.col("runs").alias("allowed")),
    )
    both = scored.select("canonical_id", "season", F.explode(sides).alias("s")).select("canonical_id", "season", "s.*")
    totals = both.groupBy("canonical_id", "season", "team", "opponent").agg(F.sum("runs").alias("runs"), F.sum("allowed").alias("allowed"))
    letter = F.when(F.col("runs") > F.col("allowed"), "W").when(F.col("runs") < F.col("allowed"), "L").otherwise("T")
    return totals.join(starts.select("canonical_id", local_date(F.col("game_ts")).alias("date")), "canonical_id", "left").withColumn(
        "result", F.concat(letter, F.lit(" "), F.col("runs").cast("string"), F.lit("-"), F.col("allowed").cast("string"))
    )


def hitter_game_logs(pas: DataFrame, context: DataFrame) -> DataFrame:
    """Player-game line with its plate appearances in order (a game's few appearances)."""
    lines = batting_lines(pas, "canonical_id", "batter_key", "batting_team")
    listed = pas.groupBy("canonical_id", "batter_key", "batting_team").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("event_order"), F.col("inning"), F.col("half"), F.col("pitcher"), X.result_label(F.col("event_type")).alias("result"),
            F.col("pitch_text").alias("sequence"), F.col("play_text").alias("play"),
        ))).alias("plate_appearances")
    )
    joined = lines.join(listed, ["canonical_id", "batter_key", "batting_team"])
    facts = context.select("canonical_id", F.col("team").alias("batting_team"), "opponent", "result", "date")
    return joined.join(facts, ["canonical_id", "batting_team"], "left")


def pitcher_game_logs(pas: DataFrame, box: DataFrame, context: DataFrame) -> DataFrame:
    """Player-game line from the box score where there is one, else from the events."""
    outs = F.sum(F.greatest(F.lit(0), F.col("outs_after") - F.col("outs_before")))
    seen = pas.groupBy("canonical_id", "pitcher_key", F.col("fielding_team").alias("team")).agg(
        F.count("*").alias("BF"), outs.alias("outs"), F.sum(zero("runs_scored")).alias("runs"), count_if(is_in(S.HITS)).alias("hits"),
        F.sum("BB_value").alias("walks"), F.sum("SO_value").alias("strikeouts"),
    )
    official = box.select(
        "canonical_id", F.col("player_key").alias("pitcher_key"), "innings_decimal", "H", "R", "ER", "BB", "SO", F.lit(True).alias("_has")
    )
    has = F.col("_has").isNotNull()
    # innings in text form: whole innings, then the odd outs behind the point
    by_outs = F.floor(F.col("outs") / 3.0) + (F.col("outs") % 3) / 10.0

    def pick(name, other):
        return F.when(has, F.coalesce(name, F.lit(0))).otherwise(F.col(other)).cast("bigint").alias(name)

    rows = seen.join(official, ["canonical_id", "pitcher_key"], "left").select(
        "canonical_id", "pitcher_key", "team", F.when(has, F.col("innings_decimal")).otherwise(by_outs).alias("IP"),
        pick("H", "hits"), pick("R", "runs"), pick("ER", "runs"), pick("BB", "walks"), pick("SO", "strikeouts"), "BF",
    )
    return rows.join(context.select("canonical_id", "team", "opponent", "result", "date"), ["canonical_id", "team"], "left")


# --- spray, approach, small ball ---------------------------------------------------------

def filled(rows: DataFrame, keys: list[str], column: str, values) -> DataFrame:
    """Every key with every value of a fixed list, missing rows as NULL."""
    grid = rows.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, values))).alias(column))
    return grid.join(rows, [*keys, column], "left")


def spray_counts(pas: DataFrame, *keys: str) -> DataFrame:
    """Contact events per field location with share and heat band; locations without any are 0."""
    located = pas.where(F.col("spray").isNotNull() & is_in(S.CONTACT_EVENTS))
    counts = located.groupBy(*keys, F.col("spray").alias("location")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    rows = filled(counts, list(keys), "location", S.FIELD_LOCATIONS).join(totals, list(keys)).withColumn("n", zero("n"))
    share = F.col("n") / F.col("total")
    band = F.when(share > 0.30, "hot").when(share > 0.20, "warm").when(share > 0.10, "mild").otherwise("cold")
    return rows.withColumns({"share": share, "band": band})


def batted_balls(pas: DataFrame) -> DataFrame:
    """The list behind the spray chart."""
    return pas.where(F.col("spray").isNotNull() & is_in(S.CONTACT_EVENTS)).select(
        "canonical_id", "event_order", "batter_key", F.col("spray").alias("location"),
        F.when(F.col("contact") == "Other", "Batted Ball").otherwise(F.col("contact")).alias("contact"),
        X.result_label(F.col("event_type")).alias("result"), F.to_date("game_start").alias("date"), "pitcher",
    )


def pitch_rows(pas: DataFrame, *keep: str) -> DataFrame:
    """One row per pitch with the count before it."""
    return pas.select(*keep, F.posexplode(X.pitches(F.col("pitch_text"), F.col("event_type"))).alias("number", "p")).select(
        *keep, (F.col("number") + 1).alias("pitch_number"), "p.*"
    )


def approach(pitches: DataFrame, *keys: str) -> DataFrame:
    """Swing and called-strike rates per count for every key and for the league (key NULL)."""
    counted = pitches.where(F.col("count").isin(*S.COUNTS)).groupBy(*keys, "count").agg(
        F.count("*").alias("pitches"), count_if(F.col("swing")).alias("swings"), count_if(F.col("called")).alias("called_strikes")
    )
    own = filled(counted, list(keys), "count", S.COUNTS)
    sums = [F.sum(c).alias(c) for c in ("pitches", "swings", "called_strikes")]
    league = counted.groupBy("count").agg(*sums).select(*[F.lit(None).cast("string").alias(k) for k in keys], "count", "pitches", "swings", "called_strikes")
    rows = own.unionByName(league)
    for name in ("pitches", "swings", "called_strikes"):
        rows = rows.withColumn(name, zero(name))
    return rows.withColumns({"swing_pct": ratio("swings", "pitches"), "called_strike_pct": ratio("called_strikes", "pitches")})


def approach_difference(rows: DataFrame, key: str, edge: float = 0.025) -> DataFrame:
    """Player minus league swing rate per count with a band."""
    league = rows.where(F.col(key).isNull()).select("count", F.col("swing_pct").alias("league_swing_pct"))
    joined = rows.where(F.col(key).isNotNull()).join(F.broadcast(league), "count")
    gap = F.col("swing_pct") - F.col("league_swing_pct")
    return joined.select(
        key, "count", gap.alias("difference"), F.when(gap > edge, "above").when(gap < -edge, "below").when(gap.isNotNull(), "even").alias("band")
    )


def small_ball(pas: DataFrame, *keys: str) -> DataFrame:
    """Bunts, grounders and grounder share of balls in play."""
    contact, known = F.col("contact") != "Other", is_in(S.CONTACT_EVENTS) & F.col("spray").isNotNull()
    ground = F.col("contact") == "Ground"
    rows = pas.groupBy(*keys).agg(
        count_if(F.col("contact") == "Bunt").alias("bunts"), count_if(ground).alias("ground_balls"),
        count_if(ground & F.coalesce(F.col("spray").isin(*INFIELD), F.lit(False))).alias("infield_ground_balls"),
        count_if(contact | known).alias("balls_in_play"),
    )
    return rows.withColumn("GB_pct", ratio("ground_balls", "balls_in_play"))


def running_routes(opportunities: DataFrame, *keys: str) -> DataFrame:
    action, start, to = F.col("action"), F.col("start_base"), F.col("destination")

    def route(kind, a, b):
        return count_if((action == kind) & (start == a) & F.coalesce(to == b, F.lit(False)))

    return opportunities.where("role = 'runner'").groupBy(*keys).agg(
        F.count("*").alias("opportunities"),
        count_if(action.isin("advance", "score") & (F.coalesce(to, F.lit(0)) - start >= 2)).alias("extra_bases_taken"),
        route("advance", 1, 3).alias("first_to_third"), route("score", 2, 4).alias("second_to_home"), route("score", 1, 4).alias("first_to_home"),
        count_if(action == "out").alias("advancement_outs"),
    )


# --- qualifying and percentiles ----------------------------------------------------------

def qualifiers(context: DataFrame, pa_rate: float = HITTER_PA_PER_GAME, ip_rate: float = PITCHER_IP_PER_GAME) -> DataFrame:
    """Thresholds per period from the rounded mean number of team games."""
    games = context.groupBy("period", "team").agg(F.count_distinct("canonical_id").alias("games"))
    mean = games.groupBy("period").agg(F.bround(F.avg("games"), 0).alias("qualifier_games"))
    return mean.withColumns({
        "hitting_pa": F.ceil(pa_rate * F.col("qualifier_games")).cast("bigint"), "pitching_ip": ip_rate * F.col("qualifier_games"),
    })


def unpivot_metrics(rows: DataFrame, metrics: dict[str, tuple[str, bool]], *keys: str) -> DataFrame:
    """(keys, player_key, metric, value, lower_is_better) from one column per metric."""
    table = F.array(*[
        F.struct(F.lit(label).alias("metric"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"), F.lit(lower).alias("lower_is_better"))
        for label, (c, lower) in metrics.items()
    ])
    return rows.select(*keys, "player_key", F.explode(table).alias("m")).select(*keys, "player_key", "m.*")


def percentiles(long: DataFrame, *keys: str) -> DataFrame:
    """Mid-rank percentile (1..99, half-even) and rank in the pool of every metric.

    The exact place comes from range-partitioned numbering, so a pool or a tie of any size is
    spread over tasks. A value's first and last place then give the counts below and equal.
    """
    pool = [*keys, "metric"]
    placed = ordered_number(long, pool, [F.col("value").asc(), F.col("player_key").asc()], "place")
    # numbering from the better end: for higher-is-better metrics ties keep key order
    values = placed.groupBy(*pool, "value").agg(F.min("place").alias("low"), F.count("*").alias("equal"))
    sizes = values.groupBy(*pool).agg(F.sum("equal").alias("of"))
    joined = placed.join(values, [*pool, "value"]).join(F.broadcast(sizes), pool)
    below, equal, of = F.col("low") - 1, F.col("equal"), F.col("of")
    score = 100 * (below + 0.5 * equal) / of
    score = F.when(F.col("lower_is_better"), 100 - score).otherwise(score)
    within = F.col("place") - F.col("low")
    rank = F.when(F.col("lower_is_better"), F.col("place")).otherwise(of - below - equal + within + 1)
    return joined.select(
        *pool, "player_key", "value", F.greatest(F.lit(1), F.least(F.lit(99), F.bround(score, 0).cast("int"))).alias("percentile"),
        rank.cast("bigint").alias("rank"), "of",
    )


# --- teams -------------------------------------------------------------------------------

def team_records(context: DataFrame) -> DataFrame:
    runs, allowed = F.col("runs"), F.col("allowed")
    return context.groupBy("period", "team").agg(
        F.count("*").alias("games"), count_if(runs > allowed).alias("wins"), count_if(runs < allowed).alias("losses"),
        count_if(runs == allowed).alias("ties"), F.sum("runs").alias("runs"), F.sum("allowed").alias("runs_allowed"),
    ).withColumn("runs_per_game", ratio("runs", "games"))


def team_summary(records: DataFrame, hitters: DataFrame, pitchers: DataFrame, catching: DataFrame) -> DataFrame:
    """Record with staff ERA, weighted OPS, defensive value and catching.

    ``hitters``: period, team, PA, OPS, defensive_war; ``pitchers``: period, team, IP, ER;
    ``catching``: period, team, sb, cs.
    """
    keys = ["period", "team"]
    bats = hitters.groupBy(*keys).agg(ratio(F.sum(F.col("OPS") * F.col("PA")), F.sum("PA")).alias("OPS"), F.sum("defensive_war").alias("defensive_war"))
    arms = pitchers.groupBy(*keys).agg(ratio(7 * F.sum("ER"), F.sum("IP")).alias("ERA"))
    caught = catching.groupBy(*keys).agg(F.sum("sb").alias("stolen_bases_allowed"), F.sum("cs").alias("caught_stealing"))
    return (
        records.join(bats, keys, "left").join(arms, keys, "left").join(caught, keys, "left")
        .withColumn("attempts", F.col("stolen_bases_allowed") + F.col("caught_stealing"))
        .withColumn("caught_pct", ratio("caught_stealing", "attempts"))
    )


def team_leaders(players: DataFrame, lists: dict[str, tuple], *keys: str) -> DataFrame:
    """Top players per team for several lists of (order, size) or (order, size, who may be on it), one pruned window each."""
    out = []
    for name, (order, size, *allowed) in lists.items():
        window = Window.partitionBy(*keys).orderBy(*order)
        rows = players.where(allowed[0]) if allowed else players
        out.append(rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= size).select(*keys, F.lit(name).alias("list"), "place", "player_key"))
    return reduce(lambda a, b: a.unionByName(b), out)


def team_rankings(teams: DataFrame, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """Places 1..n per metric; a league's teams per period are few."""
    table = F.array(*[
        F.struct(F.lit(label).alias("metric"), (F.coalesce(c, F.lit(0.0)) * (-1.0 if high else 1.0)).alias("sort")) for label, (c, high) in metrics.items()
    ])
    rows = teams.select("period", "team", F.explode(table).alias("m")).select("period", "team", "m.*")
    place = F.row_number().over(Window.partitionBy("period", "metric").orderBy("sort", "team"))
    return rows.select("period", "team", "metric", place.alias("place"))


def pythagorean(records: DataFrame, exponent: float = 2.0) -> DataFrame:
    """Expected wins from runs, and the difference to the record."""
    r, a = F.pow("runs", F.lit(exponent)), F.pow("runs_allowed", F.lit(exponent))
    pct = ratio(r, r + a)
    return records.select("period", "team", "games", "wins", pct.alias("expected_pct")).withColumns({
        "expected_wins": F.col("expected_pct") * F.col("games"), "luck": F.col("wins") - F.col("expected_pct") * F.col("games"),
    }).withColumns({
        "rounded_wins": F.round("expected_wins", 0).cast("bigint"), "rounded_losses": F.col("games") - F.round("expected_wins", 0).cast("bigint"),
    })


def pythagorean_study(records: DataFrame) -> DataFrame:
    """Exponent 0.50 .. 3.50 with the least squared error: pooled, and trained on each season.

    Every team season meets the 301 exponents; the sums are partial, so the grid never grows
    past 301 rows per season.
    """
    seasons = records.where("period <> 'combined' and runs > 0 and runs_allowed > 0 and wins + losses > 0")
    tried = seasons.select(
        "period", "runs", "runs_allowed", (F.col("wins") / (F.col("wins") + F.col("losses"))).alias("pct"),
        F.explode(F.transform(F.sequence(F.lit(50), F.lit(350)), lambda e: e / 100.0)).alias("exponent"),
    )
    ratio_power = F.pow("runs", "exponent") / (F.pow("runs", "exponent") + F.pow("runs_allowed", "exponent"))
    errors = tried.groupBy("period", "exponent").agg(F.sum(F.pow(ratio_power - F.col("pct"), F.lit(2.0))).alias("se"), F.count("*").alias("n"))
    folds = F.array(F.lit("pooled"), F.col("period"))
    train = errors.select("exponent", "se", "n", F.explode(folds).alias("fold")).groupBy("fold", "exponent").agg(
        (F.sum("se") / F.sum("n")).alias("mse"), F.sum("n").alias("n")
    )
    best = train.groupBy("fold").agg(
        F.min_by("exponent", F.struct("mse", "exponent")).alias("fitted_exponent"), F.min("mse").alias("training_mse"),
        F.max(F.when(F.col("exponent") == 2.0, F.col("mse"))).alias("standard_training_mse"), F.any_value("n").alias("team_seasons"),
    )
    # test error of a season's exponent on the other seasons = totals minus the season itself
    totals = errors.groupBy("exponent").agg(F.sum("se").alias("all_se"), F.sum("n").alias("all_n"))
    rest = errors.join(F.broadcast(totals), "exponent").select(
        F.col("period").alias("fold"), "exponent", ratio(F.col("all_se") - F.col("se"), F.col("all_n") - F.col("n")).alias("test")
    )
    fitted = best.join(rest, (best.fold == rest.fold) & (best.fitted_exponent == rest.exponent), "left").select(best["*"], rest.test.alias("test_mse"))
    standard = rest.where("exponent = 2.0").select("fold", F.col("test").alias("standard_test_mse"))
    return fitted.join(standard, "fold", "left")


def base_override(teams: DataFrame, base: DataFrame, fields: list[str]) -> DataFrame:
    """Team fields taken from a base period where the team exists there."""
    taken = base.select("team", *[F.col(f).alias(f"_{f}") for f in fields])
    return teams.drop(*fields).join(taken, "team").withColumnsRenamed({f"_{f}": f for f in fields})


def leaderboard_rows(combined: DataFrame, offense: DataFrame) -> DataFrame:
    """Combined rows with the batting columns the boards show."""
    return combined.join(offense.select("season", "player_key", "wOBA", "H", "HR", "BB", "SO"), ["season", "player_key"], "left")
