"""Raw play rows to typed events.

Text is read with columns, halves and pitchers come from windows. Each row becomes a list of
moments (a runner is out, the batter arrives, ...); the base state, which depends on everything
before it in a half-inning, is an aggregate over the moments of that half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions import text as X
from basepaths.functions.identity import literal_map, person_key
from basepaths.functions.lines import count_if
from basepaths.session import cut_lineage

ENDED = "half-inning ended"


def clean(text: Column) -> Column:
    return F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")))


def longest_first(names: Column) -> Column:
    """Order a game's names once, so the first match is the longest."""
    return F.array_sort(names, lambda a, b: F.length(b) - F.length(a))


def name_at_start(text: Column, names: Column) -> Column:
    """First of ``names`` (longest first) the text starts with."""
    return X.let(F.lower(F.trim(text)), lambda low: F.get(F.filter(names, lambda n: F.startswith(low, F.lower(n))), F.lit(0)))


def named_with(text: Column, names: Column, *suffixes: str) -> Column:
    """First of ``names`` (longest first) that is followed by one of the suffixes."""

    def said(low, name):
        found = F.lit(False)
        for suffix in suffixes:
            found = found | F.contains(low, F.concat(F.lower(name), F.lit(suffix)))
        return found

    first = X.let(F.lower(text), lambda low: F.get(F.filter(names, lambda n: said(low, n)), F.lit(0)))
    return F.when(_any_of(F.lower(text), suffixes), first)


def _any_of(low: Column, words) -> Column:
    """Whether one of the words is there at all; where none is, no name needs to be tried."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(low, F.lit(word))
    return found


def detect_halves(rows: DataFrame, hitters: DataFrame) -> DataFrame:
    """Batter, batting team, inning and half of every row; a change of team opens a half.

    ``rows``: canonical_id, row_no (oldest first), pitch, play. ``hitters``: canonical_id,
    names (array), team_of (map name key -> team). Rows before the first known batter keep a
    NULL team (unresolved).
    """
    in_order = Window.partitionBy("canonical_id").orderBy("row_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumns({"pitch": clean(F.col("pitch")), "play": clean(F.col("play"))})
        .join(hitters.withColumn("names", longest_first(F.col("names"))), "canonical_id", "left")
        .withColumn("batter", name_at_start(F.col("play"), F.col("names")))
        .withColumn("_team", F.try_element_at("team_of", person_key(F.col("batter"))))
        .withColumn("batting_team", F.last("_team", ignorenulls=True).over(so_far))
        .withColumn("_previous", F.last("_team", ignorenulls=True).over(before))
        .withColumn("_new", F.when(F.col("_team").isNotNull() & ~F.col("_team").eqNullSafe(F.col("_previous")), 1).otherwise(0))
        .withColumn("half_index", (F.sum("_new").over(so_far) - 1).cast("int"))
        .withColumn("inning", F.floor(F.col("half_index") / 2.0).cast("int") + 1)
        .withColumn("half", F.when(F.col("half_index") % 2 == 0, "top").otherwise("bottom"))
        .drop("_team", "_previous", "_new", "team_of")
    )


def carry_pitchers(rows: DataFrame, staffs: DataFrame) -> DataFrame:
    """Current pitcher of the fielding team: last one named in the text, else the first listed.

    ``rows`` needs fielding_team; ``staffs``: canonical_id, team, pitchers (array in listing order).
    """
    listed = staffs.select(
        "canonical_id", F.col("team").alias("fielding_team"), F.get("pitchers", F.lit(0)).alias("_starter"), longest_first(F.col("pitchers")).alias("_staff")
    )
    both = rows.join(listed, ["canonical_id", "fielding_team"], "left")
    suffixes = (" pitching", " in for pitcher")
    told = F.coalesce(named_with(F.col("play"), F.col("_staff"), *suffixes), named_with(F.col("pitch"), F.col("_staff"), *suffixes))
    so_far = Window.partitionBy("canonical_id", "fielding_team").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_told", told)
        .withColumn("pitcher", F.coalesce(F.last("_told", ignorenulls=True).over(so_far), F.col("_starter")))
        .drop("_told", "_starter", "_staff")
    )


_CLAUSES = "array<struct<runner:string,key:string,kind:string,destination:int>>"


def runner_clauses(text: Column, names: Column) -> Column:
    """Named runner actions of a text in order: array of (runner, key, kind, destination).

    Kinds are score, out, advance, remain, remain_third.
    """
    base = literal_map({"1st": 1, "2nd": 2, "3rd": 3, "home": 4})

    def read(clause):
        low = F.lower(clause)
        place = F.try_element_at(base, F.regexp_extract(low, r"(?:to|at) (1st|2nd|3rd|home)\b", 1))
        stays, moves = low.rlike("remains at|held up at"), low.rlike(r"advances to|\bsteals?\b")
        kind = (
            F.when(low.contains("did not score"), "remain_third")
            .when(low.rlike("caught stealing|out advancing|(^| )out at |picked off"), "out")
            .when(low.rlike(r"\bscores?\b") | (place == 4), "score")
            .when(stays & place.isNotNull(), "remain")
            .when(moves & place.isNotNull(), "advance")
        )
        return F.struct(name_at_start(clause, names).alias("runner"), kind.alias("kind"), place.alias("destination"))

    known = F.filter(F.transform(F.split(clean(text), r",\s*"), read), lambda c: c["runner"].isNotNull() & c["kind"].isNotNull())
    return F.transform(
        known, lambda c: F.struct(c["runner"].alias("runner"), person_key(c["runner"]).alias("key"), c["kind"].alias("kind"), c["destination"].alias("destination"))
    ).cast(_CLAUSES)


def in_effect(clauses: Column) -> Column:
    """Scores and outs first, then the moves of runners who are still on."""
    final = F.filter(clauses, lambda c: c["kind"].isin("score", "out"))
    gone = F.transform(final, lambda c: c["key"])
    return F.concat(final, F.filter(clauses, lambda c: ~c["kind"].isin("score", "out") & ~F.array_contains(gone, c["key"])))


def pinch_runner(text: Column, names: Column) -> Column:
    """(new, old) runner of a substitution in the pitch text."""
    def read(low):
        marked = F.filter(names, lambda n: F.contains(low, F.concat(F.lit("pinch runner "), F.lower(n), F.lit(" in for"))))
        rest = F.regexp_extract(low, "(?s)pinch runner .*? in for(.*)$", 1)
        return X.let(F.struct(F.get(marked, F.lit(0)).alias("new"), rest.alias("rest")), replaced)

    def replaced(said):
        old = F.get(F.filter(names, lambda n: (n != said["new"]) & F.contains(said["rest"], F.lower(n))), F.lit(0))
        return F.when(said["new"].isNotNull() & old.isNotNull(), F.struct(said["new"].alias("new"), person_key(old).alias("old")))

    return F.when(F.contains(F.lower(text), F.lit("pinch runner ")), X.let(F.lower(text), read))


# --- base state --------------------------------------------------------------------------

_ON = "array<struct<base:int,runner:string,key:string>>"
_LOG = "array<struct<runner:string,action:string,from_base:int,to_base:int,reason:string>>"
_EVENT = (
    "struct<row_no:int,step:int,event_type:string,is_plate_appearance:boolean,batter:string,outs_before:int,bases_before:int,runners_before:map<int,string>,"
    f"outs_after:int,bases_after:int,runners_after:map<int,string>,runs_scored:int,runner_actions:{_LOG},state_errors:int>"
)
_HALF = f"struct<on:{_ON},outs:int,was:{_ON},outs_was:int,log:{_LOG},runs:int,events:array<{_EVENT}>>"
_MOMENT = "struct<what:string,row_no:int,kind:string,runner:string,key:string,base:int,flag:boolean>"
_WALKS = ("walk", "intentional_walk", "hit_by_pitch", "catcher_interference")
_NO_ROOM = "unnamed runner displaced from third; no run inferred"
_NO_RUN = "unnamed runner would cross home; no run inferred"


def _moment(what: str, row_no: Column, kind=None, runner=None, key=None, base=None, flag=None) -> Column:
    """One thing that happens to the bases; a display row is a list of them."""
    values = [F.lit(what), row_no, kind, runner, key, base, flag]
    return F.struct(*[F.lit(None) if v is None else v for v in values]).cast(_MOMENT)


def moments(row: dict[str, Column]) -> Column:
    """What a display row does, in order: substitution, runner event, end marker, plate appearance."""
    nothing = F.array().cast(f"array<{_MOMENT}>")
    n, batter, batter_key = row["row_no"], row["batter"], person_key(row["batter"])
    clause = lambda c: _moment("clause", n, c["kind"], c["runner"], c["key"], c["destination"])
    feed = F.when(row["feed_outs"].isNotNull(), F.array(_moment("outs", n, base=row["feed_outs"]))).otherwise(nothing)
    pinch = F.when(row["pinch"].isNotNull(), F.array(_moment("pinch", n, row["pinch"]["old"], row["pinch"]["new"], person_key(row["pinch"]["new"])))).otherwise(nothing)
    runner = F.when(row["runner_type"].isNotNull(), F.concat(
        F.array(_moment("open", n)), F.transform(row["runner_clauses"], clause), F.array(_moment("runner event", n, row["runner_type"], batter))
    )).otherwise(nothing)
    marker = F.when(row["ended"], F.array(_moment("end", n, runner=batter, flag=row["runner_type"].isNotNull()))).otherwise(nothing)
    told = F.exists(row["play_clauses"], lambda c: c["key"] == batter_key)
    walk = F.when(row["play_type"].isin(*_WALKS), F.array(_moment("walk", n, flag=told))).otherwise(nothing)
    arrival = F.when(row["destination"].isNotNull() & ~told, F.array(_moment("arrive", n, None, batter, batter_key, row["destination"]))).otherwise(nothing)
    play = F.when(~row["ended"] & row["play_type"].isNotNull(), F.concat(
        F.array(_moment("open", n)), F.transform(row["play_clauses"], clause), walk, arrival, F.array(_moment("play", n, row["play_type"], batter, base=row["play_outs"]))
    )).otherwise(nothing)
    return F.concat(feed, pinch, runner, marker, play)


def _someone(on: Column, base) -> Column:
    return F.exists(on, lambda x: x["base"] == base)


def _mask(on: Column) -> Column:
    return F.aggregate(on, F.lit(0), lambda m, x: m + F.when(x["base"] == 1, 1).when(x["base"] == 2, 2).otherwise(4))


def _names(on: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(on), lambda x: F.struct(x["base"], x["runner"])))


def _note(runner: Column, action, source, target, reason=None) -> Column:
    return F.array(F.struct(runner, F.lit(action) if isinstance(action, str) else action, source, target, F.lit(reason))).cast(_LOG)


def _without(on: Column, key: Column) -> Column:
    """The first to have come on base who bears the name or is the placed runner leaves."""
    first = F.array_position(F.transform(on, lambda x: F.coalesce((x["key"] == key) | (x["runner"] == S.PLACED_RUNNER), F.lit(False))), F.lit(True))
    return F.filter(on, lambda x, i: i + 1 != first)


def _with(on: Column, base: Column, runner: Column, key: Column) -> Column:
    return F.concat(F.filter(_without(on, key), lambda x: x["base"] != base), F.array(F.struct(base, runner, key).cast(_ON[6:-1])))


def _moved(half: Column, off, on_to, reason: str, noted: bool = True) -> Column:
    """``half`` after all runners for whom ``off`` or ``on_to`` (the new base) holds have gone, the foremost first."""
    going = F.reverse(F.array_sort(F.filter(half["on"], lambda x: off(x) | on_to(x).isNotNull())))

    def moved(gone):
        stay = F.filter(half["on"], lambda x: ~off(x) & on_to(x).isNull())
        placed = F.transform(F.filter(gone, lambda x: ~off(x)), lambda x: F.struct(on_to(x).alias("base"), x["runner"].alias("runner"), x["key"].alias("key")))
        log = F.transform(gone, lambda x: F.struct(
            x["runner"], F.when(off(x), "state_correction").otherwise("forced"), x["base"], F.when(~off(x), on_to(x)), F.when(off(x), reason)
        )).cast(_LOG)
        return half.withField("on", F.concat(stay, placed.cast(_ON))).withField("log", F.concat(half["log"], log) if noted else half["log"])

    return X.let(going, moved)


def _room(half: Column, base, reason: str, noted: bool = True) -> Column:
    """Whoever stands on ``base`` moves up one, and so do all he runs into; from third nobody goes home unnamed."""
    on = half["on"]
    pushed = lambda x: (x["base"] >= base) & ((x["base"] <= base) | _someone(on, base)) & ((x["base"] <= base + 1) | _someone(on, base + 1))
    return _moved(half, lambda x: pushed(x) & (x["base"] == 3), lambda x: F.when(pushed(x) & (x["base"] < 3), x["base"] + 1), reason, noted)


def _clause(half: Column, m: Column) -> Column:
    """A named runner is out, scores, or stands on a base from now on."""
    source = F.element_at(F.transform(F.array_sort(F.filter(half["on"], lambda x: x["key"] == m["key"])), lambda x: x["base"]), 1)
    source = F.when(F.exists(half["on"], lambda x: x["key"] == m["key"]), source)
    final = m["kind"].isin("out", "score")
    target = F.when(m["kind"] == "remain_third", 3).otherwise(m["base"])
    met = ~final & (m["kind"] != "remain_third") & F.exists(half["on"], lambda x: (x["base"] == target) & ~x["key"].eqNullSafe(m["key"]))
    action = F.when(final, m["kind"]).when(m["kind"] == "advance", "advance").otherwise("remain")
    to = F.when(m["kind"] == "score", 4).when(m["kind"] == "out", m["base"]).otherwise(target)

    def settle(pair):
        h = pair["h"]
        on = F.when(final, _without(h["on"], m["key"])).otherwise(_with(h["on"], target, m["runner"], m["key"]))
        return h.withField("on", on).withField("log", F.concat(h["log"], _note(m["runner"], action, pair["source"], to)))

    return X.let(F.struct(F.when(met, _room(half, target, _NO_ROOM)).otherwise(half).alias("h"), source.alias("source")), settle)


def _arrive(half: Column, m: Column) -> Column:
    """The batter reaches a base; others make as many bases as he, if nothing else is told."""
    first = _someone(half["on"], 1)
    two = _moved(half, lambda x: (x["base"] == 2) | ((x["base"] == 3) & first), lambda x: F.when(x["base"] == 1, 3), _NO_RUN)
    all_off = _moved(half, lambda x: F.lit(True), lambda x: F.lit(None).cast("int"), _NO_RUN)
    moved = F.when(m["base"] == 1, _room(half, 1, _NO_RUN)).when(m["base"] == 2, two).otherwise(all_off)
    return X.let(moved, lambda h: h.withField(
        "on", F.when(m["base"] < 4, _with(h["on"], m["base"], m["runner"], m["key"])).otherwise(_without(h["on"], m["key"]))
    ).withField("runs", h["runs"] + F.when(m["base"] == 4, 1).otherwise(0)))


def _walk(half: Column, m: Column) -> Column:
    """Runners forced by a walk move up; a run forced in counts only where the text tells of the batter."""
    full = _someone(half["on"], 1) & _someone(half["on"], 2) & _someone(half["on"], 3)
    return X.let(_room(half, 1, _NO_RUN, noted=False), lambda h: h.withField("runs", h["runs"] + F.when(full & m["flag"], 1).otherwise(0)))


def _happened(half: Column, m: Column, step: int, kind, is_pa: bool, outs: Column, runs: Column) -> Column:
    """``half`` with one more event; what happened since it was opened belongs to it."""
    named = F.transform(F.filter(half["on"], lambda x: x["runner"] != S.PLACED_RUNNER), lambda x: F.coalesce(x["key"], F.lit("")))
    event = F.struct(
        m["row_no"], F.lit(step), kind, F.lit(is_pa), m["runner"], half["outs_was"], _mask(half["was"]), _names(half["was"]), outs, _mask(half["on"]), _names(half["on"]),
        runs, half["log"], F.size(named) - F.size(F.array_distinct(named)),
    ).cast(_EVENT)
    return half.withField("events", F.concat(half["events"], F.array(event))).withField("outs", outs)


def _opened(half: Column) -> Column:
    return half.withField("was", half["on"]).withField("outs_was", half["outs"]).withField("log", F.array().cast(_LOG)).withField("runs", F.lit(0))


def _next(half: Column, m: Column) -> Column:
    told = lambda action: F.size(F.filter(half["log"], lambda a: a["action"] == action))
    swapped = F.transform(half["on"], lambda x: F.when(x["key"] == m["kind"], F.struct(x["base"].alias("base"), m["runner"].alias("runner"), m["key"].alias("key"))).otherwise(x)).cast(_ON)
    capped = lambda outs: F.least(F.lit(3), half["outs"] + outs)
    over = m["flag"] & (half["outs"] >= 3)
    return (
        F.when(m["what"] == "outs", half.withField("outs", m["base"])).when(m["what"] == "pinch", half.withField("on", swapped))
        .when(m["what"] == "open", _opened(half)).when(m["what"] == "clause", _clause(half, m)).when(m["what"] == "walk", _walk(half, m))
        .when(m["what"] == "arrive", _arrive(half, m))
        .when(m["what"] == "runner event", _happened(half, m, 0, m["kind"], False, capped(told("out")), told("score")))
        .when(m["what"] == "end", F.when(over, half).otherwise(X.let(_opened(half), lambda h: _happened(h, m, 1, F.lit("runner_out"), False, F.lit(3), F.lit(0)))))
        .otherwise(_happened(half, m, 1, m["kind"], True, capped(F.greatest(told("out"), m["base"])), told("score") + half["runs"]))
    ).cast(_HALF)


def read_rows(rows: DataFrame) -> DataFrame:
    """Everything the fold needs as columns. ``rows`` carries names, pitch, play and batter."""
    ended = F.startswith(F.lower("play"), F.lit(ENDED))
    runner_text = F.when(F.col("pitch") != "", F.col("pitch")).when(F.col("batter").isNull(), F.col("play")).otherwise("")
    is_pa = F.col("batter").isNotNull() & ~ended
    typed = rows.withColumns({
        "ended": ended,
        "runner_type": X.runner_event_type(runner_text),
        "play_type": F.when(is_pa, X.play_type(F.col("play"))),
        "runner_clauses": runner_clauses(runner_text, F.col("names")),
        "play_clauses": F.when(is_pa, runner_clauses(F.col("play"), F.col("names"))),
        "pinch": pinch_runner(F.col("pitch"), F.col("names")),
        "feed_outs": F.lit(None).cast("int"),
    })
    return typed.withColumns({
        "runner_clauses": in_effect(F.col("runner_clauses")), "play_clauses": in_effect(F.col("play_clauses")),
        "destination": X.batter_destination(F.col("play_type")), "play_outs": X.outs_on_play(F.col("play_type"), F.col("play")),
    })


def fold_states(typed: DataFrame) -> DataFrame:
    """Base-out states: the moments of a half-inning folded in order.

    A group is one half-inning, so it holds some dozens of rows whatever the size of the data.
    """
    names = ("row_no", "batter", "ended", "runner_type", "play_type", "runner_clauses", "play_clauses", "pinch", "destination", "play_outs", "feed_outs")
    rows = typed.where(F.col("half_index") >= 0).select("canonical_id", "half_index", "inning", "row_no", moments({n: F.col(n) for n in names}).alias("m"))
    halves = rows.groupBy("canonical_id", "half_index").agg(F.min("inning").alias("inning"), F.sort_array(F.collect_list(F.struct("row_no", "m"))).alias("rows"))
    placed = F.array(F.struct(F.lit(2), F.lit(S.PLACED_RUNNER), F.lit(""))).cast(_ON)
    start = F.struct(
        F.when(F.col("inning") >= 8, placed).otherwise(F.array().cast(_ON)), F.lit(0), F.array().cast(_ON), F.lit(0), F.array().cast(_LOG), F.lit(0),
        F.array().cast(f"array<{_EVENT}>"),
    ).cast(_HALF)
    happened = F.flatten(F.transform("rows", lambda r: r["m"]))
    folded = halves.select("canonical_id", F.explode(F.aggregate(happened, start, _next)["events"]).alias("e"))
    return folded.select("canonical_id", "e.*")


def normalize_games(raw: DataFrame, hitters: DataFrame, staffs: DataFrame, games: DataFrame) -> DataFrame:
    """Raw play rows to events. ``games``: canonical_id, season, home_team, away_team."""
    halves = detect_halves(raw, hitters).join(games, "canonical_id")
    fielding = F.when(F.col("batting_team") == F.col("away_team"), F.col("home_team")).otherwise(F.col("away_team"))
    rows = carry_pitchers(halves.withColumn("fielding_team", fielding), staffs)
    facts = rows.select("canonical_id", "row_no", "season", "inning", "half", "batting_team", "fielding_team", "pitcher", "pitch", "play")
    folded = fold_states(read_rows(rows))
    in_game = Window.partitionBy("canonical_id").orderBy("row_no", "step")
    return folded.join(facts, ["canonical_id", "row_no"]).withColumn("event_order", F.row_number().over(in_game)).withColumn(
        "play_text", F.when(F.col("step") == 1, F.col("play")).otherwise("")
    ).drop("step", "play").withColumnsRenamed({"pitch": "pitch_text", "row_no": "display_row_index"})


def unresolved_rows(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Raw rows no event came from."""
    return raw.join(events.select("canonical_id", F.col("display_row_index").alias("row_no")).distinct(), ["canonical_id", "row_no"], "left_anti")


def state_violations(events: DataFrame) -> DataFrame:
    """Events with a runner on an illegal base or the same named runner twice."""
    named = F.filter(F.transform(F.map_values("runners_after"), lambda r: person_key(r)), lambda k: k != person_key(F.lit(S.PLACED_RUNNER)))
    illegal = F.exists(F.map_keys("runners_after"), lambda b: ~b.isin(1, 2, 3))
    return events.withColumns({"illegal_base": illegal, "duplicate_runner": F.size(named) != F.size(F.array_distinct(named))}).where(
        "illegal_base or duplicate_runner"
    )


# --- official feed -----------------------------------------------------------------------

def official_runs(plays: DataFrame) -> DataFrame:
    """Runs of every play as the growth of its team's score over all plays of the feed."""
    in_order = Window.partitionBy("canonical_id", "batting_team").orderBy("play_seqno")
    grown = F.col("team_score") - F.coalesce(F.lag("team_score").over(in_order), F.lit(0))
    return plays.where("play_seqno >= 0").withColumn("runs_scored", F.greatest(F.lit(0), grown))


def expand_names(text: Column, aliases: Column) -> Column:
    """Short names replaced by full names, longest first, and phrases put in the common form.

    ``aliases``: array of (alias, name) of the game.
    """
    ordered = F.array_sort(aliases, lambda a, b: F.length(b["alias"]) - F.length(a["alias"]))
    quoted = F.aggregate(
        ordered, F.coalesce(text, F.lit("")),
        lambda acc, a: F.regexp_replace(acc, F.concat(F.lit(r"(?i)(?<![A-Za-z])\Q"), a["alias"], F.lit(r"\E(?![A-Za-z])")), a["name"]),
    )
    # fixed values: phrases of the feed and their common form
    phrases = {
        " advanced to first": " advances to 1st", " advanced to second": " advances to 2nd", " advanced to third": " advances to 3rd",
        " stole second": " steals 2nd", " stole third": " steals 3rd", " scored": " scores", " out at first": " out at 1st",
        " out at second": " out at 2nd", " out at third": " out at 3rd",
    }
    for old, new in phrases.items():
        quoted = F.replace(quoted, F.lit(old), F.lit(new))
    return quoted


def active_lineup(starters: DataFrame, moves: DataFrame, plays: DataFrame) -> DataFrame:
    """Player at the asked position of every play.

    ``starters``: canonical_id, team, position, player; ``moves`` add seq; ``plays``:
    canonical_id, team, position, seq. A move fills the new position and leaves the one held
    before; both are changes in time, and the newest change up to the play counts.
    """
    held = starters.withColumn("seq", F.lit(-1)).unionByName(moves)
    by_player = Window.partitionBy("canonical_id", "team", "player").orderBy("seq", "position")
    left = held.withColumn("_old", F.lag("position").over(by_player)).where(F.col("_old").isNotNull() & (F.col("_old") != F.col("position")))
    vacated = left.select("canonical_id", "team", F.col("_old").alias("position"), "player", "seq", F.lit(0).alias("kind"))
    before = Window.partitionBy("canonical_id", "team", "position").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("kind") == 1, F.col("player")), ignorenulls=True).over(before)
    # whoever was replaced before he moved leaves nothing empty
    changes = held.withColumn("kind", F.lit(1)).unionByName(vacated).withColumn("_holder", holder).where("kind = 1 or player = _holder").withColumn(
        "player", F.when(F.col("kind") == 1, F.col("player"))
    ).drop("_holder")
    asked = plays.select("canonical_id", "team", "position", F.lit(None).cast("string").alias("player"), "seq", F.lit(2).alias("kind"))
    mark = F.when(F.col("kind") < 2, F.struct(F.col("player")))
    so_far = Window.partitionBy("canonical_id", "team", "position").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.unionByName(asked).withColumn("_now", F.last(mark, ignorenulls=True).over(so_far)).where("kind = 2")
        .select("canonical_id", "team", "position", "seq", F.col("_now.player").alias("player"))
    )


def box_line_differences(events: DataFrame, box: DataFrame) -> DataFrame:
    """Pitchers whose BF, H, BB, SO or HR differ between plays and box; unknown outcomes count."""
    kind = F.col("event_type")
    seen = events.where("is_plate_appearance").groupBy("canonical_id", F.col("pitcher_key").alias("player_key")).agg(
        F.count("*").alias("BF_seen"), count_if(kind.isin(*S.HITS)).alias("H_seen"), count_if(kind.isin(*S.WALKS)).alias("BB_seen"),
        count_if(kind.isin(*S.STRIKEOUTS)).alias("SO_seen"), count_if(kind == "home_run").alias("HR_seen"), count_if(kind == "unknown").alias("unknown"),
    )
    joined = box.select("canonical_id", "player_key", "BF", "H", "BB", "SO", "HR").join(seen, ["canonical_id", "player_key"], "left")
    wrong = F.coalesce(F.col("unknown"), F.lit(0)) > 0
    for column in ("BF", "H", "BB", "SO", "HR"):
        wrong = wrong | (F.coalesce(F.col(column), F.lit(0)) != F.coalesce(F.col(f"{column}_seen"), F.lit(0)))
    return joined.where(wrong)


# --- payload audit -----------------------------------------------------------------------

# fixed values: terms of the semantic categories
SEMANTIC_TERMS = {
    "batter_identity": ("batter", "hitter"),
    "pitcher_identity": ("pitcher",),
    "runner_identity": ("runner", "baserunner"),
    "fielder_identity": ("fielder", "fielding", "putout", "assist"),
    "base_occupancy": ("base", "first", "second", "third", "on_1", "on_2", "on_3"),
    "outs": ("out",),
    "pitching_change": ("pitching_change", "pitcher_change", "substitution"),
    "inherited_runner": ("inherited",),
    "batted_ball": ("batted", "hit_type", "direction", "trajectory"),
    "errors": ("error",),
    "double_plays": ("double_play", "double play"),
    "passed_balls": ("passed_ball", "passed ball"),
    "wild_pitches": ("wild_pitch", "wild pitch"),
    "stolen_bases": ("stolen_base", "stole "),
    "caught_stealing": ("caught_stealing", "caught stealing"),
    "pickoffs": ("pickoff", "picked off"),
    "runner_advancement": ("advance", "scored"),
}


def semantic_presence(docs: DataFrame, text: str, terms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Which categories of terms each document mentions."""
    terms = SEMANTIC_TERMS if terms is None else terms
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in terms.items()]))
    return docs.withColumn("categories", found)


def category_counts(present: DataFrame) -> DataFrame:
    return present.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("documents"))


def best_copy(copies: DataFrame, *keys: str) -> DataFrame:
    """Copy of each contest with most plays, then players, then categories."""
    quality = F.struct("plays", "players", F.size("categories").alias("categories"), F.col("copy_id"))
    return copies.groupBy(*keys).agg(F.max(quality).alias("q")).select(
        *keys, F.col("q.copy_id").alias("copy_id"), F.col("q.plays").alias("plays"), F.col("q.players").alias("players"), F.col("q.categories").alias("categories")
    )


def schema_inventory(docs: DataFrame, text: str) -> DataFrame:
    """Every JSON path with its types and how often each occurs, level by level down to the last."""
    level = docs.select(F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where(F.col("v").isNotNull())
    kind = F.regexp_extract(F.schema_of_variant("v"), r"^([A-Z]+)", 1)
    seen, spark = None, docs.sparkSession
    while seen is None or not level.isEmpty():
        here = level.groupBy("path", kind.alias("type")).agg(F.count("*").alias("values"))
        seen = here if seen is None else seen.unionByName(here)
        level = cut_lineage(spark.sql(
            "select concat(path, case when e.key is null then '[]' else concat('.', e.key) end) as path, e.value as v "
            "from {level}, lateral variant_explode(v) e", level=level,
        ))
    return seen.groupBy("path", "type").agg(F.sum("values").alias("values"))
