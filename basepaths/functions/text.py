"""Play, pitch and location text as columns; every rule list is tried in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions.identity import literal_map


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_rule(text: Column, rules) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for pattern, label in rules])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def play_type(text: Column) -> Column:
    return F.coalesce(first_rule(lowered(text), S.PLAY_RULES), F.lit("unknown"))


def official_play_type(action: Column, text: Column) -> Column:
    """Event type from the narrative, else from the action code."""
    code = F.trim(F.upper(F.coalesce(action, F.lit(""))))
    strikeout = code.rlike("^(" + "|".join(S.STRIKEOUT_PREFIXES) + ")")
    by_code = F.coalesce(
        *[F.when(code.startswith(prefix), F.lit(label)) for prefix, label in S.ACTION_PREFIXES],
        F.when(strikeout, F.when(lowered(text).contains("reached"), F.lit("dropped_third_reached")).otherwise("strikeout")),
        F.when(code.contains("DP"), F.lit("double_play")),
        F.when((code != "") & (code != "/"), F.lit("out")),
    )
    return F.coalesce(first_rule(lowered(text), S.PLAY_RULES), by_code, F.lit("unknown"))


def batter_destination(event_type: Column) -> Column:
    return F.try_element_at(literal_map(S.DESTINATIONS), event_type)


def outs_on_play(event_type: Column, text: Column) -> Column:
    low = lowered(text)
    return (
        F.when(low.contains("triple play"), 3)
        .when(low.contains("double play"), 2)
        .when(event_type.isin(*S.ONE_OUT_EVENTS), 1)
        .otherwise(0)
    )


def runner_event_type(text: Column) -> Column:
    """Joined labels of a between-pitches play, NULL when nothing happened."""
    low = lowered(text)
    labels = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(label)) for p, label in S.RUNNER_RULES]))
    return F.when(F.size(labels) > 0, F.array_join(labels, "+")).when(
        low.rlike(S.RUNNER_ADVANCE_RULE), F.lit("runner_advance")
    )


def trajectory(text: Column) -> Column:
    return first_rule(lowered(text), S.TRAJECTORY_RULES)


_POSITIONS = "|".join(S.FIELDING_POSITIONS)


def first_position(text: Column) -> Column:
    """Fielding position mentioned first."""
    return F.nullif(F.regexp_extract(lowered(text), f"({_POSITIONS})", 1), F.lit(""))


def after_first_position(text: Column) -> Column:
    """The text behind the first mentioned fielding position."""
    return F.regexp_extract(lowered(text), f"(?s)^.*?({_POSITIONS})(.*)$", 2)


def position_mentions(text: Column) -> Column:
    return F.regexp_count(lowered(text), F.lit(_POSITIONS))


def listed_names(names: Column) -> Column:
    """A game's names with their lower-case form, for ``nearest_listed``."""
    return F.transform(names, lambda n: F.struct(F.lower(n).alias("low"), n.alias("name")))


def nearest_listed(tail: Column, listed: Column) -> Column:
    """Known player named first in ``tail``; NULL when none is. The few names it holds are found before their places are.

    An empty text holds an empty name alone, so the names are not tried on it.
    """

    def first(text):
        held = F.filter(listed, lambda n: F.contains(text, n["low"]))
        found = F.transform(held, lambda n: F.struct(F.position(n["low"], text).alias("at"), n["name"].alias("name")))
        named = F.array_min(F.filter(found, lambda n: n["at"] > 0))["name"]
        return F.when(text != "", named).when((text == "") & F.array_contains(listed["low"], ""), F.lit(""))

    return let(tail, first)


def nearest_name(tail: Column, names: Column) -> Column:
    """The same for names as they are."""
    return nearest_listed(tail, listed_names(names))


def contact_text(text: Column) -> Column:
    """The text from the first contact verb on."""
    low = lowered(text)
    return F.substring(low, F.greatest(F.regexp_instr(low, F.lit(S.CONTACT_VERBS)), F.lit(1)), F.length(low))


_MENTION = (
    r"\b(?:(relay|throw|throws|threw|thrown)\s+)?(?:(to)\s+)?("
    + "|".join(alias for alias, _ in sorted(S.POSITION_ALIASES, key=lambda a: -len(a[0])))
    + r")\b"
)


_PHRASE = r"\b(?:" + "|".join(p for p, _ in S.PHRASE_LOCATIONS) + r")\b"


def spray_location(text: Column) -> Column:
    """Where the ball went: a phrase, else the first position not after "to", else not after a throw."""
    return let(contact_text(text), _place)


def _place(low: Column) -> Column:
    phrase = first_rule(low, [(rf"\b{p}\b", place) for p, place in S.PHRASE_LOCATIONS])
    places = literal_map(dict(S.POSITION_ALIASES))

    def mention(found):
        throw, to, alias = (F.regexp_extract(found, _MENTION, group) for group in (1, 2, 3))
        return F.struct(
            F.element_at(places, alias).alias("place"), (to != "").alias("after_to"), ((to != "") & (throw != "")).alias("after_throw")
        )

    def told(mentions):
        primary = F.get(F.filter(mentions, lambda m: ~m["after_to"]), F.lit(0))["place"]
        target = F.get(F.filter(mentions, lambda m: ~m["after_throw"]), F.lit(0))["place"]
        return F.coalesce(primary, target)

    # the text is searched for mentions once; their parts are read from the short matches
    mentions = F.transform(F.regexp_extract_all(low, F.lit(_MENTION), F.lit(0)), mention)
    return F.coalesce(F.when(low.rlike(_PHRASE), phrase), let(mentions, told))


def contact_type(text: Column) -> Column:
    low = lowered(text)
    return (
        F.when(low.contains("bunt") | (low.contains("sacrifices") & ~low.contains("sacrifice fly")), "Bunt")
        .when(low.contains("ground"), "Ground")
        .when(low.contains("line"), "Line")
        .when(low.contains("pop") | low.contains("infield fly"), "Pop")
        .when(low.contains("fly") | low.contains("flies"), "Fly")
        .otherwise("Other")
    )


def result_label(event_type: Column) -> Column:
    known = F.try_element_at(literal_map(S.RESULT_LABELS), event_type)
    return F.coalesce(known, F.initcap(F.replace(event_type, F.lit("_"), F.lit(" "))))


def official_pitch_text(text: Column, is_pa: Column) -> Column:
    """Pitch codes behind the final count; a bare count of a plate appearance means contact."""
    codes = F.regexp_extract(F.coalesce(text, F.lit("")), S.PITCH_COUNT, 2)
    bare = F.coalesce(text, F.lit("")).rlike(S.COUNT_ONLY)
    return F.when(codes != "", codes).when(is_pa & bare, "X").otherwise("")


def _pitch_struct(balls, strikes, action, swing, called, strike) -> Column:
    return F.struct(
        F.concat(balls.cast("string"), F.lit("-"), strikes.cast("string")).alias("count"),
        action.alias("action"), swing.alias("swing"), called.alias("called"), strike.alias("strike"),
    )


_EMPTY = (
    "named_struct('balls', 0, 'strikes', 0, 'pitches', cast(array() as "
    "array<struct<count:string,action:string,swing:boolean,called:boolean,strike:boolean>>))"
)


def _fold(actions: Column, ball, swing, called, strike, foul, adds) -> Column:
    """Run a list of pitches through the count; each pitch carries the count before it."""

    def step(state, action):
        balls, strikes = state["balls"], state["strikes"]
        pitch = _pitch_struct(balls, strikes, action, swing(action), called(action), strike(action))
        return F.struct(
            F.when(ball(action), F.least(F.lit(4), balls + 1)).otherwise(balls).alias("balls"),
            F.when(foul(action), F.when(strikes < 2, strikes + 1).otherwise(strikes))
            .when(adds(action) & (strikes < 3), strikes + 1).otherwise(strikes).alias("strikes"),
            F.concat(state["pitches"], F.array(pitch)).alias("pitches"),
        )

    return F.aggregate(actions, F.expr(_EMPTY), step)["pitches"]


def pitches(pitch_text: Column, event_type: Column) -> Column:
    """All pitches of a plate appearance as an array, from compact codes or comma phrases."""
    contact, hit = event_type.isin(*S.CONTACT_EVENTS), event_type == "hit_by_pitch"
    contact, hit = F.coalesce(contact, F.lit(False)), F.coalesce(hit, F.lit(False))
    raw = F.upper(F.trim(F.coalesce(pitch_text, F.lit(""))))
    compact = F.when((raw == "") & contact, "X").when((raw == "") & hit, "H").otherwise(raw)
    full = (
        F.when(contact & ~compact.endswith("X"), F.concat(compact, F.lit("X")))
        .when(hit, F.concat(compact, F.lit("H")))
        .otherwise(compact)
    )
    codes = F.filter(F.split(full, ""), lambda c: c != "")
    by_code = _fold(
        codes,
        ball=lambda c: c == "B",
        swing=lambda c: c.isin("S", "F", "X"),
        called=lambda c: c.isin("K", "C"),
        strike=lambda c: ~c.isin("B", "H"),
        foul=lambda c: c == "F",
        adds=lambda c: c.isin("K", "C", "S"),
    )

    def is_ball(a):
        return F.lower(a).startswith("ball ") | (F.lower(a) == "ball")

    def is_swing(a):
        low = F.lower(a)
        return low.contains("foul") | low.contains("swinging") | low.contains("in play")

    def is_called(a):
        return F.lower(a).contains("looking") & F.lower(a).contains("strike")

    phrases = F.transform(
        F.split(F.coalesce(pitch_text, F.lit("")), ",\\s*"),
        lambda a: F.rtrim(F.trim(F.replace(a, F.lit("\u00a0"), F.lit(" "))), F.lit(".")),
    )
    kept = F.filter(
        phrases,
        lambda a: (a != "") & ~F.lower(a).startswith("lineup changed") & (is_ball(a) | is_swing(a) | is_called(a)),
    )
    by_phrase = _fold(
        kept,
        ball=is_ball,
        swing=is_swing,
        called=is_called,
        strike=lambda a: ~is_ball(a),
        foul=lambda a: ~is_ball(a) & F.lower(a).contains("foul"),
        adds=lambda a: ~is_ball(a) & F.lower(a).contains("strike"),
    )
    return F.when(compact.rlike(S.COMPACT_PITCHES), by_code).otherwise(by_phrase)


def innings_to_decimal(text: Column) -> Column:
    """"6.2" is six and two thirds; other fractions raise."""
    value = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("0"))
    parts = F.split(value, "\\.", 2)
    thirds = F.coalesce(F.get(parts, F.lit(1)), F.lit("0"))
    checked = F.when(thirds.isin("0", "1", "2"), thirds.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("invalid innings value: "), value)).cast("int")
    )
    return F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.lit("0")).cast("double") + checked / F.lit(3.0)


def listed_position(info: Column) -> Column:
    """First bracketed text that is not a decision letter."""
    inside = F.regexp_extract_all(F.coalesce(info, F.lit("")), F.lit(r"\(([^)]+)\)"), F.lit(1))
    return F.get(F.filter(inside, lambda v: ~v.isin("W", "L", "S")), F.lit(0))
