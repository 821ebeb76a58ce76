"""Schemas and closed vocabularies of the event data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: vocabularies shared with the published data model ------------------

HITS = ("single", "double", "triple", "home_run")
WALKS = ("walk", "intentional_walk")
STRIKEOUTS = ("strikeout", "dropped_third_out", "dropped_third_reached")
WOBA_EVENTS = ("single", "double", "triple", "home_run", "walk", "hit_by_pitch")
OUT_EVENTS = (
    "out", "strikeout", "double_play", "fielders_choice", "infield_fly",
    "batter_interference", "dropped_third_out",
)
ON_BASE_EVENTS = (
    "single", "double", "triple", "home_run", "walk", "intentional_walk",
    "hit_by_pitch", "reached_on_error", "fielders_choice", "dropped_third_reached",
)
OBP_EVENTS = ("single", "double", "triple", "home_run", "walk", "intentional_walk", "hit_by_pitch")
WOBA_DEN_EXCLUSIONS = ("intentional_walk", "sacrifice_bunt", "catcher_interference")
OBP_DEN_EXCLUSIONS = ("sacrifice_bunt", "catcher_interference")
AB_EXCLUSIONS = (
    "walk", "intentional_walk", "hit_by_pitch", "sacrifice_fly", "sacrifice_bunt",
    "catcher_interference",
)
CONVERTIBLE_EVENTS = (
    "single", "double", "triple", "out", "double_play", "fielders_choice",
    "reached_on_error", "sacrifice_fly", "sacrifice_bunt", "infield_fly",
)
CONVERTED_EVENTS = (
    "out", "double_play", "fielders_choice", "sacrifice_fly", "sacrifice_bunt", "infield_fly",
)
RUNNER_ADVANCE_EVENTS = (
    "single", "double", "out", "sacrifice_fly", "infield_fly", "reached_on_error",
)
BATTER_ADVANCE_EVENTS = ("single", "double", "reached_on_error")
PLACED_RUNNER = "__placed_runner__"
FIELDING_POSITIONS = (
    "first baseman", "second baseman", "third baseman", "center fielder", "right fielder",
    "left fielder", "shortstop", "pitcher", "catcher",
)
POSITION_LABELS = ("C", "1B", "2B", "3B", "SS", "LF", "CF", "RF")
COUNTS = (
    "0-0", "0-1", "0-2", "1-0", "1-1", "1-2", "2-0", "2-1", "2-2", "3-0", "3-1", "3-2",
)
# --------------------------------------------------------------------------------------

RUNNER_ACTION = T.StructType([
    T.StructField("runner", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("from_base", T.IntegerType()),
    T.StructField("to_base", T.IntegerType()),
    T.StructField("reason", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("canonical_id", T.StringType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("inning", T.IntegerType()),
    T.StructField("half", T.StringType()),
    T.StructField("event_order", T.IntegerType()),
    T.StructField("display_row_index", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("is_plate_appearance", T.BooleanType()),
    T.StructField("batting_team", T.StringType()),
    T.StructField("fielding_team", T.StringType()),
    T.StructField("batter", T.StringType()),
    T.StructField("pitcher", T.StringType()),
    T.StructField("outs_before", T.IntegerType()),
    T.StructField("bases_before", T.IntegerType()),
    T.StructField("outs_after", T.IntegerType()),
    T.StructField("bases_after", T.IntegerType()),
    T.StructField("runners_before", T.MapType(T.IntegerType(), T.StringType())),
    T.StructField("runners_after", T.MapType(T.IntegerType(), T.StringType())),
    T.StructField("runs_scored", T.IntegerType()),
    T.StructField("runner_actions", T.ArrayType(RUNNER_ACTION)),
    T.StructField("pitch_text", T.StringType()),
    T.StructField("play_text", T.StringType()),
])

# --- fixed values: text rules ----------------------------------------------------------

# play text -> event type, first match wins
PLAY_RULES = (
    (r"inside the park home run|\bhomers?\b", "home_run"),
    (r"double play", "double_play"),
    (r"\btriples?\b", "triple"),
    (r"\bdoubles?\b", "double"),
    (r"\bsingles?\b", "single"),
    (r"is intentionally walked", "intentional_walk"),
    (r"\bwalks?\b", "walk"),
    (r"is hit by pitch", "hit_by_pitch"),
    (r"catcher's interference", "catcher_interference"),
    (r"reaches on dropped 3rd strike", "dropped_third_reached"),
    (r"out at first on dropped 3rd strike", "dropped_third_out"),
    (r"strikes out", "strikeout"),
    (r"reaches on an error", "reached_on_error"),
    (r"fielder's choice", "fielders_choice"),
    (r"sacrifice fly", "sacrifice_fly"),
    (r"sacrific", "sacrifice_bunt"),
    (r"infield fly", "infield_fly"),
    (r"batter interference", "batter_interference"),
    (r"\b(grounds|flies|pops|lines|bunts) out\b", "out"),
)
# action code prefix -> event type, first match wins
ACTION_PREFIXES = (
    ("HR", "home_run"), ("3B", "triple"), ("2B", "double"), ("1B", "single"),
    ("IBB", "intentional_walk"), ("BB", "walk"), ("HBP", "hit_by_pitch"),
    ("SF", "sacrifice_fly"), ("SH", "sacrifice_bunt"), ("SAC", "sacrifice_bunt"),
    ("CI", "catcher_interference"), ("FC", "fielders_choice"), ("E", "reached_on_error"),
)
STRIKEOUT_PREFIXES = ("KS", "KL", "K ", "KWP", "KPB")
DESTINATIONS = {
    "single": 1, "walk": 1, "intentional_walk": 1, "hit_by_pitch": 1, "catcher_interference": 1,
    "dropped_third_reached": 1, "reached_on_error": 1, "fielders_choice": 1,
    "double": 2, "triple": 3, "home_run": 4,
}
ONE_OUT_EVENTS = (
    "strikeout", "dropped_third_out", "sacrifice_fly", "sacrifice_bunt", "infield_fly",
    "batter_interference", "out",
)
RUNNER_RULES = (
    (r"caught stealing", "caught_stealing"),
    (r"\bsteals?\b", "stolen_base"),
    (r"wild pitch", "wild_pitch"),
    (r"passed ball", "passed_ball"),
    (r"leaving base early|picked off", "runner_out"),
)
RUNNER_ADVANCE_RULE = r" scores on error| advances to "
TRAJECTORY_RULES = (
    (r"bunt", "bunt"),
    (r"ground ball|grounds |grounded ", "ground"),
    (r"line drive|lines |lined ", "line"),
    (r"pop fly|pops |popped |infield fly", "pop"),
    (r"fly ball|flies |flied ", "fly"),
)
CONTACT_VERBS = (
    r"\b(singles?|singled|doubles?|doubled|triples?|tripled|homers?|homered|hits?|"
    r"grounds?|grounded|lines?|lined|flies?|flied|pops?|popped|fouls?|fouled|"
    r"out\s+at|bunts?|sacrifices?|reaches|reached|walks?|walked|strikes?\s+out|struck\s+out)\b"
)
PHRASE_LOCATIONS = (
    ("left center", "Left Field"), ("left-cent", "Left Field"),
    ("right center", "Right Field"), ("right-cent", "Right Field"),
    ("up the middle", "Center Field"), ("middle", "Center Field"),
    ("left side", "Shortstop"), ("right side", "Second Base"),
    ("lf line", "Left Field"), ("left field line", "Left Field"),
    ("rf line", "Right Field"), ("right field line", "Right Field"),
)
POSITION_ALIASES = (
    ("1b", "First Base"), ("2b", "Second Base"), ("3b", "Third Base"), ("ss", "Shortstop"),
    ("lf", "Left Field"), ("cf", "Center Field"), ("rf", "Right Field"), ("p", "Pitcher"), ("c", "Catcher"),
    ("pitcher", "Pitcher"), ("catcher", "Catcher"), ("first baseman", "First Base"),
    ("first base", "First Base"), ("second baseman", "Second Base"),
    ("second base", "Second Base"), ("third baseman", "Third Base"),
    ("third base", "Third Base"), ("shortstop", "Shortstop"), ("left fielder", "Left Field"),
    ("left field", "Left Field"), ("center fielder", "Center Field"),
    ("center field", "Center Field"), ("right fielder", "Right Field"),
    ("right field", "Right Field"),
)
FIELD_LOCATIONS = (
    "Pitcher", "Catcher", "First Base", "Second Base", "Third Base", "Shortstop",
    "Left Field", "Center Field", "Right Field",
)
RESULT_LABELS = {
    "single": "1B", "double": "2B", "triple": "3B", "home_run": "HR", "walk": "BB",
    "intentional_walk": "IBB", "hit_by_pitch": "HBP", "strikeout": "K", "dropped_third_out": "K",
    "dropped_third_reached": "K / Reach", "reached_on_error": "ROE", "fielders_choice": "FC",
    "double_play": "DP", "sacrifice_bunt": "SAC", "sacrifice_fly": "SF", "out": "Out",
    "infield_fly": "Out", "catcher_interference": "CI",
}
CONTACT_EVENTS = (
    "single", "double", "triple", "home_run", "out", "fielders_choice", "double_play",
    "reached_on_error", "infield_fly", "sacrifice_bunt", "sacrifice_fly",
)
COMPACT_PITCHES = "^[BKSFCXH]+$"
PITCH_COUNT = r"\(([0-3]-[0-2])\s+([A-Z]+)\)"
COUNT_ONLY = r"\(([0-3]-[0-2])\)"
PERSON_ALIASES = {
    "aliaguliar": "aliaguilar",
    "corimcmillian": "corimcmillan",
    "dejamulipola": "dejahmulipola",
    "jailalassiter": "jalialassiter",
    "kaileywycoff": "kaileywyckoff",
    "odiccialexander": "odiccialexanderbennett",
    "paytongotshall": "paytongottshall",
    "paytongottshallmcmillan": "paytongottshall",
    "savannahjaquish": "sahvannajaquish",
    "sierrasacco": "sierrasaccoferrie",
}
TEAM_NICKNAMES = ("bandits", "blaze", "cascade", "spark", "talons", "volts")
TEAM_CITIES = {
    "Bandits": "Chicago Bandits", "Blaze": "Carolina Blaze", "Cascade": "Portland Cascade",
    "Spark": "Oklahoma City Spark", "Talons": "Utah Talons", "Volts": "Texas Volts",
}
TEAM_FAMILIES = {
    "AUSL Blaze": "Carolina Blaze", "AUSL Bandits": "Chicago Bandits", "AUSL Talons": "Utah Talons", "AUSL Volts": "Texas Volts",
}
POSITION_CODES = {
    "P": "pitcher", "C": "catcher", "1B": "first baseman", "2B": "second baseman",
    "3B": "third baseman", "SS": "shortstop", "LF": "left fielder", "CF": "center fielder",
    "RF": "right fielder",
}
# --------------------------------------------------------------------------------------

# --- fixed values: action codes of the feed ---------------------------------------------
POSITION_NUMBERS = {
    1: "pitcher", 2: "catcher", 3: "first baseman", 4: "second baseman", 5: "third baseman",
    6: "shortstop", 7: "left fielder", 8: "center fielder", 9: "right fielder",
}
ACTION_HEAD = r"^(?:HR|3B|2B|1B|IBB|BB|HBP|SF|SH|SAC|CI|FC|E|KS|KL|KWP|KPB)\s*"
# --------------------------------------------------------------------------------------

# --- fixed values: names and positions -------------------------------------------------
CLASS_YEAR = r"(?i)\s*\((RS[\s-]*|R-)?(Fr|So|Jr|Sr|Gr|5th)\)\s*$"
NICKNAMES = {
    "will": "william", "mike": "michael", "matt": "matthew", "chris": "christopher",
    "nick": "nicholas", "dan": "daniel", "steve": "stephen", "joe": "joseph", "tom": "thomas",
    "jim": "james", "bob": "robert", "bill": "william", "dave": "david", "andy": "andrew",
    "drew": "andrew", "ben": "benjamin", "sam": "samuel", "alex": "alexander", "zach": "zachary",
    "josh": "joshua", "jon": "jonathan", "nate": "nathan", "jeff": "jeffrey", "greg": "gregory",
    "doug": "douglas", "ted": "theodore", "tim": "timothy", "tony": "anthony", "jake": "jacob",
    "luke": "lucas", "eli": "elijah",
}
PERSON_DISPLAY_NAMES = {
    "odiccialexanderbennett": "Odicci Alexander-Bennett",
    "paytongottshall": "Payton Gottshall",
}
POSITION_NAMES = {
    "catcher": "C", "first baseman": "1B", "second baseman": "2B", "third baseman": "3B",
    "shortstop": "SS", "left fielder": "LF", "center fielder": "CF", "right fielder": "RF",
}
SUBSTITUTION = r"(?i)lineup changed|courtesy runner"
# --------------------------------------------------------------------------------------
