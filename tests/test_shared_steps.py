"""Steps many queries share: each text is searched once, and games are dealt out before their columns are made."""

import datetime
import re

from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions import text as X
from basepaths.operators import events as E
from basepaths.sources import fixtures

ALIASES = "|".join(a for a, _ in sorted(S.POSITION_ALIASES, key=lambda a: -len(a[0])))
MENTION = rf"(?:\b(relay|throw|throws|threw|thrown)\s+)?(?:\b(to)\s+)?\b({ALIASES})\b"


def place(text):
    low = (text or "").lower()
    verb = re.search(S.CONTACT_VERBS, low)
    low = low[verb.start():] if verb else low
    for phrase, name in S.PHRASE_LOCATIONS:
        if re.search(rf"\b{phrase}\b", low):
            return name
    found = [(t or "", to or "", dict(S.POSITION_ALIASES)[a]) for t, to, a in re.findall(MENTION, low)]
    return next((p for _, to, p in found if not to), next((p for t, to, p in found if not (t and to)), None))


def test_spray_location_searches_a_text_once(spark):
    texts = [
        None, "", "A grounds out to shortstop, throw to first base", "A singles, throw to third base to c", "A singles to left field, relay to ss",
        "A doubles down the LF line to p", "SS A hits it up the middle", "A flies to right-cent", "throw to pitcher", "thrown  to 2b, c", "A pops to xss first baseman Ann",
        "A lines to c p", "A singles threw ss", "catchers", "A walks. relay throw to cf",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    asked = rows.select("i", X.spray_location(F.col("t")).alias("place"))
    assert [r.place for r in sorted(asked.collect())] == [place(t) for t in texts]
    plan = asked._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_instr(") == 1 and plan.lower().count("regexp_extract_all(") == 1


def test_pinch_runner_and_names_read_a_text_once(spark):
    texts = ["Pinch Runner Ann Lee in for Bo Ray.", "pinch runner ann lee in for Ann Lee", "Ann Lee in for pitcher", "pinch runner Zoe in for Bo Ray", "", None]
    rows = spark.createDataFrame([(i, t, ["Ann Lee", "Bo Ray"]) for i, t in enumerate(texts)], "i int, t string, n array<string>")
    names = F.col("n")
    asked = rows.select(
        "i", E.pinch_runner(F.col("t"), names).alias("p"), E.named_with(F.col("t"), names, " pitching", " in for pitcher").alias("w"), E.name_at_start(F.col("t"), names).alias("s")
    )
    got = [(r.p and tuple(r.p), r.w, r.s) for r in sorted(asked.collect(), key=lambda r: r.i)]
    assert got == [(("Ann Lee", "boray"), None, None), (None, None, None), (None, "Ann Lee", "Ann Lee"), (None, None, None), (None, None, None), (None, None, None)]
    plan = rows.select(E.pinch_runner(F.col("t"), names))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_extract(") <= 2


def test_events_are_dealt_out_as_two_columns(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i)) for i in range(200)] + [(None, start), (5, None), (5, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    dealt = fixtures.pbp_by_game(spark, str(tmp_path), 4)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, fixtures.pbp(spark, str(tmp_path)).collect()))
    assert dealt.select("g", F.spark_partition_id().alias("p")).distinct().groupBy("g").count().where("count > 1").isEmpty()
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "play_text" not in plan.split("Repartition")[1]
