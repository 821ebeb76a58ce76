"""Registered queries beside their SQL twins on the smallest tables (all with ORACLE_ALL=1)."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from basepaths import plans

SAMPLE = (
    "rex2 rex3 rex4 flagship war2_offense_by_player war6 war10 war14 war20 war23 tto4 tto7 tto8_pitcher_penalties tto10 tto11 pos2_position pos5 pos7_fielding_t pos9 "
    "sct9_spray sct10_approach sct14 sct19 ldr2 ldr3 val2 evt1 evt2 evt4 evt9 evt12 ent1 ent6 ent7 ent9 ent10 src4 src8 snk2"
).split()
SQL = entry.oracle_sql()
NAMES = [n for n in plans.QUERIES if os.environ.get("ORACLE_ALL") or any(n.startswith(s) for s in SAMPLE)]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, entry.queries()[name], SQL.get(name)) == ""


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["season", "player_key", "PA", "wOBA", "batting_runs"] and rows.count() == 25


def test_every_query_has_a_check_or_a_reason():
    without = {n for n in plans.QUERIES if n not in SQL}
    assert without == set()
