"""Which pitcher threw each play, from the outs of the box score.

Every play of a defense is given to one of its listed pitchers so that each ends with the outs the box
gives him, at least cost: a change costs 10, going against a hint 2, against the earlier value 1; a
pitcher named in the play is binding. This is a shortest path through layers of states (outs used so
far per pitcher, last pitcher). Names become list places in the JVM; a task gets small integers and
takes many games through the layers side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths.functions.identity import person_key
from basepaths.operators.events import longest_first, named_with

CHANGE, AGAINST_HINT, AGAINST_OLD = 10, 2, 1
#: Teams' games taken through the layers together.
TOGETHER = 512
_NONE, _OTHER = -1, -2
_FAR = np.int64(1) << 40
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def play_blocks(events: DataFrame, staffs: DataFrame) -> DataFrame:
    """One row per displayed play of a defense: outs, pitcher named in the text, hint, old value."""
    staffs = staffs.select("canonical_id", "team", longest_first(F.col("pitchers")).alias("pitchers"))
    texts = lambda c: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("event_order", c))), lambda e: e[c]))
    grouped = events.groupBy("canonical_id", F.col("fielding_team").alias("team"), F.col("display_row_index").alias("block")).agg(
        F.sum(F.col("outs_after") - F.col("outs_before")).cast("int").alias("outs"), texts("play_text").alias("play"), texts("pitch_text").alias("pitch"),
        F.max_by("pitcher", "event_order").alias("old"),
    )
    return grouped.join(staffs, ["canonical_id", "team"], "left").select(
        "canonical_id", "team", "block", "outs", named_with(F.col("play"), F.col("pitchers"), " pitching").alias("explicit"),
        named_with(F.col("pitch"), F.col("pitchers"), " in for pitcher", " in at pitcher").alias("hint"), "old",
    )


class Layer:
    """States after some plays of several games, sorted by game and outs used."""

    def __init__(self, game: np.ndarray, used: np.ndarray, last: np.ndarray, cost: np.ndarray):
        self.game, self.used, self.last, self.cost = game, used, last, cost


def _advance(layer: Layer, play: dict[str, np.ndarray], targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ways on from the states: parent, pitcher, price, and the children's outs used."""
    parents, pitchers, prices, children = [], [], [], []
    at = {name: values[layer.game] for name, values in play.items()}
    for i in range(targets.shape[1]):
        room = layer.used[:, i] + at["outs"] <= targets[layer.game, i]
        ok = np.flatnonzero(at["goes_on"] & room & ((at["explicit"] == _NONE) | (at["explicit"] == i)))
        price = CHANGE * ((layer.last[ok] != _NONE) & (layer.last[ok] != i)) + AGAINST_HINT * ((at["hint"][ok] != _NONE) & (at["hint"][ok] != i))
        prices.append(price + AGAINST_OLD * ((at["old"][ok] != _NONE) & (at["old"][ok] != i)))
        used = layer.used[ok].copy()
        used[:, i] += at["outs"][ok]
        parents.append(ok)
        pitchers.append(np.full(len(ok), i))
        children.append(used)
    return tuple(np.concatenate(x) for x in (parents, pitchers, prices, children))


def _merge(layer: Layer, parent: np.ndarray, pitcher: np.ndarray, price: np.ndarray, used: np.ndarray) -> tuple[Layer, tuple]:
    """Equal children become one state of least cost; the arcs (parent, child, pitcher, price) that are left.

    A state that costs over ``CHANGE`` more than another one with the same outs used goes, as the other
    could change pitchers and still be cheaper.
    """
    game, cost = layer.game[parent], layer.cost[parent] + price
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.full(used.shape[1], _FACTOR, np.uint64))
        mark = (used.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((cost, pitcher, mark, game))
    parent, pitcher, price, used, game, cost, mark = (x[order] for x in (parent, pitcher, price, used, game, cost, mark))
    same_outs = np.ones(len(order), bool)
    same_outs[1:] = (game[1:] != game[:-1]) | (mark[1:] != mark[:-1])
    if len(order):
        group = np.cumsum(same_outs) - 1
        least = np.minimum.reduceat(cost, np.flatnonzero(same_outs))
        kept = cost <= least[group] + CHANGE
        parent, pitcher, price, used, game, cost, group = (x[kept] for x in (parent, pitcher, price, used, game, cost, group))
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (pitcher[1:] != pitcher[:-1])
    else:
        new = np.zeros(0, bool)
    child = np.cumsum(new) - 1
    return Layer(game[new], used[new], pitcher[new], cost[new]), (parent, child, pitcher, price)


def cheapest(plays: list[dict[str, np.ndarray]], lengths: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(pitcher per game and play, whether other pitchers are possible, number of cheapest assignments per game).

    ``plays``: per layer, arrays over the games: outs, explicit, hint, old, goes_on. ``targets``: outs per game
    and pitcher, below 0 where there is none. The first assignment in list order is taken.
    """
    games, most = len(lengths), len(plays)
    layers = [Layer(np.arange(games), np.zeros(targets.shape, np.int64), np.full(games, _NONE), np.zeros(games, np.int64))]
    arcs = []
    for play in plays:
        layer, kept = _merge(layers[-1], *_advance(layers[-1], play, targets))
        layers.append(layer)
        arcs.append(kept)
    rest = [np.where((lengths[x.game] == n) & (x.used == np.maximum(targets[x.game], 0)).all(axis=1), np.int64(0), _FAR) for n, x in enumerate(layers)]
    ways = [np.where(r == 0, 1, 0).astype(object) for r in rest]
    for n in reversed(range(most)):
        parent, child, _, price = arcs[n]
        np.minimum.at(rest[n], parent, price + rest[n + 1][child])
    best = rest[0]
    if (best >= _FAR).any():
        raise ValueError("no assignment of pitchers reconciles the box-score outs")
    good = []
    for n in reversed(range(most)):
        parent, child, pitcher, price = arcs[n]
        through = np.flatnonzero(layers[n].cost[parent] + price + rest[n + 1][child] == best[layers[n].game[parent]])
        good.append(through)
        np.add.at(ways[n], parent[through], ways[n + 1][child[through]])
    good.reverse()
    chosen, open_to = np.full((games, most), _NONE), np.zeros((games, most), bool)
    here = np.arange(games)
    for n in range(most):
        parent, child, pitcher, _ = (x[good[n]] for x in arcs[n])
        game = layers[n].game[parent]
        pairs = np.unique(game * targets.shape[1] + pitcher) // targets.shape[1]
        open_to[:, n] = np.bincount(pairs, minlength=games) > 1
        mine = np.flatnonzero(here[game] == parent)
        mine = mine[np.lexsort((pitcher[mine], game[mine]))]
        first = mine[np.unique(game[mine], return_index=True)[1]]
        chosen[game[first], n] = pitcher[first]
        here = np.full(games, _NONE)
        here[game[first]] = child[first]
    return chosen, open_to, [int(w) for w in ways[0]]


ATTRIBUTED = "canonical_id string, team string, block int, pitcher string, ambiguous boolean, method string, optimal_paths string"
_NAMES = [part.split()[0] for part in ATTRIBUTED.split(", ")]


def _attribute(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = {n: batch.column("blocks").flatten().field(n).to_numpy(zero_copy_only=False) for n in ("block", "outs", "explicit", "hint", "old")}
    lengths = np.diff(batch.column("blocks").offsets.to_numpy())
    staff = np.diff(batch.column("names").offsets.to_numpy())
    game, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    member, number = np.repeat(np.arange(len(staff)), staff), np.arange(staff.sum()) - np.repeat(np.cumsum(staff) - staff, staff)
    targets = np.full((len(lengths), max(1, staff.max(initial=0))), -1, np.int64)
    targets[member, number] = batch.column("outs").flatten().to_numpy()
    table = {}
    for name in ("outs", "explicit", "hint", "old"):
        table[name] = np.full((len(lengths), lengths.max(initial=0)), _NONE, np.int64)
        table[name][game, place] = lists[name]
    plays = [{name: values[:, n] for name, values in table.items()} | {"goes_on": lengths > n} for n in range(lengths.max(initial=0))]
    chosen, open_to, ways = cheapest(plays, lengths, targets)
    tied = open_to[game, place]
    names = batch.column("names").flatten().take(pa.array((np.cumsum(staff) - staff)[game] + chosen[game, place]))
    method = np.where(table["explicit"][game, place] != _NONE, "explicit_play_text", np.where(tied, "boxscore_constrained_tied", "boxscore_constrained_unique"))
    columns = [
        batch.column("canonical_id").take(pa.array(game)), batch.column("team").take(pa.array(game)), pa.array(lists["block"], pa.int32()), names,
        pa.array(tied), pa.array(method), pa.array([str(ways[g]) for g in game]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            yield _attribute(pa.Table.from_batches([part]).take(pa.array(range(part.num_rows))).combine_chunks().to_batches()[0])


def attribute_pitchers(blocks: DataFrame, box: DataFrame) -> DataFrame:
    """Pitcher of every play; plays and pitchers of one team's game are a few dozen each.

    ``box``: canonical_id, team, player, outs, list_ordinal. A game whose outs no assignment reaches raises.
    """
    keys = ["canonical_id", "team"]
    listed = box.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("list_ordinal", "player", "outs"))).alias("box"))
    staffs = listed.select(*keys, F.transform("box", lambda p: p["player"]).alias("names"), F.transform("box", lambda p: p["outs"].cast("int")).alias("outs"))
    staffs = staffs.withColumn("keys", F.transform("names", lambda n: person_key(n)))

    def place(names: str, name: Column) -> Column:
        found = F.array_position(F.coalesce(F.col(names), F.array().cast("array<string>")), name).cast("int")
        return F.when(F.coalesce(name, F.lit("")) == "", _NONE).when(found > 0, found - 1).otherwise(_OTHER)

    with_places = blocks.join(staffs.select(*keys, "names", "keys"), keys, "left").select(*keys, F.struct(
        "block", "outs", place("names", F.col("explicit")).alias("explicit"), place("names", F.col("hint")).alias("hint"), place("keys", person_key(F.col("old"))).alias("old"),
    ).alias("b"))
    played = with_places.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("blocks")).join(staffs.drop("keys"), keys, "left")
    filled = played.withColumns({"names": F.coalesce("names", F.array().cast("array<string>")), "outs": F.coalesce("outs", F.array().cast("array<int>"))})
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return filled.repartition(tasks, *keys).mapInArrow(_in_batches, ATTRIBUTED)
