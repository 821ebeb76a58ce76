"""Least squares with batter and pitcher effects and game-clustered errors.

Players are never expanded into dummy columns. Both effects are absorbed: every variable is
reduced to what batter and pitcher means cannot explain. That takes the solution of the normal
equations of the effects, which come from the small table of (batter, pitcher) sums and are solved
exactly by block elimination for all variables at once; the plate appearances are read once before and
once after. By the Frisch-Waugh-Lovell theorem coefficients, residuals and the clustered sandwich of the
named terms equal those of the full dummy regression, for any number of players.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths.functions.elimination import BLOCK, BLOCKS, eliminate, frame, packed, summed, unpack
from basepaths.session import cut_lineage


def exposure_terms(workload: bool, late_season: int = 2026) -> dict[str, Column]:
    number, prior, inning = F.col("same_game_matchup_number"), F.col("prior_series_game_matchups"), F.col("inning")
    terms = {
        "same_game_encounter_2": number == 2,
        "same_game_encounter_3plus": number >= 3,
        "prior_series_games_1_2": prior.between(1, 2),
        "prior_series_games_3plus": prior >= 3,
    }
    if workload:
        terms |= {
            "pitcher_bf_before_per_9": F.col("pitcher_batters_faced_before") / 9.0,
            "inning_3_4": inning.between(3, 4),
            "inning_5plus": inning >= 5,
        }
    terms["season_2026"] = F.col("season") == late_season
    return {name: column.cast("double") for name, column in terms.items()}


OUTCOMES = {"run_value": "run_value", "wOBA_value": "wOBA_num_value", "on_base": "OBP_num_value"}


#: Plate appearances that fits share, and the outcomes fitted on them.
POPULATIONS = (("run_value", "on_base"), ("wOBA_value",))
#: Outcomes of a population at most; shorter lists are filled with zeros.
MOST = max(len(outcomes) for outcomes in POPULATIONS)


def model_rows(pas: DataFrame, late_season: int = 2026) -> DataFrame:
    """Population (m), game, batter, pitcher and the variables as one array: outcomes first, then all terms."""
    terms = list(exposure_terms(True, late_season).values())

    def member(m: int, outcomes: tuple[str, ...]) -> Column:
        values = [F.col(OUTCOMES[o]).cast("double") for o in outcomes] + [F.lit(0.0)] * (MOST - len(outcomes)) + terms
        counts = F.col("wOBA_den_value") > 0 if "wOBA_value" in outcomes else F.lit(True)
        return F.when(counts, F.struct(F.lit(m).alias("m"), F.array(*values).alias("v")))

    members = F.array_compact(F.array(*[member(m, outcomes) for m, outcomes in enumerate(POPULATIONS)]))
    return pas.select("canonical_id", F.col("batter_key").alias("b"), F.col("pitcher_key").alias("p"), F.explode(members).alias("x")).select(
        "x.m", "canonical_id", "b", "p", "x.v"
    )


def _sums(n: int, column: str) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def _minus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, c: a - c)


def _placed(players: DataFrame, name: str, blocks: int) -> DataFrame:
    """Players with a block, their place in it and its size."""
    placed = players.withColumn("block", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int"))
    inside = Window.partitionBy("m", "block")
    return placed.withColumn("place", F.row_number().over(inside.orderBy(name)) - 1).withColumn("size", F.count("*").over(inside).cast("int"))


def batter_system(cells: DataFrame, batters: DataFrame, pitchers: DataFrame, rows: int) -> DataFrame:
    """The normal equations of the batters after elimination of the pitchers, in blocks, with the right sides below.

    A batter's diagonal is his plate appearances; what two batters share through pitchers is a
    product of blocks of the (batter, pitcher) counts, each scaled by the root of the pitcher's.
    """
    where = lambda table, name, side: table.select(
        "m", name, F.col("block").alias(f"{side}_block"), F.col("place").alias(f"{side}_place"), F.col("size").alias(f"{side}_size"))
    counts = cells.join(where(batters, "b", "b"), ["m", "b"]).join(where(pitchers, "p", "p").join(pitchers.select("m", "p", "np"), ["m", "p"]), ["m", "p"])
    scaled = counts.select("m", "b_block", "b_place", "b_size", "p_block", "p_place", "p_size", (F.col("n") / F.sqrt("np")).alias("x"))

    def dense(one):
        a = np.zeros((one.b_size[0], one.p_size[0]))
        a[one.b_place, one.p_place] = one.x
        return frame([packed(one.m[0], one.b_block[0], one.p_block[0], a)])

    met = scaled.groupBy("m", "b_block", "p_block").applyInPandas(dense, BLOCKS)
    other = met.select("m", F.col("j"), F.col("i").alias("oi"), F.col("rows").alias("orows"), F.col("a").alias("oa"))

    def products(batches):
        for part in batches:
            yield frame([packed(r.m, r.i, r.oi, -unpack(r) @ np.frombuffer(r.oa).reshape(r.orows, r.columns).T) for r in part.itertuples()])

    def diagonal(one):
        a = np.zeros(one["size"][0])
        a[one.place] = one.nb
        return frame([packed(one.m[0], one.block[0], one.block[0], np.diag(a))])

    def right(one):
        a = np.zeros((len(one.r[0]), one["size"][0]))
        a[:, one.place] = np.stack(one.r.to_numpy()).T
        return frame([packed(one.m[0], rows, one.block[0], a)])

    lower = met.join(other, ["m", "j"]).where("i >= oi").select("m", "i", "j", "rows", "columns", "a", "oi", "orows", "oa")
    square = summed(lower.mapInPandas(products, BLOCKS).unionByName(batters.select("m", "block", "place", "size", "nb").groupBy("m", "block").applyInPandas(diagonal, BLOCKS)))
    return square.unionByName(batters.select("m", "block", "place", "size", "r").groupBy("m", "block").applyInPandas(right, BLOCKS))


def absorb(rows: DataFrame, width: int, block: int = BLOCK) -> tuple[DataFrame, dict[int, dict[str, int]]]:
    """Batter and pitcher effect of every variable: cells with arrays ``eb`` and ``ep``; and per population its players and the rank of their dummies.

    Pitchers are eliminated from the normal equations by hand; the batters' are solved by block
    elimination, for all variables and populations at once. A player whose effect the others
    determine (one per connected part of who met whom) gets 0.
    """
    cells = cut_lineage(rows.groupBy("m", "b", "p").agg(F.count("*").cast("double").alias("n"), _sums(width, "v").alias("s")))
    facts = {r["m"]: r.asDict() for r in cells.groupBy("m").agg(F.count_distinct("b").alias("b"), F.count_distinct("p").alias("p")).collect()}
    many = lambda name: max((-(-f[name] // block) for f in facts.values()), default=1)
    sums = cells.groupBy("m", "p").agg(F.sum("n").alias("np"), _sums(width, "s").alias("sp"))
    pitchers = cut_lineage(_placed(sums, "p", many("p")))
    explained = cells.join(pitchers.select("m", "p", "np", "sp"), ["m", "p"]).withColumn("_e", F.transform("sp", lambda x: x * F.col("n") / F.col("np")))
    right = explained.groupBy("m", "b").agg(F.sum("n").alias("nb"), _sums(width, "s").alias("_s"), _sums(width, "_e").alias("_t"))
    batters = cut_lineage(_placed(right.select("m", "b", "nb", _minus(F.col("_s"), F.col("_t")).alias("r")), "b", many("b")))
    solution, ranks = eliminate(batter_system(cells, batters, pitchers, many("b")), many("b"))
    for m, rank in ranks.items():
        facts[m]["rank"] = rank + facts[m]["p"]

    def effects(batches):
        for part in batches:
            for r in part.itertuples():
                x = unpack(r).T
                yield pd.DataFrame({"m": r.m, "block": r.j, "place": np.arange(len(x)), "eb": list(x)})

    solved = solution.mapInPandas(effects, "m int, block int, place int, eb array<double>")
    found = cells.join(batters.select("m", "b", "block", "place").join(solved, ["m", "block", "place"]).select("m", "b", "eb"), ["m", "b"])
    left = found.withColumn("_r", F.zip_with("s", "eb", lambda s, e: s - F.col("n") * e))
    means = left.groupBy("m", "p").agg(F.sum("n").alias("_n"), _sums(width, "_r").alias("_r")).select("m", "p", F.transform("_r", lambda r: r / F.col("_n")).alias("ep"))
    return cut_lineage(found.select("m", "b", "p", "eb").join(means, ["m", "p"]).select("m", "b", "p", "eb", "ep")), facts


def within(rows: DataFrame, effects: DataFrame) -> DataFrame:
    """Variables without the absorbed effects."""
    total = F.zip_with("eb", "ep", lambda x, y: x + y)
    return rows.join(effects.withColumn("e", total).select("m", "b", "p", "e"), ["m", "b", "p"]).select(
        "m", "canonical_id", _minus(F.col("v"), F.col("e")).alias("w")
    )


def game_products(rows: DataFrame, width: int) -> DataFrame:
    """Per population and game: plate appearances and the sums of all products of two variables, the lower half row by row."""
    products = [F.sum(F.col("w")[i] * F.col("w")[j]) for i in range(width) for j in range(i + 1)]
    return rows.groupBy("m", "canonical_id").agg(F.count("*").alias("n"), F.array(*products).alias("g"))


SPECS = {"total_exposure_association": False, "workload_decomposition": True}
FITTED = (
    "outcome string, model_spec string, n long, games long, batter_fixed_effects long, pitcher_fixed_effects long, "
    "design_columns long, design_rank long, term string, estimate double, standard_error double, ci_95_low double, ci_95_high double"
)


def _at(i: int, j: int) -> int:
    """Place of a product in the lower half."""
    return max(i, j) * (max(i, j) + 1) // 2 + min(i, j)


def fit_fixed_effects(pas: DataFrame, late_season: int = 2026, block: int = BLOCK) -> DataFrame:
    """Coefficients, clustered standard errors and intervals of the exposure terms of every outcome and spec.

    All fits share one solution of the player effects and one table of products per game; a fit
    is small algebra on sums of these. A standard error is the root of a sum of squares over games, each of
    a fixed combination of the game's products.
    """
    every = list(exposure_terms(True, late_season))
    width = MOST + len(every)
    rows = model_rows(pas, late_season)
    effects, players = absorb(rows, width, block)
    games = cut_lineage(game_products(within(rows, effects), width))
    size = width * (width + 1) // 2
    sums = {r["m"]: r for r in games.groupBy("m").agg(F.sum("n").alias("n"), F.count("*").alias("games"), _sums(size, "g").alias("g")).collect()}
    fits, errors = [], {m: [] for m in sums}
    for m, total in sums.items():
        products = np.array([[total["g"][_at(i, j)] for j in range(width)] for i in range(width)])
        for k, outcome in enumerate(POPULATIONS[m]):
            for spec, workload in SPECS.items():
                names = list(exposure_terms(workload, late_season))
                at = [MOST + every.index(n) for n in names]
                inner = products[np.ix_(at, at)]
                bread = np.linalg.pinv(inner, rcond=1e-10)
                beta = bread @ products[at, k]
                rank = int(np.linalg.matrix_rank(inner, tol=1e-8 * max(1.0, np.abs(inner).max()), hermitian=True))
                fits.append((m, outcome, spec, names, beta, rank, len(errors[m])))
                # a game's score: its products with the outcome less those the fit explains
                score = np.zeros((len(at), size))
                for row, i in enumerate(at):
                    score[row, _at(i, k)] += 1.0
                    for j, x in zip(at, beta):
                        score[row, _at(i, j)] -= x
                errors[m] += list(bread @ score)
    squares = {}
    if errors:
        combined = {m: np.array(rows) for m, rows in errors.items()}
        most = max(map(len, combined.values()))

        def squared(batches):
            for part in batches:
                for m, mine in part.groupby("m"):
                    u = np.zeros(most)
                    u[: len(combined[m])] = ((np.stack(mine.g.to_numpy()) @ combined[m].T) ** 2).sum(axis=0)
                    yield pd.DataFrame({"m": [m], "u": [u]})

        totals = games.select("m", "g").mapInPandas(squared, "m int, u array<double>").groupBy("m").agg(_sums(most, "u").alias("u"))
        squares = {r["m"]: r["u"] for r in totals.collect()}
    table = []
    for m, outcome, spec, names, beta, rank, first in fits:
        total, seen = sums[m], players[m]
        factor = total["games"] / (total["games"] - 1) if total["games"] > 1 else 1.0
        for place, (name, b) in enumerate(zip(names, beta)):
            se = float(np.sqrt(max(0.0, squares[m][first + place] * factor)))
            table.append((
                outcome, spec, total["n"], total["games"], seen["b"], seen["p"], len(names) + 1 + seen["b"] + seen["p"] - 2, seen["rank"] + rank, name,
                float(b), se, float(b - 1.96 * se), float(b + 1.96 * se),
            ))
    return pas.sparkSession.createDataFrame(table, FITTED)
