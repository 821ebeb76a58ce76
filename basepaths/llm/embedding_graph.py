"""Near-duplicate vectors over a robust-pruned flat graph.

Vectors are dealt to cluster shards, each to its two nearest centres (more where others are
about as near), so shards overlap. Each shard builds a graph: every vector gets its nearest
neighbours by greedy search and keeps those that no kept, nearer one covers (robust pruning);
back edges are pruned the same way. The adjacency lists of a vector from all its shards are then
united. In each shard every member asks the united graph: greedy search from the shard's medoid
with a beam, then from all hits on through their neighbours as long as new hits come (the
range-expanding part). Hits are verified by the cosine in double precision.

Equal vectors are one class with a count. A pair that lies in two shards counts in the first
of them only, so counts are summed per vector and no pairs leave a task but a spanning
forest. Shards over ``tile`` members are asked tile by tile: each member asks the graph of each
tile, so the work of a shard spreads over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basepaths.llm.arrow_text import by_group
from basepaths.llm.buckets import Forest
from basepaths.functions.graph import components
from basepaths.session import cut_lineage

COSINE = 0.9
SHARD_ROWS = 1000
SAMPLE = 20_000
MOST_CENTRES = 4096
DEGREE, ALPHA = 16, 1.2
BEAM = 24
SLACK = 0.05
MOST_SHARDS = 4
TILE = 1024


def unit_rows(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(id, c) of all rows and (c, n, v) of the classes; ``c`` is null for vectors that link with nothing."""
    v, alive = usable(F.col(vector_column))
    rows = vectors.select(F.col(id_column).alias("id"), F.when(alive, v).alias("v")).withColumn("c", F.when(F.col("v").isNotNull(), F.unhex(F.md5(text_of(F.col("v"))))))
    return rows.select("id", "c"), rows.where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("v"))


def usable(column):
    """The vector in doubles, and whether it can link with anything."""
    v = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v, F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def text_of(v):
    return F.array_join(F.transform(v, lambda x: (x + F.lit(0.0)).cast("string")), ",")


def normal(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(seed)
    middle = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ middle.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(middle)
        np.add.at(total, nearest, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        middle = np.where(length > 1e-9, total / np.maximum(length, 1e-9), middle)
    return middle


def shards_of(x: np.ndarray, middle: np.ndarray, slack: float = SLACK) -> list[list[int]]:
    """Places of the two nearest centres of each row, and of up to two more that are nearly as near as the second."""
    likeness = x @ middle.T
    k = min(MOST_SHARDS, likeness.shape[1])
    top = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(likeness, top, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
    near = value >= value[:, min(1, k - 1)][:, None] - slack
    return [sorted(t[ok].tolist()) for t, ok in zip(top, near)]


def pruned(x: np.ndarray, at: int, others: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Robust pruning: nearest first, and none that a kept one is nearer to (by the factor alpha)."""
    others = np.unique(others[others != at])
    far = 1 - x[others] @ x[at]
    order = np.argsort(far, kind="stable")
    others, far = others[order], far[order]
    between = 1 - x[others] @ x[others].T
    kept, open_ = [], np.ones(len(others), bool)
    while len(kept) < degree and open_.any():
        k = int(open_.argmax())
        kept.append(int(others[k]))
        open_ &= alpha * between[k] > far
        open_[k] = False
    return kept


def greedy(x: np.ndarray, graph: list[np.ndarray], start: int, query: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the beam after the nearest open place was always expanded next; ``seen`` is marked."""
    place, value, done = np.array([start]), np.array([x[start] @ query]), np.array([False])
    seen[start] = True
    visited_at, visited_value = [place], [value]
    while not done.all():
        k = int(np.where(done, -np.inf, value).argmax())
        done[k] = True
        new = graph[place[k]]
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            likeness = x[new] @ query
            visited_at.append(new)
            visited_value.append(likeness)
            place, value, done = np.concatenate([place, new]), np.concatenate([value, likeness]), np.concatenate([done, np.zeros(len(new), bool)])
            if len(place) > beam:
                best = np.argpartition(-value, beam - 1)[:beam]
                place, value, done = place[best], value[best], done[best]
    return np.concatenate(visited_at), np.concatenate(visited_value)


def in_range(x: np.ndarray, graph: list[np.ndarray], start: int, query: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Places of cosine ``least`` or more that the graph leads to."""
    seen = np.zeros(len(x), bool)
    place, value = greedy(x, graph, start, query, beam, seen)
    hits = [place[value >= least]]
    while len(hits[-1]):
        new = np.concatenate([graph[h] for h in hits[-1]])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        hits.append(new[x[new] @ query >= least] if len(new) else new)
    return np.concatenate(hits)


def build(x: np.ndarray, beam: int = BEAM, seed: int = 6) -> tuple[list[np.ndarray], int]:
    """Graph of the rows of ``x`` and the medoid: rows are inserted one by one in random order."""
    medoid = int((x @ x.mean(axis=0)).argmax())
    graph = [np.zeros(0, np.int64) for _ in range(len(x))]
    order = np.random.default_rng(seed).permutation(len(x))
    order = np.concatenate([[medoid], order[order != medoid]])
    for at in order[1:].tolist():
        place, value = greedy(x, graph, medoid, x[at], beam, np.zeros(len(x), bool))
        if len(place) > 4 * beam:
            place = place[np.argpartition(-value, 4 * beam - 1)[: 4 * beam]]
        graph[at] = np.array(pruned(x, at, place), np.int64)
        for other in graph[at].tolist():
            back = np.append(graph[other], at)
            graph[other] = back if len(back) <= DEGREE else np.array(pruned(x, other, back), np.int64)
    return graph, medoid


def matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def sharded(classes: DataFrame, shard_rows: int) -> DataFrame:
    """(c, n, x, shards, shard): a row for each shard of each class; ``x`` has length one."""
    total = classes.count()
    count = int(min(MOST_CENTRES, max(1, total // shard_rows)))
    sample = classes.orderBy("c").limit(SAMPLE)
    by_width = {}
    for row in sample.select("v").toLocalIterator():
        by_width.setdefault(len(row["v"]), []).append(row["v"])
    for width, rows in by_width.items():
        by_width[width] = centres(normal(np.array(rows, np.float64)), count)
    shared = classes.sparkSession.sparkContext.broadcast(by_width)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows, found = part.column("v").to_pylist(), []
                for width in {len(r) for r in rows}:
                    at = [i for i, r in enumerate(rows) if len(r) == width]
                    x = normal(np.array([rows[i] for i in at], np.float64))
                    middle = shared.value.get(width)
                    places = [[0]] * len(at) if middle is None else shards_of(x, middle)
                    found += [(i, v, [(width << 20) + p for p in s]) for i, v, s in zip(at, x, places)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("c").take(pa.array([f[0] for f in found], pa.int64())), part.column("n").take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.int64())),
                    ],
                    names=["c", "n", "x", "shards"],
                )

    placed = classes.select("c", "n", "v").mapInArrow(run, "c binary, n long, x array<double>, shards array<bigint>")
    return cut_lineage(placed.withColumn("shard", F.explode("shards")))


def tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` with ``tile`` and ``tiles`` of their shard."""
    sizes = rows.groupBy(F.col("shard").alias("s")).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    joined = rows.join(sizes, F.col("shard") == F.col("s")).drop("s")
    return joined.withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))


def adjacency(placed: DataFrame) -> DataFrame:
    """(c, near): the united adjacency lists of each class from all its shards and tiles."""

    def run(batches):
        for _, group in by_group(batches, ["shard", "tile"]):
            c = group.column("c").to_pylist()
            graph, _ = build(matrix(group.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array([[c[k] for k in g] for g in graph], pa.list_(pa.binary()))], names=["c", "near"])

    dealt = placed.select("shard", "tile", "c", "x").repartition("shard", "tile").sortWithinPartitions("shard", "tile", "c")
    lists = dealt.mapInArrow(run, "c binary, near array<binary>")
    # a class has a list for each of its few shards
    return lists.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def hits(placed: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(c, n, other): per class and task the linked rows in it, and links of a spanning forest."""
    asked = placed.join(lists.withColumnRenamed("c", "lc"), F.col("c") == F.col("lc"), "left")
    dealt = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "shard", "part", F.pmod(F.xxhash64("c", F.lit(1)), F.col("tiles")).cast("int").alias("ask"), "tile", "tiles", "c", "n", "x", "shards", "near"
    )
    # group (part, ask): the members of tile ``part`` form the graph, those with number ``ask`` put the questions
    roles = dealt.where("tile = part").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("asks", F.lit(False)).unionByName(
        dealt.withColumn("asks", F.lit(True))
    ).select("shard", "part", "ask", "asks", "c", "n", "x", "shards", F.when(~F.col("asks"), F.col("near")).alias("near"))
    grouped = roles.repartition("shard", "part", "ask").sortWithinPartitions("shard", "part", "ask", "asks", "c")

    def run(batches):
        for (shard, _, _), group in by_group(batches, ["shard", "part", "ask"]):
            asks = np.asarray(group.column("asks").to_numpy())
            known, questions = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
            if not known.num_rows or not questions.num_rows:
                continue
            c, x, n = known.column("c").to_pylist(), matrix(known.column("x")), known.column("n").to_numpy()
            shards = known.column("shards").to_pylist()
            place = {k: i for i, k in enumerate(c)}
            graph = [np.array([place[o] for o in near or () if o in place], np.int64) for near in known.column("near").to_pylist()]
            medoid = int((x @ x.mean(axis=0)).argmax())
            reach = reachable(graph, medoid)
            q, qx, q_shards = questions.column("c").to_pylist(), matrix(questions.column("x")), questions.column("shards").to_pylist()
            forest, row_of = Forest(len(c) + len(q)), {k: i for i, k in enumerate(q)}
            out = ([], [], [])
            for k, (name, query, own) in enumerate(zip(q, qx, q_shards)):
                found = in_range(x, reach, medoid, query, least)
                total, others = 0, []
                for f in found.tolist():
                    if c[f] == name or min(set(own).intersection(shards[f])) != shard:
                        continue
                    total += int(n[f])
                    if forest.join(len(c) + k, row_of[c[f]] + len(c) if c[f] in row_of else f):
                        others.append(c[f])
                out[0].append(name)
                out[1].append(total)
                out[2].append(others)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.binary()))], names=["c", "n", "others"])

    return cut_lineage(grouped.mapInArrow(run, "c binary, n long, others array<binary>"))


def reachable(graph: list[np.ndarray], start: int) -> list[np.ndarray]:
    """The graph with an edge from ``start`` to one member of every part that it does not reach."""
    seen = np.zeros(len(graph), bool)
    graph = list(graph)

    def walk(front):
        while len(front):
            seen[front] = True
            front = np.unique(np.concatenate([graph[f] for f in front]))
            front = front[~seen[front]]

    walk(np.array([start]))
    added = []
    for k in range(len(graph)):
        if not seen[k]:
            added.append(k)
            walk(np.array([k]))
    graph[start] = np.concatenate([graph[start], np.array(added, np.int64)])
    return graph


def near_vectors(vectors: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero, or have null or non-finite components, link with
    nothing: n_links 0, their own component. Vectors of different width do not link. Repeated
    vec_ids are rows of their own; rows without id count as links but name no component.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows, classes = unit_rows(vectors)
    rows, classes = cut_lineage(rows), cut_lineage(classes)
    placed = cut_lineage(tiles(sharded(classes, shard_rows), tile))
    found = hits(placed, cut_lineage(adjacency(placed)), least)
    totals = found.groupBy("c").agg(F.sum("n").alias("linked"))
    groups = components(found.select(F.col("c").alias("a"), F.explode("others").alias("b")))
    names = rows.where("c is not null").groupBy("c").agg(F.min("id").alias("first"))
    placed = names.join(groups, F.col("c") == F.col("node"), "left").select("c", "first", F.coalesce("component", "c").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = placed.join(heads, "root").join(totals, "c", "left").join(classes.select("c", "n"), "c").select(
        F.col("c").alias("lc"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    joined = rows.join(labels, F.col("c") == F.col("lc"), "left")
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")).cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit_recall(vectors: DataFrame, result: DataFrame, least: float = COSINE, every: int = 20, block: int = 2048) -> float:
    """Share of the true links of every ``every``-th id that ``result`` counts; brute force in blocks of queries."""
    v, alive = usable(F.col("embedding"))
    rows = vectors.where(alive).select("vec_id", v.alias("v"))
    truth, queries = 0, {}

    def ask(width):
        shared = vectors.sparkSession.sparkContext.broadcast(normal(np.array(queries.pop(width), np.float64)))

        def run(batches):
            for batch in batches:
                x = [v for v in batch.column("v").to_pylist() if len(v) == width]
                count = int((normal(np.array(x, np.float64)) @ shared.value.T >= least).sum()) if x else 0
                yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

        # each query has met itself
        return (rows.select("v").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) - len(shared.value)

    for q in rows.where(F.col("vec_id") % every == 0).toLocalIterator():
        queries.setdefault(len(q["v"]), []).append(q["v"])
        if len(queries[len(q["v"])]) == block:
            truth += ask(len(q["v"]))
    truth += sum(ask(width) for width in list(queries))
    links = result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return 1.0 if not truth else links / truth
