"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors are dealt at random to shards of bounded size. In a shard every vector gets one more
component that makes all norms equal, so that the largest inner product is the least distance. Greedy
searches over the growing graph propose a vector's neighbours; pruning with a relaxed distance keeps
the ones that lead in different directions; edges are mirrored and pruned again. A query runs a beam
search in each shard, in blocks of queries, and the shards' best are merged. The beam is as wide as a
measured recall asks for.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import load, materialised, shared_path, store

DEGREE, BUILD_BEAM, SEARCH_BEAM = 32, 64, 128
#: Squared relaxations of the distance in the two passes of the build.
RELAXED = (1.0, 1.44)
SHARDS, SHARD_ROWS, QUERY_BLOCK = 8, 20_000, 8_192
BATCH, EXPANDED = 512, 4
#: The recall that a task's beam must reach, and the queries that it is measured on.
RECALL, SAMPLE = 0.95, 48


def levelled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a last component that gives all of them the largest norm."""
    norms = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(0.0, norms.max(initial=0.0) - norms))[:, None]], axis=1).astype(np.float32)


def beam_search(points: np.ndarray, out: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the positions and inner products of the beam's best, best first; -1 where there are fewer.

    out has the graph's edges, -1 where a point has fewer. All queries of the call advance together;
    each step expands the best points of a beam that were not expanded yet.
    """
    m, n = len(queries), len(points)
    ids = np.full((m, beam), -1, np.int64)
    near = np.full((m, beam), -np.inf, np.float32)
    opened = np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0], near[:, 0], opened[:, 0] = entry, queries @ points[entry], False
    seen[:, entry] = seen[:, n] = True
    live = np.arange(m)
    while len(live):
        rank = np.where(opened[live], -np.inf, near[live])
        best = np.argpartition(-rank, min(EXPANDED, beam) - 1, axis=1)[:, :EXPANDED]
        some = np.isfinite(np.take_along_axis(rank, best, axis=1))
        going = some.any(axis=1)
        live, best, some = live[going], best[going], some[going]
        if not len(live):
            break
        at = np.where(some, np.take_along_axis(ids[live], best, axis=1), -1)
        opened[live[:, None], best] = True
        found = np.where((at >= 0)[:, :, None], out[at], -1).reshape(len(live), -1)
        found = np.sort(np.where(found < 0, n, found), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        fresh = ~seen[live[:, None], found]
        width = int(fresh.sum(axis=1).max(initial=0))
        if not width:
            continue
        pick = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        found, fresh = np.take_along_axis(found, pick, axis=1), np.take_along_axis(fresh, pick, axis=1)
        seen[live[:, None], found] = True
        gain = np.matmul(points[np.where(fresh, found, 0)], queries[live][:, :, None])[:, :, 0]
        every_near = np.concatenate([near[live], np.where(fresh, gain, -np.inf)], axis=1)
        every_ids = np.concatenate([ids[live], np.where(fresh, found, -1)], axis=1)
        every_open = np.concatenate([opened[live], ~fresh], axis=1)
        keep = np.argpartition(-every_near, beam - 1, axis=1)[:, :beam]
        near[live], ids[live], opened[live] = (np.take_along_axis(x, keep, axis=1) for x in (every_near, every_ids, every_open))
    order = np.argsort(-near, axis=1, kind="stable")
    near, ids = np.take_along_axis(near, order, axis=1), np.take_along_axis(ids, order, axis=1)
    return np.where(np.isfinite(near), ids, -1), near


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, relaxed: float, degree: int) -> np.ndarray:
    """Up to `degree` of each row's candidates (-1: none): the nearest one is kept, candidates that are nearer to it
    than, relaxed, to the point itself go, and so on."""
    none = (candidates < 0) | (candidates == of[:, None])
    cand = np.where(none, 0, candidates)
    x = points[cand]
    level = float((points[0] * points[0]).sum())
    to_point = np.where(none, np.inf, 2 * level - 2 * np.matmul(x, points[of][:, :, None])[:, :, 0])
    order = np.argsort(to_point, axis=1, kind="stable")
    to_point, cand, x = np.take_along_axis(to_point, order, axis=1), np.take_along_axis(cand, order, axis=1), np.take_along_axis(x, order[:, :, None], axis=1)
    between = 2 * level - 2 * np.matmul(x, x.transpose(0, 2, 1))
    alive = np.isfinite(to_point)
    kept = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(min(degree, cand.shape[1])):
        left = alive.any(axis=1)
        if not left.any():
            break
        first = alive.argmax(axis=1)
        kept[left, k] = cand[rows, first][left]
        alive &= relaxed * between[rows, first] > to_point
        alive[rows, first] = False
    return kept


def _mirror(points: np.ndarray, out: np.ndarray, of: np.ndarray, relaxed: float) -> None:
    """Add the reverse of every edge of `of`; a point that then has too many is pruned."""
    degree = out.shape[1]
    target, source = out[of].ravel(), np.repeat(of, degree)
    target, source = target[out[of].ravel() >= 0], source[out[of].ravel() >= 0]
    known = (out[target] == source[:, None]).any(axis=1)
    order = np.argsort(target[~known], kind="stable")
    target, source = target[~known][order], source[~known][order]
    if not len(target):
        return
    points_in, first, extra = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, extra)
    for low in range(0, len(points_in), BATCH):
        some = points_in[low : low + BATCH]
        a, b = first[low], first[low] + extra[low : low + BATCH].sum() if low + BATCH >= len(points_in) else first[low + BATCH]
        more = np.full((len(some), int(extra[low : low + BATCH].max())), -1, np.int64)
        more[np.searchsorted(some, target[a:b]), place[a:b]] = source[a:b]
        every = np.concatenate([out[some], more], axis=1)
        room = (every >= 0).sum(axis=1) <= degree
        packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), axis=1)
        out[some[room]] = packed[room][:, :degree]
        if (~room).any():
            out[some[~room]] = robust_prune(points, some[~room], every[~room], relaxed, degree)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, int]:
    """The edges of each point (-1 where fewer), and the entry point. Every point can be reached from the entry."""
    n, rng = len(points), np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    out = np.full((n, degree), -1, np.int64)
    entry = int((points @ points.mean(axis=0)).argmax())
    if n == 1:
        return out, entry
    other = rng.integers(0, n - 1, (n, degree))
    out[:] = other + (other >= np.arange(n)[:, None])
    for relaxed in RELAXED:
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            of = order[low : low + BATCH]
            found, _ = beam_search(points, out, entry, points[of], beam)
            out[of] = robust_prune(points, of, np.concatenate([found, out[of]], axis=1), relaxed, degree)
            _mirror(points, out, of, relaxed)
    return _reachable(out, entry, points), entry


def _reachable(out: np.ndarray, entry: int, points: np.ndarray) -> np.ndarray:
    """out, with an edge more to each point that the entry could not reach, from the nearest one it could."""
    while True:
        reached = np.zeros(len(out), bool)
        reached[entry] = True
        front = np.array([entry])
        while len(front):
            step = out[front].ravel()
            step = np.unique(step[step >= 0])
            front = step[~reached[step]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return out
        inside = np.flatnonzero(reached)
        some = lost[:BATCH]
        near = inside[(points[some] @ points[inside].T).argmax(axis=1)]
        more = np.full((len(out), int(np.unique(near, return_counts=True)[1].max())), -1, np.int64)
        for a, b in zip(near.tolist(), some.tolist(), strict=True):
            more[a, int((more[a] >= 0).sum())] = b
        out = np.concatenate([out, more], axis=1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _top(queries: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` points with the largest inner products with each query, best first."""
    near = queries @ points.T
    at = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(points) else np.tile(np.arange(len(points)), (len(queries), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, axis=1), axis=1, kind="stable"), axis=1)


def beam_for(points: np.ndarray, out: np.ndarray, entry: int, queries: np.ndarray, k: int, beam: int, recall: float) -> int | None:
    """The beam, doubled from the given one, at which a sample of the queries finds its best 3 and best k with this
    recall, as a scan of the points tells; None where a beam of an eighth of the points would not do."""
    some = queries[:: max(1, len(queries) // SAMPLE)][:SAMPLE]
    want = _top(some, points, min(k, len(points)))
    beam = max(beam, k)
    while beam * 8 <= max(len(points), 8 * k):
        found, _ = beam_search(points, out, entry, some, min(beam, len(points)))
        shares = [np.mean([np.isin(w[:n], f[:n]).mean() for w, f in zip(want, found, strict=True)]) for n in (3, k)]
        if min(shares) >= recall:
            return beam
        beam *= 2
    return None


def search_shard(points: np.ndarray, out: np.ndarray, entry: int, queries: np.ndarray, k: int, beam: int, recall: float | None) -> tuple[np.ndarray, int | None]:
    """The best k points of each query, -1 where fewer, and the beam used; None for a scan of all points, which is exact.

    Without a recall to reach, every point is scanned.
    """
    width = min(k, len(points))
    chosen = beam_for(points, out, entry, queries, k, beam, recall) if recall is not None and len(points) > 8 * k else None
    found = []
    for low in range(0, len(queries), BATCH):
        part = queries[low : low + BATCH]
        found.append(_top(part, points, width) if chosen is None else beam_search(points, out, entry, part, chosen)[0][:, :width])
    return np.concatenate(found), chosen


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, degree: int = DEGREE, build_beam: int = BUILD_BEAM, search_beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, recall: float | None = RECALL) -> DataFrame:
    """For each query row of `vectors` (vec_id, embedding): query_id, rank (from 1), vec_id, score.

    The k rows with the largest inner product that the search finds, or all if there are fewer; ties go
    to the smaller vec_id. Rows without a vec_id and unusable vectors take no part. Vectors of different
    lengths have no inner product: each length is searched for itself. Equal vectors are one point of a
    graph with their k + 1 smallest ids, which is all that a result can hold. A row that repeats both id
    and vector counts once. Very long vectors are vectors like any other; texts and other columns are
    ignored. Without usable vectors there are no rows.

    Each shard's graph and each block of queries is written to the shared folder once, and the tasks, one
    for each pair of them, read both from there. A task measures the recall of its beam on a sample of its
    queries, and widens it until `recall` is reached; where the graph cannot do that, as with vectors
    spread evenly in many dimensions, it scans the shard. recall=None scans every shard: an exact search.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null").where(usable(F.col("v")))
    first = rows.select("v", "vec_id").withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = materialised(first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("point", F.monotonically_increasing_id()))
    asked = rows.where("asks").select("v", F.col("vec_id").alias("query_id")).distinct()
    asking = materialised(asked.join(points.select("v", "point"), "v").select("query_id", F.col("point").alias("q"), "v"))

    def parted(df: DataFrame, key: str, size: int, least: int, name: str) -> tuple[DataFrame, DataFrame | None, dict[int, int]]:
        """df with a part number, each part of one length and about `size` rows; the range of parts of each length; how many there are."""
        counts = df.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row per length
        sizes = [(r["d"], max(least, -(-r["n"] // size))) for r in counts]
        if not sizes:
            return df, None, {}
        table = spark.createDataFrame([(d, n, sum(m for _, m in sizes[:i])) for i, (d, n) in enumerate(sizes)], "d int, parts int, base int")
        placed = df.withColumn("d", F.size("v")).join(F.broadcast(table), "d").withColumn(name, (F.col("base") + F.pmod(F.xxhash64(key), F.col("parts"))).cast("int"))
        return placed.drop("d", "parts", "base"), table.select("d", F.col("base").alias(f"{name}_from"), (F.col("base") + F.col("parts") - 1).alias(f"{name}_to")), dict(sizes)

    sharded, shards, by_length = parted(points, "v", shard_rows, SHARDS, "shard")
    blocked, blocks, asked_by_length = parted(asking.select("q", "v").dropDuplicates(["q"]), "q", query_block, 1, "block")
    if shards is None or blocks is None:
        return spark.createDataFrame([], shape)
    folder = shared_path(spark, "nearest")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(part["v"].to_numpy())
        out, entry = build_graph(levelled(exact), degree, build_beam) if recall is not None else (np.full((len(exact), 1), -1, np.int64), 0)
        shard = int(part["shard"].iloc[0])
        store(f"{folder}/shard-{shard}", pickle.dumps((exact, part["point"].to_numpy(np.int64), out.astype(np.int32), entry), 5))
        return pd.DataFrame({"shard": [shard]})

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        block = int(part["block"].iloc[0])
        store(f"{folder}/block-{block}", pickle.dumps((np.stack(part["v"].to_numpy()), part["q"].to_numpy(np.int64)), 5))
        return pd.DataFrame({"block": [block]})

    stored = materialised(sharded.select("shard", "point", "v").groupBy("shard").applyInPandas(link, "shard int"))
    kept = materialised(blocked.select("block", "q", "v").groupBy("block").applyInPandas(keep, "block int"))
    every = shards.join(F.broadcast(blocks), "d")  # a row per length
    pairs = every.select("block_from", "block_to", F.explode(F.sequence("shard_from", "shard_to")).alias("shard")).join(stored, "shard")
    pairs = pairs.select("shard", F.explode(F.sequence("block_from", "block_to")).alias("block")).join(kept, "block")
    work = sum(n * by_length.get(d, 0) for d, n in asked_by_length.items())
    tasks = pairs.repartitionByRange(max(spark.sparkContext.defaultParallelism, min(work, 10_000)), "shard", "block").sortWithinPartitions("shard", "block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shard, graph = None, None
        for batch in batches:
            for shard, block in zip(batch["shard"].tolist(), batch["block"].tolist(), strict=True):
                if shard != open_shard:
                    open_shard, graph = shard, pickle.loads(load(f"{folder}/shard-{shard}"))
                    level = levelled(graph[0])
                exact, names, out, entry = graph
                wanted, q = pickle.loads(load(f"{folder}/block-{block}"))
                flat = np.concatenate([wanted, np.zeros((len(wanted), 1))], axis=1).astype(np.float32)
                found, _ = search_shard(level, out.astype(np.int64), entry, flat, k + 1 + 8, search_beam, recall)
                for low in range(0, len(q), BATCH):
                    who, at = np.nonzero(found[low : low + BATCH] >= 0)
                    hit, who = found[low : low + BATCH][who, at], who + low
                    yield pd.DataFrame({"q": q[who], "point": names[hit], "score": np.einsum("ij,ij->i", exact[hit], wanted[who])})

    found = tasks.mapInPandas(ask, "q long, point long, score double")
    # The planner takes what the search finds for no larger than the table of its tasks, and would broadcast it.
    listed = found.hint("merge").join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = listed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.select("query_id", "q").join(best, "q").select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
