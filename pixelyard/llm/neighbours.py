"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch


class Tree:
    """Centroids of a hierarchical k-means tree in the space where inner products are distances.

    A vector gets one more coordinate, ``sqrt(longest ** 2 - length ** 2)``, a query a zero: then the
    nearest is the one of largest inner product, and k-means cells are meaningful for it.
    """

    def __init__(self, sample: np.ndarray, longest: float, branching: int = 8, leaf: int = 64, depth: int = 4, steps: int = 8, seed: int = 7):
        self.longest, self.children, self.centres = longest, [[]], [np.zeros(sample.shape[1] + 1)]
        self.leaf_of: dict[int, int] = {}
        rng = np.random.default_rng(seed)
        self._grow(0, self.lift(sample), branching, leaf, depth, steps, rng)
        self.leaves = len(self.leaf_of)
        self.centres = np.array(self.centres)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.longest**2 - np.einsum("ij,ij->i", x, x))
        return np.column_stack([x, np.sqrt(rest)])

    def _grow(self, node: int, x: np.ndarray, branching: int, leaf: int, depth: int, steps: int, rng) -> None:
        distinct = np.unique(x, axis=0) if len(x) <= branching else x
        k = min(branching, len(distinct))
        if depth == 0 or len(x) <= leaf or k < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(steps):
            owner = self._nearest(x, centres)
            counts = np.bincount(owner, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, owner, x)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
        owner = self._nearest(x, centres)
        used = np.unique(owner)
        if len(used) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return
        for c in used:
            self.children.append([])
            self.centres.append(centres[c])
            self.children[node].append(len(self.children) - 1)
        for child, c in zip(list(self.children[node]), used, strict=True):
            self._grow(child, x[owner == c], branching, leaf, depth - 1, steps, rng)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        half = 0.5 * np.einsum("ij,ij->i", centres, centres)
        for a in range(0, len(x), 8192):
            out[a : a + 8192] = (x[a : a + 8192] @ centres.T - half).argmax(1)
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, down the nearest centroids."""
        lifted, node = self.lift(x), np.zeros(len(x), np.int64)
        waiting = [0]
        while waiting:
            here = waiting.pop()
            kids = self.children[here]
            if kids:
                rows = np.flatnonzero(node == here)
                if len(rows):
                    node[rows] = np.array(kids)[self._nearest(lifted[rows], self.centres[kids])]
                    waiting += kids
        return np.array([self.leaf_of[int(n)] for n in node], np.int64) if len(x) else np.empty(0, np.int64)

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """All leaves in the order of a best-bin-first walk: the nearest open branch of the whole tree comes
        next. The walk goes on only as far as leaves are taken from it."""
        q = np.append(query, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf_of[node]
                continue
            gaps = self.centres[kids] - q
            for d, kid in zip(np.einsum("ij,ij->i", gaps, gaps).tolist(), kids, strict=True):
                heapq.heappush(queue, (d, kid))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows with an id whose vector has only finite components, and not only zeros."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _top_in_blocks(top: int):
    """Of blocks with query rows and candidate rows, each query's best candidates by inner product.

    The rows of a block come sorted, queries first; candidates are scored as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, queries, ids, best_score, best_id = None, [], [], None, None

        def close() -> Iterator[pa.RecordBatch]:
            if best_score is not None and best_score.shape[1]:
                found = np.isfinite(best_score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), found.sum(1))), pa.array(best_id[found]), pa.array(best_score[found])], names=["query", "class", "near"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            role, own = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (role[1:] != role[:-1]), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if tuple(keys[a]) != block:
                    yield from close()
                    block, queries, ids, best_score, best_id = tuple(keys[a]), [], [], None, None
                x = _matrix(batch.column(4).slice(a, b - a))
                if role[a] == 0:
                    queries.append(x)
                    ids += own[a:b].tolist()
                elif ids:
                    if len(queries) > 1 or best_score is None:
                        queries = [np.concatenate(queries)]
                    for c in range(0, len(x), 2048):
                        score = queries[0] @ x[c : c + 2048].T
                        names = np.broadcast_to(own[a + c : a + min(c + 2048, b - a)], score.shape)
                        if best_score is not None:
                            score, names = np.concatenate([best_score, score], 1), np.concatenate([best_id, names], 1)
                        if score.shape[1] > top:
                            keep = np.argpartition(-score, top - 1, 1)[:, :top]
                            score, names = np.take_along_axis(score, keep, 1), np.take_along_axis(names, keep, 1)
                        best_score, best_id = score, names
        yield from close()

    return run


def _deal(queries: DataFrame, candidates: DataFrame, partitions: int) -> DataFrame:
    """Rows (leaf, part, role, id, vector) of both sides, a block's together and its queries first."""
    both = queries.select("leaf", "part", F.lit(0).alias("role"), "id", "vector").unionByName(candidates.select("leaf", "part", F.lit(1).alias("role"), "id", "vector"))
    return both.repartition(partitions, "leaf", "part").sortWithinPartitions("leaf", "part", "role", "id")


_NEAR = "query long, class long, near double"


def search(rows: DataFrame, is_query, k: int = 20, vector_col: str = "embedding", recall: float = 0.97, sample: int = 20_000, trials: int = 200, block: int = 2_000) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every row with ``is_query``.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query is no
    candidate of its own. Vectors that are null, zero, or hold a null or non-finite component take no
    part, and neither do vectors of another length than most have (of two lengths that are as frequent,
    the longer). Fewer than ``k`` candidates: all of them. Rows that repeat
    an id and vector count once for each row. An empty input gives no rows.

    1. Equal vectors are one class (with its ``k + 1`` smallest ids, which is all a result can need), so
       copies neither fill leaves nor are searched twice.
    2. A tree is fitted on at most ``sample`` classes (those with the smallest hashes) on the driver;
       every class is put into its leaf.
    3. ``trials`` query classes are searched in all rows, in blocks. Leaf visits widen until their mean
       recall reaches ``recall``: so many leaves every query visits, in best-bin-first order, and more
       while those hold fewer than ``k + 1`` classes.
    4. A leaf's classes are dealt in parts of about ``block``; each part meets the queries that visit the
       leaf, and only each query's best of a part go on.
    """
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    plain = usable(rows, vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    # -0.0 equals 0.0.
    plain = plain.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    lengths = plain.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    plain = plain.where(F.size("vector") == (lengths["size"] if lengths else 0))
    plain = scratch.write("vectors", plain.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(1))}))
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    whole = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = plain.select("h1", "h2", "vec_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    first = first.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    named = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1
    named = named.withColumn("id", F.element_at("ids", 1))
    asks = plain.where("asks").select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    classes = plain.select("h1", "h2", F.col("vec_id").alias("id"), "vector").join(named, ["h1", "h2", "id"]).dropDuplicates(["h1", "h2"]).join(asks, ["h1", "h2"], "left")
    classes = scratch.write("classes", classes)

    fit = np.array([r[0] for r in classes.orderBy("h1", "h2").limit(sample).select("vector").collect()])
    if not len(fit):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = float(classes.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0])
    tree = Tree(fit, longest)
    sent = spark.sparkContext.broadcast(tree)  # a bounded number of centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent.value.assign(_matrix(batch.column(1))))], names=["id", "vector", "leaf"])

    leaves = scratch.write("leaves", classes.select("id", "vector").mapInArrow(place, "id long, vector array<double>, leaf long"))
    sizes = {r["leaf"]: r["count"] for r in leaves.groupBy("leaf").count().collect()}  # one row per leaf of the tree
    parts = spark.createDataFrame([(leaf, -(-n // block)) for leaf, n in sizes.items()], "leaf long, parts long")
    dealt = leaves.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    # Calibration: the exact neighbours of some query classes, found in blocks of all classes.
    trial = classes.where("asked").orderBy("h2", "h1").limit(trials).select("id", "vector")
    total = sum(sizes.values())
    blocks = -(-total // block)
    each = F.broadcast(trial).withColumn("leaf", F.lit(-1).cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    every = leaves.select(F.lit(-1).cast("long").alias("leaf"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("part"), "id", "vector")
    exact = _deal(each, every, partitions).mapInArrow(_top_in_blocks(k + 1), _NEAR)
    exact = exact.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "class"))).where(F.col("r") <= k + 1)
    truth: dict[int, list[int]] = {}
    for r in exact.join(leaves.select(F.col("id").alias("class"), "leaf"), "class").select("query", "leaf").collect():  # trials * (k + 1) rows
        truth.setdefault(r["query"], []).append(r["leaf"])
    asked = {r["id"]: np.array(r["vector"]) for r in trial.collect()}
    ranks = []
    for q, found in truth.items():
        order = {leaf: i for i, leaf in enumerate(tree.visits(asked[q]))}
        ranks.append([order[leaf] for leaf in found])
    visits = 1
    while visits < tree.leaves and np.mean([np.mean(np.array(r) < visits) for r in ranks] or [1.0]) < recall:
        visits += max(1, visits // 8)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, row, leaf = _matrix(batch.column(1)), [], []
            for i in range(len(vectors)):
                held = 0
                for n, to in enumerate(sent.value.visits(vectors[i])):
                    if n >= visits and held > k:
                        break
                    held += sizes.get(to, 0)
                    row.append(i)
                    leaf.append(to)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())), pa.array(leaf, pa.int64())], names=["id", "vector", "leaf"])

    asking = classes.where("asked").select("id", "vector").repartition(partitions).mapInArrow(ask, "id long, vector array<double>, leaf long")
    asking = asking.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    near = _deal(asking, dealt, partitions).mapInArrow(_top_in_blocks(k + 1), _NEAR)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "class"))).where(F.col("r") <= k + 1)
    ranked = scratch.write("near", ranked.select("query", "class", "near"))

    # Scores again from the original vectors, one pair at a time, so that they do not depend on blocks.
    own, other = classes.select(F.col("id").alias("query"), F.col("vector").alias("q")), classes.select(F.col("id").alias("class"), F.col("vector").alias("v"), "ids")
    scored = ranked.join(own, "query").join(other, "class").select("query", F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"), "ids")
    # A class's best candidates: k + 1 ids, so that every query still has k others.
    flat = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    flat = flat.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = scratch.write("lists", flat.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found")))
    askers = plain.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(classes.select("h1", "h2", F.col("id").alias("query")), ["h1", "h2"])
    out = askers.join(lists, "query").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
