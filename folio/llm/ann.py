"""Approximate nearest neighbours by stable projections and a kd-tree.

Inner-product search is turned into Euclidean search by one further component
that gives all vectors the same norm. Vectors are projected to ``PROJECTED`` dimensions by
a Gaussian (2-stable) matrix and indexed by a kd-tree: its upper levels, fitted
on a bounded sample of projections, deal all vectors into cells, each with the box of what it holds; each block of
a cell has its own lower levels. A query takes projected neighbours in rising distance, cell by cell, leaf by leaf and
vector by vector, and verifies their true distances, until the chi-square test holds: a vector at
the distance of the k-th best so far would lie beyond the next projected one with at most 1 - ``CONFIDENCE`` chance to be nearer.
Cells come in rounds, so that what the nearest ones hold keeps a query from most of the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Dimensions of the projection; even, so that the chi-square distribution has a closed form.
PROJECTED = 16
CONFIDENCE = 0.87
#: Projections of which the upper levels are fitted, at most; vectors of a cell as aimed at; cells at most.
SAMPLE = 131_072
CELL = 8_192
CELLS = 16_384
#: Cells that a query visits by the end of each round but the last, which takes all others that pass the test.
ROUNDS = (1, 8)
#: Vectors of a block of a cell (what a task holds at a time), of a leaf, and queries worked on together.
BLOCK = 8_192
LEAF = 128
TOGETHER = 256
#: Queries that visit a cell in one task, and visits that are handed on at a time.
QUERIES, VISITS = 4096, 4096
#: Parts into which each vector's copies are dealt before their smallest ids are gathered.
SALTS = 64


def chi_square(x: float, degrees: int = PROJECTED) -> float:
    """Chance that a chi-square value of an even number of degrees is at most x."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def stopping_ratio(confidence: float = CONFIDENCE, degrees: int = PROJECTED) -> float:
    """Squared projected distance over squared true distance at which the test holds."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, degrees) < confidence else (lo, mid)
    return hi


def projection(dims: int) -> np.ndarray:
    """The Gaussian matrix; the last row is for the further component."""
    return np.random.default_rng(17).standard_normal((dims + 1, PROJECTED))


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that brings them to the largest norm."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


class Cells:
    """Upper levels of the kd-tree: split planes as a heap, and once ``bounded``, the box of what each cell holds."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, int), np.zeros(1 << depth)
        self.cells, self.low, self.high = np.zeros(0, np.int32), np.zeros((0, PROJECTED)), np.zeros((0, PROJECTED))
        self._split(1, sample)

    def _split(self, node: int, x: np.ndarray) -> None:
        if node >= 1 << self.depth:
            return
        axis = int(np.argmax(x.var(0))) if len(x) else 0
        cut = float(np.median(x[:, axis])) if len(x) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        self._split(2 * node, x[x[:, axis] < cut])
        self._split(2 * node + 1, x[x[:, axis] >= cut])

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def bounded(self, cells, low, high) -> Cells:
        """With the boxes of the cells that hold anything."""
        self.cells, self.low, self.high = np.array(cells, np.int32), np.array(low).reshape(-1, PROJECTED), np.array(high).reshape(-1, PROJECTED)
        return self

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each cell's box."""
        return _to_boxes(q, self.low, self.high)


def _to_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        gap = np.maximum(low[None, :, k] - q[:, None, k], q[:, None, k] - high[None, :, k])
        out += np.square(np.maximum(gap, 0))
    return out


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Members of the kd-tree leaves of a block."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        axis = int(np.argmax(x[at].var(0)))
        order = at[np.argsort(x[at, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components, so that they do not depend on the batch."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Block:
    """Vectors of a block in leaves, and incremental search among them."""

    def __init__(self, ids: list[list[int]], x: np.ndarray, norm: float):
        self.ids, self.x, self.norm = ids, x, norm
        self.count = np.array([len(i) for i in ids])
        self.z = _lifted(x, norm) @ projection(x.shape[1])
        self.members = _leaves(self.z)
        self.low = np.array([self.z[m].min(0) for m in self.members])
        self.high = np.array([self.z[m].max(0) for m in self.members])

    def search(self, q: np.ndarray, bound: np.ndarray, keep: int, ratio: float):
        """For each query: positions of what may be among the best ``keep`` ids, the score of the keep-th best, and how many vectors were verified.

        ``bound``: scores of the keep-th best known so far; -inf if unknown.
        """
        square = (q * q).sum(1) + self.norm**2  # squared distance = square - 2 * score
        slack = 1e-9 * np.sqrt((q * q).sum(1)) * self.norm
        projected = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ projection(q.shape[1])
        gaps = _to_boxes(projected, self.low, self.high)
        order = np.argsort(gaps, axis=1, kind="stable")
        best, bound, verified = [], bound.copy(), np.zeros(len(q), np.int64)
        for r in range(len(q)):
            at, value = np.zeros(0, int), np.zeros(0)
            done, wave = 0, 1
            while done < len(self.members):
                leaves = order[r, done : done + wave]
                # the chi-square test, with the distance of the k-th best so far: first for leaves, then for their vectors
                reach = ratio * max(square[r] - 2 * bound[r], 0) + slack[r]
                leaves = leaves[gaps[r, leaves] <= reach]
                if not len(leaves):
                    break
                done, wave = done + wave, min(2 * wave, 8)
                near = np.concatenate([self.members[m] for m in leaves])
                near = near[np.square(self.z[near] - projected[r]).sum(1) <= reach]
                verified[r] += len(near)
                scores = self.x[near] @ q[r]
                good = np.flatnonzero(scores >= bound[r] - slack[r])
                if not len(good):
                    continue
                at, value = np.concatenate([at, near[good]]), np.concatenate([value, scores[good]])
                falling = np.argsort(-value, kind="stable")
                at, value = at[falling], value[falling]
                held = np.cumsum(self.count[at])
                if held[-1] >= keep:
                    bound[r] = max(bound[r], value[int(np.searchsorted(held, keep))])
                    cut = int(np.searchsorted(-value, -(bound[r] - slack[r]), "right"))
                    at, value = at[:cut], value[:cut]
            best.append(at)
        return best, bound, verified


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _projector(norm: float):
    """The projections of vectors, as float64 bytes."""

    def project(batches):
        for batch in batches:
            x = _vectors(batch.column("vector"))
            z = _lifted(x, norm) @ projection(x.shape[1]) if len(x) else np.zeros((0, PROJECTED))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in z], pa.binary())], names=["z"])

    return project


def _router(shared, keys: tuple[str, ...]):
    """Adds the cell of each vector and its projection."""

    def route(batches):
        cells, norm = shared.value
        for batch in batches:
            x = _vectors(batch.column("vector"))
            z = _lifted(x, norm) @ projection(x.shape[1]) if len(x) else np.zeros((0, PROJECTED))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(cells.of(z).astype(np.int32)), pa.array(list(z), pa.list_(pa.float64()))], names=[*keys, "cell", "z"])

    return route


def _visitor(shared, ratio: float, since: int, until: int | None):
    """(cell, cls, vector, bound) of the cells, from the since-th to before the until-th nearest, that pass a query's test."""

    def visit(batches):
        cells, norm = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                q = _vectors(part.column("vector"))
                z = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ projection(q.shape[1]) if len(q) else np.zeros((0, PROJECTED))
                gap = cells.distances(z)
                order = np.argsort(gap, axis=1, kind="stable")[:, since:until]
                reach = ratio * np.maximum((q * q).sum(1) + norm**2 - 2 * part.column("bound").to_numpy(zero_copy_only=False), 0)
                row, place = np.nonzero(np.take_along_axis(gap, order, axis=1) <= reach[:, None])
                for j in range(0, len(row), VISITS):
                    r, p = row[j : j + VISITS], place[j : j + VISITS]
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.cells[order[r, p]]), part.column("cls").take(take), part.column("vector").take(take), part.column("bound").take(take)],
                        names=["cell", "cls", "vector", "bound"],
                    )

    return visit


_FOUND = "cls long, bound double, verified long, best array<struct<id:long,score:double>>"
_BEST = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())]))


def _searcher(norm: float, keep: int, ratio: float):
    """Streams rows (cell, block, part, kind, cls, vector, ids, bound) sorted by cell, block, part, kind: a block's vectors, then a part of its queries."""

    def answers(block, cls, q, bound):
        for i in range(0, len(q), TOGETHER):
            part = slice(i, i + TOGETHER)
            best, reached, verified = block.search(q[part], bound[part], keep, ratio)
            out = []
            for query, at in zip(q[part], best):
                exact = inner(np.broadcast_to(query, (len(at), len(query))), block.x[at])
                rows = sorted(((-s, j) for s, k in zip(exact.tolist(), at.tolist()) for j in block.ids[k]))[:keep]
                out.append([{"id": j, "score": -s} for s, j in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[part], pa.int64()), pa.array(reached), pa.array(verified), pa.array(out, _BEST)], names=["cls", "bound", "verified", "best"]
            )

    def search(batches):
        at, ids, held, block = None, [], [], None
        for batch in batches:
            cell, number, share, kind, cls = (batch.column(c).to_numpy() for c in ("cell", "block", "part", "kind", "cls"))
            vectors, bound = _vectors(batch.column("vector")), batch.column("bound").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(share) != 0) | (np.diff(kind) != 0)) + 1), len(cell)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j == i:
                    continue
                if (cell[i], number[i], share[i]) != at:
                    at, ids, held, block = (cell[i], number[i], share[i]), [], [], None
                if kind[i] == 0:
                    ids += batch.column("ids").slice(i, j - i).to_pylist()
                    held.append(vectors[i:j])
                elif held:
                    if block is None:
                        block = Block(ids, np.concatenate(held), norm)
                    yield from answers(block, cls[i:j], vectors[i:j], bound[i:j])

    return search


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score, n_verified): for each id of ``queries`` (a column of that name), its k nearest other vectors by inner product.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k; n_verified is how many different
    vectors the query was multiplied with. Equal vectors are
    indexed once with their k + 1 smallest ids, so no group of copies meets in one task. Vectors that are null, zero, or of another length than the most frequent
    one (of equally frequent ones, the shortest), or hold null or non-finite components, take no part, nor do null ids; of an id that is repeated, each
    different vector is a candidate and a query; further columns are ignored; an empty table gives no rows. Products are made of
    vectors divided by a power of two, so that large ones rank right even where their score is infinite. Only a
    sample of projections, two norms and the cells' sizes and boxes come to the driver.
    """
    spark, keep, ratio = vectors.sparkSession, k + 1, stopping_ratio(confidence)
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    x = x.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)
    largest = F.array_max(F.transform("vector", F.abs))
    lengths = x.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("largest")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_verified long")
    dims, power = lengths[0].dims, math.frexp(lengths[0].largest)[1]
    # dividing by a power of two changes no digit (in two steps, as 2**1024 is no double); -0.0 and 0.0 hash alike only when made alike
    half = power // 2
    small = F.transform("vector", lambda c: c * 2.0**-half * 2.0 ** -(power - half) + 0.0)
    x = written(x.where(F.size("vector") == dims).withColumn("vector", small).where(F.exists("vector", lambda c: c != 0)).withColumn("cls", F.xxhash64("vector")))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    first = Window.partitionBy("cls", "salt").orderBy("id")
    salted = x.select("cls", "id", salt.alias("salt")).distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    smallest = salted.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    classes = written(x.join(smallest.select("cls", F.col("ids")[0].alias("id")), ["cls", "id"], "left_semi").dropDuplicates(["cls"]).select("cls", "vector").join(smallest, "cls"))

    square = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    total, norm = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    depth = min(max(0, math.ceil(math.log2(max(1, total / CELL)))), int(math.log2(CELLS)))
    share = classes.where(F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(max(1, -(-total // SAMPLE)))) == 0).limit(SAMPLE).select("vector") if depth else classes.limit(0).select("vector")
    sample = np.array([np.frombuffer(r.z) for r in share.mapInArrow(_projector(norm), "z binary").collect()]).reshape(-1, PROJECTED)
    cells = Cells(sample, depth)

    routed = classes.select("cls", "vector", "ids").mapInArrow(_router(spark.sparkContext.broadcast((cells, norm)), ("cls", "vector", "ids")), "cls long, vector array<double>, ids array<long>, cell int, z array<double>")
    placed = written(routed)
    ends = [f(F.col("z")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").collect()  # at most CELLS rows
    cells.bounded([b.cell for b in boxes], [[b[f"low{i}"] for i in range(PROJECTED)] for b in boxes], [[b[f"high{i}"] for i in range(PROJECTED)] for b in boxes])
    shared = spark.sparkContext.broadcast((cells, norm))
    blocks_of = spark.createDataFrame([(b.cell, -(-b.n // BLOCK)) for b in boxes], "cell int, blocks int")
    base = placed.join(F.broadcast(blocks_of), "cell").select(
        "cell", F.pmod(F.col("cls"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "cls", "vector", "ids", F.lit(0.0).alias("bound")
    )
    asked = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    asking = written(x.select("id", "cls").join(asked, "id", "left_semi").distinct())
    q = written(classes.join(asking.select("cls").distinct(), "cls", "left_semi").select("cls", "vector"))

    def visited(q: DataFrame, since: int, until: int | None) -> DataFrame:
        rows = q.mapInArrow(_visitor(shared, ratio, since, until), "cell int, cls long, vector array<double>, bound double")
        rows = written(rows)
        # the queries of a cell are dealt to parts, each with a copy of the block; at most CELLS rows say how many parts a cell has
        parts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")))
        rows = rows.join(F.broadcast(blocks_of), "cell").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("cell", "block", "part", F.lit(1).alias("kind"), "cls", "vector", F.expr("cast(null as array<long>)").alias("ids"), "bound")
        # blocks of cells that nobody visits are not read again
        used = base.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*rows.columns)
        dealt = used.union(rows).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "kind")
        return written(dealt.mapInArrow(_searcher(norm, keep, ratio), _FOUND))

    found = visited(q.withColumn("bound", F.lit(float("-inf"))), 0, ROUNDS[0])
    for since, until in zip(ROUNDS, [*ROUNDS[1:], None]):
        if since >= len(boxes):
            break
        reached = found.groupBy("cls").agg(F.max("bound").alias("bound"))
        found = found.union(visited(q.join(reached, "cls"), since, until))
    best = found.groupBy("cls").agg(F.flatten(F.collect_list("best")).alias("best"), F.sum("verified").alias("n_verified"))
    falling = F.array_sort(F.transform("best", lambda b: F.struct((-b["score"]).alias("less"), b["id"].alias("id"))))
    best = best.select("cls", F.slice(falling, 1, keep).alias("best"), "n_verified")
    mine = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    listed = asking.join(best, "cls").select(F.col("id").alias("query_id"), "n_verified", F.posexplode(mine).alias("at", "b"))
    score = -F.col("b.less") * 2.0**half * 2.0**half * 2.0 ** (power - half) * 2.0 ** (power - half)
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), score.alias("score"), "n_verified")
