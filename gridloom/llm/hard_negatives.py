"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Components become integers.  With M the largest norm, a row x gets one more coordinate, the root of
M^2 - |x|^2, and an anchor gets a zero there; then their squared distance is |a|^2 + M^2 - 2 <a, x>, so the highest
inner products are the nearest rows.  Pivots are a bounded sample of the rows.  Each row belongs to the cell of its nearest
pivot, each anchor to the group of the nearest of the first few pivots.

An anchor's scores against the sample bound from below what its last result can score, hence bound its
search radius from above.  By the triangle inequality a row at distance r from its pivot can serve an
anchor at distance d from that pivot only if |d - r| is within the radius.  Over a group that is an interval
of r for each cell; rows go to the groups whose interval holds their r, and to no other.

A group's anchors are cut into blocks and its rows into chunks, and each block meets each chunk in one exact local
join, so neither a hot cell nor a hot group lands in one task.  The local joins' first results are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

SCALE = 256
#: rows of the sample, pivots among them, and pivots that lead a group of anchors
SAMPLE, PIVOTS, GROUPS = 1024, 64, 64
BLOCK_ANCHORS, CHUNK_ROWS = 1024, 4096
#: anchors of a local join whose scores are held at once
AT_ONCE = 64
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90
#: components and squared norms below these are added and multiplied exactly in doubles
COMPONENT, NORM2 = float(1 << 26), float(1 << 52)


def vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v, nn, rn): the rows that take part, once each, with integer components, the squared norm and a number of their own."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double") * SCALE)
    usable = F.forall("w", lambda x: x.isNotNull() & (F.abs(x) < COMPONENT))
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), wide.alias("w"))
    some = some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("w").isNotNull()).where(usable)
    v = F.transform("w", lambda x: F.floor(F.when(F.abs(x) < COMPONENT, x)).cast("int"))
    whole = some.select("id", "label", v.alias("v")).distinct()
    nn = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return whole.withColumn("nn", nn).where(F.col("nn") <= NORM2).withColumn("rn", F.monotonically_increasing_id())


def wider(df: DataFrame, **types: str):
    """The schema of ``df`` with more columns."""
    return df.selectExpr("*", *[f"cast(null as {t}) as {name}" for name, t in types.items()]).schema


def matrix(column, dims: int) -> np.ndarray:
    """The rows of a list column as doubles, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = flat
    return out


class Space:
    """The sample, the pivots and the augmented geometry; small, and sent with the tasks."""

    def __init__(self, ids, labels, points: np.ndarray, most: float, pivots: int) -> None:
        self.ids, self.labels, self.points, self.most = np.array(ids, np.int64), np.array(labels, np.int64), points, most
        self.pivots = points[:pivots]
        self.extra = np.sqrt(np.maximum(most - (self.pivots**2).sum(axis=1), 0))
        self.slack = 1e-6 * (math.sqrt(most) + 1)

    def _roots(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        d = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(d + (extra[:, None] - self.extra) ** 2, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows from the pivots."""
        return self._roots(x, np.sqrt(np.maximum(self.most - (x**2).sum(axis=1), 0)))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self._roots(x, np.zeros(len(x)))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row scores ``score``."""
        return np.sqrt(np.maximum((x**2).sum(axis=1) + self.most - 2 * score, 0))


def first_scores(scores: np.ndarray, number: int) -> float:
    """The ``number``-th highest of ``scores``; minus infinity if there are fewer."""
    return float(np.partition(scores, -number)[-number]) if len(scores) >= number else -math.inf


def celled(rows: DataFrame, space: Space) -> DataFrame:
    """``rows`` with their cell and their distance r from its pivot."""
    dims = space.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.of_rows(matrix(b.column("v"), dims))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "r"])

    return rows.mapInArrow(run, wider(rows, cell="int", r="double"))


def grouped(anchors: DataFrame, space: Space, groups: int) -> DataFrame:
    """``anchors`` with the group ``g`` of each: the nearest of the first ``groups`` pivots."""
    dims = space.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = space.of_anchors(matrix(b.column("v"), dims))[:, :groups].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.int32())], [*b.schema.names, "g"])

    return anchors.mapInArrow(run, wider(anchors, g="int"))


def intervals(anchors: DataFrame, space: Space) -> list[tuple[int, int, float, float]]:
    """(g, cell, lo, hi): the distances from its pivot at which a row may serve an anchor of the group; a row for each group and cell at most.

    ``anchors`` has the highest and lowest score that an anchor still asks for in ``top`` and ``low``.
    """
    dims = space.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dims)
            g, low, top = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "low", "top"))
            d = space.of_anchors(x)
            far = np.where(np.isinf(low), np.inf, space.radius(x, np.where(np.isinf(low), 0, low)))[:, None]
            near = np.where(np.isinf(top), 0, space.radius(x, np.where(np.isinf(top), 0, top)))[:, None]
            for k in np.unique(g):
                m = g == k
                inner, other, hi = (y[m].min(axis=0) for y in (d - far, near - d, -(d + far)))
                cells = np.arange(d.shape[1])
                cols = [np.full(len(cells), k), cells, inner, other, -hi]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], ["g", "cell", "inner", "other", "hi"])

    found = anchors.select("v", "g", "low", "top").mapInArrow(run, "g int, cell int, inner double, other double, hi double")
    got = found.groupBy("g", "cell").agg(F.min("inner").alias("i"), F.min("other").alias("o"), F.max("hi").alias("h")).collect()
    return [(r["g"], r["cell"], max(r["i"], r["o"]) - space.slack, r["h"] + space.slack) for r in got]


def joined(anchors: DataFrame, rows: DataFrame, space: Space, local: Callable[[pa.Table, pa.Table], dict], schema: str, n_rows: int, block: int, chunk: int) -> DataFrame:
    """``local`` on every block of a group's anchors and every chunk of the rows that may serve the group."""
    spark = anchors.sparkSession
    blocks = {r["g"]: max(1, -(-r["n"] // block)) for r in anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = max(1, -(-n_rows // chunk))
    bounds = [(g, cell, lo, hi, b) for g, cell, lo, hi in intervals(anchors, space) for b in range(blocks[g])]
    served = spark.createDataFrame(bounds, "g int, cell int, lo double, hi double, b int")
    candidates = rows.join(F.broadcast(served), (rows["cell"] == served["cell"]) & rows["r"].between(served["lo"], served["hi"]))
    candidates = candidates.select("g", "b", F.pmod(F.xxhash64("rn"), F.lit(chunks)).alias("c"), "id", "label", "v")
    sizes = spark.createDataFrame(list(blocks.items()), "g int, n int")
    asking = anchors.join(F.broadcast(sizes), "g").withColumn("b", F.pmod(F.xxhash64("rn"), F.col("n")).cast("int")).drop("n")
    asking = asking.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(local(left, right))

    return asking.groupBy("g", "b", "c").cogroup(candidates.groupBy("g", "b", "c")).applyInArrow(run, schema)


def each_anchor(left: pa.Table, right: pa.Table, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the anchor, its scores, ids and labels of the rows), rows in the order of their ids."""
    if not left.num_rows or not right.num_rows:
        return
    ids = right.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids, labels = matrix(right.column("v"), dims)[order], ids[order], right.column("label").to_numpy()[order]
    a = matrix(left.column("v"), dims)
    for s in range(0, len(a), AT_ONCE):
        for k, scores in enumerate(a[s : s + AT_ONCE] @ x.T, s):
            yield k, scores, ids, labels


def positives(anchors: DataFrame, rows: DataFrame, space: Space, number: int, n_rows: int, block: int, chunk: int) -> DataFrame:
    """(rn, ids, scores): the first ``number`` other rows of an anchor's label, by score, then by id."""
    dims = space.points.shape[1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = matrix(b.column("v"), dims) @ space.points.T
            low = [first_scores(s[(space.labels == l) & (space.ids != i)], number) for s, i, l in zip(scores, b.column("id").to_numpy(), b.column("label").to_numpy())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.float64()), pa.array(np.full(len(low), np.inf))], [*b.schema.names, "low", "top"])

    asked = cut(anchors.mapInArrow(ask, wider(anchors, low="double", top="double")))

    def local(left: pa.Table, right: pa.Table) -> dict:
        own, mine, low, label = (left.column(c).to_numpy() for c in ("rn", "id", "low", "label"))
        found: list[list] = [[], [], []]
        for k, scores, ids, labels in each_anchor(left, right, dims):
            at = np.flatnonzero((labels == label[k]) & (ids != mine[k]) & (scores >= low[k]))
            at = at[np.argsort(-scores[at], kind="stable")[:number]]
            for column, values in zip(found, (np.full(len(at), own[k]), ids[at], scores[at])):
                column.append(values)
        return _columns(("rn", "other", "score"), found)

    met = joined(asked, rows, space, local, "rn long, other long, score long", n_rows, block, chunk)
    rank = F.row_number().over(Window.partitionBy("rn").orderBy(F.desc("score"), "other"))
    first = met.withColumn("k", rank).where(F.col("k") <= number)
    lists = first.groupBy("rn").agg(F.array_sort(F.collect_list(F.struct("k", "other", "score"))).alias("p"))
    return lists.select("rn", F.col("p.other").alias("p_ids"), F.col("p.score").alias("p_scores"))


def _columns(names: tuple[str, ...], found: list[list]) -> dict:
    return {n: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for n, v in zip(names, found)}


def negatives(anchors: DataFrame, rows: DataFrame, space: Space, number: int, least: int, most: int, n_rows: int, block: int, chunk: int) -> DataFrame:
    """(rn, positive_id, positive_score, negative_id, negative_score, rank) of ``anchors``, which have ``p_ids`` and ``p_scores``."""
    dims = space.points.shape[1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = matrix(b.column("v"), dims) @ space.points.T
            lows, low, top = [], [], []
            for s, i, l, p in zip(scores, b.column("id").to_numpy(), b.column("label").to_numpy(), b.column("p_scores").to_pylist()):
                s = 100 * s[(space.labels != l) & (space.ids != i)]
                here = [max(first_scores(s[(s >= least * x) & (s <= most * x)], number), least * x) / 100 for x in p]
                lows.append(here)
                low.append(min(here))
                top.append(max(most * x / 100 for x in p))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lows, pa.list_(pa.float64())), pa.array(low, pa.float64()), pa.array(top, pa.float64())], [*b.schema.names, "lows", "low", "top"])

    asked = cut(anchors.mapInArrow(ask, wider(anchors, lows="array<double>", low="double", top="double")))

    def local(left: pa.Table, right: pa.Table) -> dict:
        own, mine, label, low, top = (left.column(c).to_numpy() for c in ("rn", "id", "label", "low", "top"))
        p_ids, p_scores, lows = (left.column(c).to_pylist() for c in ("p_ids", "p_scores", "lows"))
        found: list[list] = [[] for _ in range(5)]
        for k, scores, ids, labels in each_anchor(left, right, dims):
            # half a point of slack, as the exact bounds follow
            at = np.flatnonzero((scores >= low[k] - 0.5) & (scores <= top[k] + 0.5) & (labels != label[k]) & (ids != mine[k]))
            at = at[np.argsort(-scores[at], kind="stable")]
            s = scores[at]
            for p, p_score, least_here in zip(p_ids[k], p_scores[k], lows[k]):
                ok = np.flatnonzero((100 * s >= least * p_score) & (100 * s <= most * p_score) & (s >= least_here - 0.5))[:number]
                for column, values in zip(found, (np.full(len(ok), own[k]), np.full(len(ok), p), np.full(len(ok), p_score), ids[at[ok]], s[ok])):
                    column.append(values)
        return _columns(("rn", "positive_id", "positive_score", "negative_id", "negative_score"), found)

    met = joined(asked, rows, space, local, "rn long, positive_id long, positive_score long, negative_id long, negative_score long", n_rows, block, chunk)
    # of two positives that share an id only the score tells
    rank = F.row_number().over(Window.partitionBy("rn", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= number)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame,
    anchor: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    sample: int = SAMPLE,
    pivots: int = PIVOTS,
    block: int = BLOCK_ANCHORS,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is an SQL condition on ``id``.  A component x counts as floor(256 * x), a score is the inner product.
    An anchor's positives are its first ``n_positives`` other ids of its label; for each, the first
    ``n_negatives`` rows of other labels whose score lies between ``least`` and ``most`` hundredths of the positive's are its negatives,
    higher scores first, ties by id.

    Rows with a null id, label or vector, with a null or infinite component or none that is a number, take no part, nor do
    those with a component of 2^18 or more or a squared norm over 2^36, whose scores would not be
    exact.  Rows that repeat id, label and vector are one row; rows that share an id alone are different rows, but
    never each other's positives.  Missing components of shorter vectors are zeros.  Other columns are
    not read.  Without rows or anchors there is no result.
    """
    spark = rows.sparkSession
    all_ = cut(vectors(rows, id_col, vector_col, label_col))
    size = all_.agg(F.count(F.lit(1)).alias("n"), F.max("nn").alias("nn"), F.max(F.size("v")).alias("dims"), F.count_if(F.expr(anchor)).alias("anchors")).first()
    if not size["anchors"]:
        return spark.createDataFrame([], RESULT)
    few = all_.select("id", "label", "v", F.xxhash64("v", "id").alias("h")).orderBy("h", "id", "label").limit(sample).collect()
    points = np.zeros((len(few), max(1, size["dims"])))
    for x, r in zip(points, few):
        x[: len(r["v"])] = r["v"]
    space = Space([r["id"] for r in few], [r["label"] for r in few], points, float(size["nn"]), pivots)
    groups = min(len(space.pivots), GROUPS, max(1, -(-size["anchors"] // block)))
    cells = cut(celled(all_.select("id", "label", "v", "rn"), space))
    asking = cut(grouped(all_.where(F.expr(anchor)).select("id", "label", "v", "rn"), space, groups))
    near = positives(asking, cells, space, n_positives, size["n"], block, chunk)
    told = cut(asking.join(near, "rn"))
    found = negatives(told, cells, space, n_negatives, least, most, size["n"], block, chunk) if not told.isEmpty() else None
    drop_cut(all_)
    if found is None:
        return spark.createDataFrame([], RESULT)
    named = found.join(told.select("rn", F.col("id").alias("anchor_id")), "rn")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), "id % 100 = 0")


SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
}
