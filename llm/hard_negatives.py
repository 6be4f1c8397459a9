"""Hard negatives by Fagin's threshold algorithm.

Rows are kept once, as shards: a matrix of integers and, for every dimension, the list of the shard's
rows in the order of that dimension. Anchors are read in blocks of bounded size. For a block, tasks go
through the shards: each anchor reads every dimension's list from the end that the sign of its own
component makes favourable (sorted access), scores the rows it meets with integers (random access), and
stops as soon as the threshold, the score of a row that would stand at all reached positions at once,
lies strictly below what every window still needs. What a task has found in one shard narrows the next one.

The first walk finds an anchor's positives (window: its label, any score). They fix the score windows of
the second walk, for the negatives. Tasks send the best rows of each window; these are merged by Spark,
and the results of a block are written before the next one is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.shared import folder, keep_table

SHARD_ROWS = 8192
#: Cells (rows by dimensions) of a shard and of a block of anchors, whatever the number of dimensions.
SHARD_CELLS, BLOCK_CELLS = 1 << 20, 1 << 21
#: Positions of every list that are read before the threshold is looked at; doubled after each look.
STEP = 16
MOST = 2**63 - 1


def _as_integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles; missing ones at the end of a short vector are 0."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return F.concat(whole, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(vector)))


def _usable(vector: Column, scale: int) -> Column:
    """No component is null or not finite; their integers are longs."""
    fits = F.lit(float(2**62))
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double") * F.lit(float(scale))) < fits, F.lit(False))
    )


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _write_shards(rows: DataFrame, dims: int) -> DataFrame:
    """(size, ids, labels, cells, order): one row per shard, its arrays as bytes.

    ``order[d]`` lists the shard's rows by their component ``d``, the least first."""
    most = max(1, min(SHARD_ROWS, SHARD_CELLS // max(1, dims)))

    def shard(ids: np.ndarray, labels: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(cells, axis=0, kind="stable").T.astype(np.uint16 if most <= 1 << 16 else np.uint32)
        parts = [ids.tobytes(), labels.tobytes(), cells.astype(np.int64).tobytes(), np.ascontiguousarray(order).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([len(ids)]), *[pa.array([p]) for p in parts]], ["size", "ids", "labels", "cells", "order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            cells = _matrix(batch.column("cells"), dims)
            start = 0
            while start < len(ids):
                end = min(len(ids), start + most - sum(len(h[0]) for h in held))
                held.append((ids[start:end], labels[start:end], cells[start:end].copy()))
                start = end
                if sum(len(h[0]) for h in held) == most:
                    yield shard(*[np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
        if held:
            yield shard(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return keep_table(rows.mapInArrow(run, "size bigint, ids binary, labels binary, cells binary, order binary"))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, cells, order) of every shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, ids, labels, cells, order = (batch.column(c)[i].as_py() for c in ("size", "ids", "labels", "cells", "order"))
            cells = np.frombuffer(cells, np.int64).reshape(n, -1)
            kind = np.uint16 if len(order) == 2 * cells.size else np.uint32
            yield np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), cells, np.frombuffer(order, kind).reshape(-1, n)


def _number(cells: np.ndarray, anchors: np.ndarray) -> type:
    """The fastest type in which every inner product and partial sum is exact."""
    most = [int(np.abs(x).max(initial=0)) for x in (cells, anchors)]
    bound = most[0] * most[1] * cells.shape[1]
    if bound < 2**24:
        return np.float32
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


class _Walk:
    """The sorted lists of a shard, for anchors of one number type."""

    def __init__(self, cells: np.ndarray, order: np.ndarray, kind: type):
        self.cells = cells.astype(kind)
        self.order = order
        self.sorted = np.take_along_axis(self.cells.T, order.astype(np.int64), axis=1)

    def meet(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """(rows, their scores, threshold), rows that no step before has met. The threshold bounds the
        scores of all rows not met yet; after the last step it is None, as there are none."""
        n = len(self.cells)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        fresh = np.ones(n, bool)
        depth, step = 0, STEP
        while depth < n:
            end = min(n, depth + step)
            near = np.zeros(n, bool)
            near[self.order[up, n - end : n - depth]] = True
            near[self.order[down, depth:end]] = True
            if end == n:
                near[:] = True
            rows = np.flatnonzero(near & fresh)
            fresh[rows] = False
            scores = self.cells[rows] @ anchor
            bound = self.sorted[up, n - end] @ anchor[up] + self.sorted[down, end - 1] @ anchor[down]
            done = end == n or not fresh.any()
            yield rows, scores, None if done else bound
            if done:
                return
            depth, step = end, 2 * step


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond the range of a long are its ends."""
    if scores.dtype == object:
        return np.array([min(max(int(s), -MOST), MOST) for s in scores], np.int64)
    return scores.astype(np.int64)


def _walk_windows(shards: DataFrame, block: Broadcast, same_label: bool) -> DataFrame:
    """(anchor, window, id, score): the ``k`` best rows of every window among a task's shards.

    ``block`` holds (ids, labels, cells of the anchors, their windows, k). A window is (anchor, least, greatest score);
    its rows have the anchor's label, or another one, and not the anchor's id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, anchors, (of, least, greatest), k = block.value
        first = np.searchsorted(of, np.arange(len(own_ids) + 1))
        found: list[tuple | None] = [None] * len(of)
        for ids, labels, cells, order in _read_shards(batches):
            kind = _number(cells, anchors)
            walk, vectors = _Walk(cells, order, kind), anchors.astype(kind)
            for i in range(len(own_ids)):
                windows = range(first[i], first[i + 1])
                if not windows:
                    continue
                wanted = (labels == own_labels[i]) == same_label
                wanted &= ids != own_ids[i]
                for rows, scores, bound in walk.meet(vectors[i]):
                    some = wanted[rows]
                    rows, scores = rows[some], _as_long(scores[some])
                    needed = []
                    for w in windows:
                        inside = (scores >= least[w]) & (scores <= greatest[w])
                        if inside.any():
                            held = found[w] or (np.zeros(0, np.int64), np.zeros(0, np.int64))
                            all_scores = np.concatenate([held[0], scores[inside]])
                            all_ids = np.concatenate([held[1], ids[rows[inside]]])
                            best = _best(all_scores, all_ids, k)
                            found[w] = all_scores[best], all_ids[best]
                        full = found[w] is not None and len(found[w][0]) == k
                        needed.append(int(found[w][0][-1]) if full else int(least[w]))
                    if bound is not None and int(bound) < min(needed):
                        break
        held = [w for w in range(len(of)) if found[w] is not None]
        if held:
            sizes = [len(found[w][0]) for w in held]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(of[held], sizes)),
                    pa.array(np.repeat(np.array(held), sizes)),
                    pa.array(np.concatenate([found[w][1] for w in held])),
                    pa.array(np.concatenate([found[w][0] for w in held])),
                ],
                ["anchor", "window", "id", "score"],
            )

    partial = shards.mapInArrow(run, "anchor bigint, window bigint, id bigint, score bigint")
    order = Window.partitionBy("window").orderBy(F.col("score").desc(), F.col("id"))
    ranked = partial.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= block.value[4])


def hard_negatives(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """For every anchor and each of its best ``positives`` (rows of its label), the best ``negatives``
    of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Components count as
    floor(``scale`` x); a score is the integer inner product. Higher scores come first, ties go to the smaller id.
    ``is_anchor`` is a condition on the rows, by default a key divisible by 50; ``label`` may be an expression.

    Rows without a key or label, or with a vector that is null or has a component that is null, not finite or (scaled) beyond
    2^62, take no part. Short vectors end in zeros. Rows that share a key stand each for itself, but none is a positive or
    negative of an anchor with its key; a repeated anchor repeats its rows. Scores beyond a long count as the longs' ends. An
    empty table, an anchor without positives and a window without rows give no rows. Other columns are ignored.
    """
    own = F.col(f"`{key}`").cast("long")
    marked = F.pmod(own, F.lit(50)) == 0 if is_anchor is None else is_anchor
    mark = F.col(f"`{label}`") if isinstance(label, str) else label
    values = F.col(f"`{vector}`")
    used = rows.select(own.alias("id"), mark.cast("long").alias("label"), values.alias("values"), marked.alias("chosen")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("values"), scale)
    )
    count, dims = used.agg(F.count(F.lit(1)), F.greatest(F.max(F.size("values")), F.lit(1))).first()
    spark = rows.sparkSession
    out = folder(spark)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    if count:
        whole = used.select("id", "label", "chosen", _as_integers(F.col("values"), dims, scale).alias("cells"))
        anchors = keep_table(whole.filter("chosen").drop("chosen").withColumn("at", F.monotonically_increasing_id()))
        shards = _write_shards(whole.drop("chosen").repartition(max(1, math.ceil(count * dims / SHARD_CELLS)), "id"), dims)
        blocks = max(1, math.ceil(anchors.count() * dims / block_cells))
        for b in range(blocks):
            part = anchors.filter(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b).orderBy("at").drop("at").toArrow().combine_chunks()
            if part.num_rows:
                _mine_block(shards, part, dims, (positives, negatives, low, high)).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _mine_block(shards: DataFrame, part: pa.Table, dims: int, numbers: tuple[int, int, int, int]) -> DataFrame:
    """Rows of the result for one block of anchors."""
    positives, negatives, low, high = numbers
    sc = shards.sparkSession.sparkContext
    ids, labels = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
    cells = _matrix(part.column("cells").chunk(0), dims).astype(np.int64)
    each = np.arange(len(ids))
    open_windows = (each, np.full(len(ids), -MOST), np.full(len(ids), MOST))
    first = sc.broadcast((ids, labels, cells, open_windows, positives))
    best = _walk_windows(shards, first, True).orderBy("anchor", "rank").toArrow()
    of, positive, score = (best.column(c).to_numpy() for c in ("anchor", "id", "score"))
    # low * score <= 100 * negative <= high * score, in whole numbers.
    least = np.array([-(-low * int(s) // 100) for s in score], np.int64)
    greatest = np.array([high * int(s) // 100 for s in score], np.int64)
    second = sc.broadcast((ids, labels, cells, (of, least, greatest), negatives))
    mined = _walk_windows(shards, second, False)

    # The block's positives are known here; what was mined gets them by window number.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("window").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of[w]]), pa.array(positive[w]), batch.column("rank"), batch.column("id"), pa.array(score[w]), batch.column("score")],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return mined.mapInArrow(run, schema)


def hard_negatives_sql() -> str:
    """DuckDB SQL of ``op13_hard_negatives`` on ``embeddings``."""
    return """
WITH used AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.id AS anchor, r.id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM used a JOIN used r ON a.id <> r.id WHERE a.id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
), mined AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 3
"""
