"""Hard negatives: for each anchor a full sort of integer scores, cut by what its positives score.

Rows and anchors are dealt into blocks of bounded size, and every block of anchors meets every block of
rows once, in a task of its own. There each anchor's scores are sorted whole by score and id, each
positive's upper limit is found in the sorted scores by binary search, and up to ``k`` entries of other
labels are read from there down to the lower limit. The first ``k`` of all blocks together are the
first ``k`` of the table, so a block hands on no more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assay.storage import materialize, partitions

#: Rows that meet anchors in a task at most, on average, and the least for which a block is opened for idle tasks; anchors that meet them; and anchors whose scores are held at once.
BLOCK_ROWS, LEAST_ROWS, BLOCK_ANCHORS, HELD = 65_536, 1_024, 8_192, 64


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy()
    flat = pc.list_flatten(vectors).to_numpy()
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _products(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, its inner product with every row), exact: by floats only where they hold each sum."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    kind = np.float64 if most < 2**53 else np.int64
    across = rows.T.astype(kind)
    for at in range(0, len(anchors), HELD):
        found = (anchors[at : at + HELD].astype(kind) @ across).astype(np.int64)
        yield from enumerate(found, at)


def _meet(left: pa.Table, right: pa.Table, use: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[pa.Table, pa.Table, int, np.ndarray, np.ndarray]]:
    """(rows in order of id, anchors, anchor, rows taken, their scores); ``use`` tells which rows an anchor's label takes."""
    left = left.take(pc.sort_indices(left, sort_keys=[("id", "ascending")], null_placement="at_end"))
    codes = pa.chunked_array([*left["label"].chunks, *right["label"].chunks], left.schema.field("label").type).combine_chunks().dictionary_encode().indices.to_numpy()
    own, of_anchor = codes[: len(left)], codes[len(left) :]
    width = max(pc.max(pc.list_value_length(t["v"])).as_py() or 0 for t in (left, right))
    rows, anchors = _matrix(left["v"], width), _matrix(right["v"], width)
    for label in np.unique(of_anchor):
        taken, asked = np.flatnonzero(use(own, label)), np.flatnonzero(of_anchor == label)
        for i, scores in _products(anchors[asked], rows[taken]):
            yield left, right, int(asked[i]), taken, scores


def _rows(found: list, schema: pa.Schema, ids: Callable[[], pa.Array]) -> pa.Table:
    if not found:
        return schema.empty_table()
    anchor, place, at, scores = (np.concatenate(x) for x in zip(*found))
    return pa.Table.from_arrays([pa.array(anchor), pa.array(place.astype(np.int32)), ids().take(pa.array(at)), pa.array(scores)], schema=schema)


def _positives(schema: pa.Schema, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, rows = [], left
        if len(left) and len(right):
            anchors = right["rid"].to_numpy()
            for rows, _, i, taken, scores in _meet(left, right, lambda own, label: own == label):
                order = np.argsort(-scores, kind="stable")[: most + 1]  # rows stand in order of id
                order = order[rows["rid"].to_numpy()[taken[order]] != anchors[i]][:most]
                found.append((np.full(len(order), anchors[i]), np.zeros(len(order)), taken[order], scores[order]))
        return _rows(found, schema, lambda: rows["id"].combine_chunks())

    return run


def _negatives(schema: pa.Schema, k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, rows = [], left
        if len(left) and len(right):
            anchors, limits = right["rid"].to_numpy(), right["scores"].to_pylist()
            for rows, _, i, taken, scores in _meet(left, right, lambda own, label: own != label):
                order = np.argsort(-scores, kind="stable")  # the whole sort by score and id
                falling = -scores[order]
                for place, p in enumerate(limits[i]):
                    first = np.searchsorted(falling, -(high * p // 100), "left")
                    end = np.searchsorted(falling, low * -p // 100, "right")  # minus the least score that is high enough
                    read = order[first : max(first, min(end, first + k))]
                    found.append((np.full(len(read), anchors[i]), np.full(len(read), place), taken[read], scores[read]))
        return _rows(found, schema, lambda: rows["id"].combine_chunks())

    return run


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of each anchor and positive.

    A component x counts as floor(scale * x); a row's score is its inner product with the anchor, an exact
    64-bit integer (larger ones wrap around). Higher scores come first, then smaller ids, null ids last.
    ``anchor`` tells which rows are anchors; null is no. An anchor's positives are its first ``positives``
    other rows of its label; its negatives, rows of other labels that score from ``low`` to ``high`` percent of
    the positive, are read in order, ``k`` of them.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows equal in id,
    label and integer vector count as one; rows that share an id but differ are rows of their own. A shorter
    vector counts as filled with zeros, so an empty one scores 0. An anchor without positives, a positive
    without negatives in its limits, and an empty table give no rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.filter(F.col(label_col).isNotNull() & vector.isNotNull() & ~odd)
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v")).distinct()
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("anchor")).first()
    by_rows, by_anchors = max(1, min(2 * partitions(spark), n // LEAST_ROWS), -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_ANCHORS))

    kind = rows.schema["id"].dataType
    schema = f"anchor bigint, place int, id {kind.simpleString()}, score bigint"
    arrow = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", to_arrow_type(kind)), ("score", pa.int64())])
    block = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("rid", "id", "label", "v", block(by_rows).alias("r"), every(by_anchors).alias("a")).groupBy("a", "r")

    def meet(anchors: DataFrame, run) -> DataFrame:
        own = [F.col(c).alias(c) for c in anchors.columns]  # columns of their own: both sides come from one table
        asked = anchors.withColumn("a", block(by_anchors)).select(*own, "a", every(by_rows).alias("r")).groupBy("a", "r")
        return dealt.cogroup(asked).applyInArrow(run, schema)

    def first(found: DataFrame, most: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    anchors = rows.filter("anchor").select("rid", "id", "label", "v")
    best = first(meet(anchors.select("rid", "label", "v"), _positives(arrow, positives)), positives, "anchor")
    best = materialize(best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = best.groupBy(F.col("anchor").alias("rid")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score")))["positive_score"].alias("scores"))
    found = first(meet(anchors.select("rid", "label", "v").join(limits, "rid"), _negatives(arrow, k, low, high)), k, "anchor", "place")
    named = best.join(anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
