"""Hard negatives by a vertical scan of columns with branch-and-bound on partial sums (BOND).

Candidates lie in blocks, column by column. An anchor reads the columns in the order of its own
components' magnitudes, largest first, and keeps a sum for each candidate still in its bitmap. What
the columns not yet read can add is bounded by their smallest and largest values in the block, so a candidate's
score lies between two numbers that close in with each column. Candidates that can't be among the best, or
whose score can't fall into a window that needs them, leave the bitmap; the scan ends with exact scores.

The first scan finds an anchor's positives, its best rows of the same label. Their scores set windows, and the
second scan finds the best rows of other labels inside each window.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.llm.common import pick, ship, stored
from shelfrank.llm.segment_search import LONGS, matrix, scaled, valid_vector

# Columns read before the bitmap is looked at again: few first, as the largest components come first.
STEPS = (4, 4, 8, 16, 32)
FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


class Block:
    """Candidates by columns, with each column's smallest and largest value."""

    def __init__(self, ids, labels, vectors, width: int):
        order = np.argsort(np.asarray(ids, np.int64), kind="stable")
        self.ids, self.labels = np.asarray(ids, np.int64)[order], np.asarray(labels, np.int64)[order]
        rows = matrix(vectors, width)[order]
        self.largest = float(np.abs(rows.astype(np.float64)).max()) if rows.size else 0.0
        self.columns = np.ascontiguousarray(rows.T)
        self.low, self.high = (self.columns.min(1), self.columns.max(1)) if rows.size else (np.zeros(width, np.int64),) * 2
        self.fast = {}

    def exact(self, anchor: np.ndarray):
        """Columns, bounds and anchor in a type whose sums of products are exact: doubles where they suffice, else Python's integers."""
        largest = float(np.abs(anchor.astype(np.float64)).max()) if anchor.size else 0.0
        kind = np.float64 if 100 * largest * self.largest * max(1, len(anchor)) < 2**53 else object
        if kind not in self.fast:
            self.fast[kind] = self.columns.astype(kind), self.low.astype(kind), self.high.astype(kind)
        return *self.fast[kind], anchor.astype(kind)


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, shrink):
    """Exact scores of the candidates of a block that stay in an anchor's bitmap: (places, scores).

    ``shrink`` gets the places still alive and the lower and upper bounds of their scores, and returns which stay.
    """
    columns, low, high, a = block.exact(anchor)
    order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
    ends = np.stack([a * low, a * high])[:, order]
    # What the columns from each place in the order on can add, at least and at most.
    least, most = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(0), ends.max(0)))
    places = np.nonzero(alive)[0]
    sums, at, step = np.zeros(len(places), columns.dtype), 0, 0
    while at < len(order) and len(places):
        read = order[at : at + STEPS[min(step, len(STEPS) - 1)]]
        part = columns[read] if len(places) == columns.shape[1] else columns[np.ix_(read, places)]
        sums = sums + a[read] @ part
        at, step = at + len(read), step + 1
        if at < len(order):
            stay = shrink(places, sums + least[at], sums + most[at])
            if not stay.all():
                places, sums = places[stay], sums[stay]
    return places, sums


def reached(lower: np.ndarray, k: int):
    """The k-th largest of the lower bounds: at least that is reached by k candidates; None if there are fewer."""
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else None


def best(block: Block, places: np.ndarray, scores: np.ndarray, k: int):
    """The ``k`` highest scores, ties to the smaller id, as (id, score); places are in the order of ids."""
    order = np.argsort(-scores, kind="stable")[:k]
    for i in order:
        yield int(block.ids[places[i]]), max(-LONGS, min(LONGS - 1, int(scores[i])))


def positives(block: Block, anchor_id: int, label: int, anchor: np.ndarray, k: int):
    """The ``k`` best candidates of the anchor's label."""

    def shrink(places, lower, upper):
        least = reached(lower, k)
        return np.ones(len(places), bool) if least is None else upper >= least

    yield from best(block, *scan(block, anchor, (block.labels == label) & (block.ids != anchor_id), shrink), k)


def negatives(block: Block, label: int, anchor: np.ndarray, scores: list[int], k: int, low: int, high: int):
    """(number of the window, id, score): of the candidates of other labels the ``k`` best in each score's window."""
    windows = [(low * s, high * s) for s in scores]

    def shrink(places, lower, upper):
        stay, lower, upper = np.zeros(len(places), bool), lower * 100, upper * 100
        for least, most in windows:
            mine = (upper >= least) & (lower <= most)
            known = reached(lower[(lower >= least) & (upper <= most)], k)
            stay |= mine if known is None else mine & (upper >= known)
        return stay

    places, found = scan(block, anchor, (block.labels != label) & (len(windows) > 0), shrink)
    for n, (least, most) in enumerate(windows):
        inside = (found * 100 >= least) & (found * 100 <= most)
        for i, score in best(block, places[inside], found[inside], k):
            yield n, i, score


def hard_negatives(
    df: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id",
    label_col: str = "label", vector_col: str = "embedding", factor: float = 256.0, block_rows: int = 4096, block_bytes: int = 2**25,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds on ``id``.

    Components are floor(factor * x), scores inner products, ties go to the smaller id. Positives are the
    ``n_positives`` best other rows of the anchor's label. Negatives of a positive are the ``n_negatives`` best
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    Rows with a null id or label, or a vector that is null or holds a null or a non-finite number, take no part. Of
    several rows with one id, that with the smallest label, then the smallest vector, counts, and it counts once. Of two
    vectors the shorter is filled up with zeros. Anchors without positives or negatives, and empty tables, give no rows.

    Anchors and candidates are dealt into blocks of at most about ``block_rows`` rows or ``block_bytes`` bytes; every
    pair of blocks is one group, no side is broadcast, and each group passes on its best rows only. The work is anchors x
    rows, as a stated query set against all rows asks for.
    """
    rows = pick(df, id=id_col, label=label_col, vector=vector_col).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & valid_vector(F.col("vector")))
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.struct(F.col("label").cast("bigint").alias("label"), scaled(F.col("vector"), factor).alias("vector")).alias("row"))
    rows = stored(rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*"))
    asked = rows.filter(anchors)
    n, n_asked, width = rows.agg(F.count(F.lit(1)), F.count_if(anchors), F.max(F.size("vector"))).first()
    width = width or 0
    room = max(1, min(block_rows, block_bytes // (8 * max(1, width))))
    blocks, anchor_blocks = max(1, -(-n // room)), max(1, -(-n_asked // room))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    # Names of their own, as both sides come from one table.
    right = rows.select(F.col("id").alias("its_id"), F.col("label").alias("its_label"), F.col("vector").alias("its_vector"), block(blocks).alias("block"), numbers(anchor_blocks).alias("anchor_block"))
    key = ("anchor_block", "block")

    def searched(left: DataFrame, search, schema: str) -> DataFrame:
        dealt = left.select("*", block(anchor_blocks).alias("anchor_block"), numbers(blocks).alias("block"))
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = ()
            if len(a) and len(b):
                found = search(a, matrix(a["vector"], width), Block(b["its_id"].tolist(), b["its_label"].tolist(), b["its_vector"].tolist(), width))
            return pd.DataFrame(found, columns=columns).astype("int64")

        return dealt.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)

    def first(a, vectors, candidates):
        for anchor_id, label, vector in zip(a["id"].tolist(), a["label"].tolist(), vectors):
            for i, score in positives(candidates, anchor_id, label, vector, n_positives):
                yield anchor_id, i, score

    def second(a, vectors, candidates):
        for anchor_id, label, found, vector in zip(a["id"].tolist(), a["label"].tolist(), a["positives"], vectors):
            ids, scores = [int(p["id"]) for p in found], [int(p["score"]) for p in found]
            for n, i, score in negatives(candidates, label, vector, scores, n_negatives, low, high):
                yield anchor_id, ids[n], scores[n], i, score

    near = searched(asked, first, "anchor_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    # As many positives an anchor as asked for.
    near = near.withColumn("rank", rank).filter(F.col("rank") <= n_positives).groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    known = stored(asked.join(near, asked["id"] == near["anchor_id"]).select("id", "label", "vector", "positives"))
    far = searched(known, second, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    far = far.withColumn("rank", rank).filter(F.col("rank") <= n_negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ship(__name__)
