"""Exact top-k by inner product with bounds from segment statistics, coarse to fine.

A vector is cut into segments; of each segment its mean and its deviation are kept. For two
vectors the squared distance is at least the sum over segments of
``length * ((mean_a - mean_b)^2 + (dev_a - dev_b)^2)``, and with the squared norms a lower
bound of the distance is an upper bound of the inner product, ``(|a|^2 + |b|^2 - d^2) / 2``.
Coarse segments discard most candidates, finer ones most of the rest, and the exact score is
computed for survivors only. A candidate goes only when its bound is below a score that k
other candidates are known to reach, so the result is exact.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.llm.common import pick, ship, stored

LEVELS = (1, 4, 16)
FOUND = "query_id bigint, id bigint, score bigint"
LONGS = 2**63


def valid_vector(vector: Column) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def scaled(vector: Column, factor: float) -> Column:
    """Components times ``factor``, rounded down, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint"))


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros; exact integers."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per row its segments' means and deviations, each times the root of the segment's length, side by side."""
    n = rows.shape[1]
    cuts = np.unique(np.arange(min(segments, n)) * n // max(1, min(segments, n)))
    lengths = np.diff([*cuts, n])
    mean = np.add.reduceat(rows, cuts, axis=1) / lengths
    spread = rows - np.repeat(mean, lengths, axis=1)
    deviation = np.sqrt(np.add.reduceat(spread * spread, cuts, axis=1) / lengths)
    root = np.sqrt(lengths)
    return np.concatenate([mean * root, deviation * root], axis=1)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Integer inner products; in doubles where every partial sum is exact in them, else in Python's integers within the range of a long."""
    if not rows.size:
        return [0] * len(rows)
    largest = float(np.abs(query.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max()) * rows.shape[1]
    if largest < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64).tolist()
    return [max(-LONGS, min(LONGS - 1, sum(a * b for a, b in zip(query.tolist(), row)))) for row in rows.tolist()]


def search_block(query_ids, queries, ids, vectors, k: int, levels=LEVELS):
    """The ``k`` best candidates of a block for each query, as (query_id, id, score); a query's own id is no candidate."""
    width = max([len(v) for v in queries] + [len(v) for v in vectors] + [1])
    q_int, c_int, ids = matrix(queries, width), matrix(vectors, width), np.asarray(ids, np.int64)
    order = np.argsort(ids, kind="stable")
    c_int, ids = c_int[order], ids[order]
    q, c = q_int.astype(np.float64), c_int.astype(np.float64)
    q_square, c_square = (q * q).sum(1), (c * c).sum(1)
    bounds = [(statistics(q, s), statistics(c, s)) for s in levels]

    def upper(level, rows, columns):
        a, b = bounds[level][0][rows], bounds[level][1][columns]
        near = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)
        # The room covers rounding in the statistics.
        both = q_square[rows][:, None] + c_square[columns][None, :]
        return (both - near) / 2 + 1e-9 * both + 1e-6

    for at in range(0, len(q), 256):
        rows = np.arange(at, min(at + 256, len(q)))
        alive = np.asarray(query_ids, np.int64)[rows][:, None] != ids[None, :]
        least = np.full(len(rows), -np.inf)
        for level in range(len(levels)):
            columns = np.nonzero(alive.any(0))[0]
            if len(columns) <= k:
                break
            bound = np.where(alive[:, columns], upper(level, rows, columns), -np.inf)
            # Scores of the k most promising candidates: at least that is reached.
            seed = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            for i, row in enumerate(rows):
                known = seed[i][np.isfinite(bound[i, seed[i]])]
                if len(known) == k:
                    least[i] = max(least[i], min(exact_scores(q_int[row], c_int[columns[known]])))
            alive[:, columns] &= bound >= least[:, None]
        for i, row in enumerate(rows):
            left = np.nonzero(alive[i])[0]
            scores = exact_scores(q_int[row], c_int[left])
            # Candidates are in the order of their ids, so equal scores keep it.
            for j in sorted(range(len(left)), key=lambda j: -scores[j])[:k]:
                yield int(query_ids[row]), int(ids[left[j]]), scores[j]


def exact_topk(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0, block_rows: int = 4096, block_bytes: int = 2**25) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``queries`` holds on ``id``, the ``k`` rows of the highest inner product.

    Ties go to the smaller id. Components are floor(factor * x). Rows whose id or vector is
    null, or whose vector holds a null or a non-finite number, take no part; rows alike in id
    and vector count once, and rows with the query's id are not its candidates. Of two vectors
    the shorter is filled up with zeros. A query without candidates has no row.

    Candidates and queries are dealt into blocks of at most about ``block_rows`` rows or
    ``block_bytes`` bytes, and every pair of blocks is one group: no side is broadcast, and no
    task holds more than two blocks. The work is queries x rows, as the exact search of a stated
    query set against all rows asks for.
    """
    rows = pick(vectors, id=id_col, vector=vector_col).filter(F.col("id").isNotNull() & valid_vector(F.col("vector")))
    rows = stored(rows.select(F.col("id").cast("bigint").alias("id"), scaled(F.col("vector"), factor).alias("vector")).distinct())
    asked = rows.filter(queries)
    n, n_asked, width = rows.agg(F.count(F.lit(1)), F.count_if(queries), F.max(F.size("vector"))).first()
    room = max(k + 1, min(block_rows, block_bytes // (8 * max(1, width or 1))))
    blocks, query_blocks = max(1, -(-n // room)), max(1, -(-n_asked // room))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("id", "vector"), F.lit(count)).cast("int")
    left = asked.select("id", "vector", block(query_blocks).alias("query_block"), numbers(blocks).alias("block"))
    right = rows.select("id", "vector", block(blocks).alias("block"), numbers(query_blocks).alias("query_block"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = search_block(a["id"].tolist(), a["vector"].tolist(), b["id"].tolist(), b["vector"].tolist(), k) if len(a) and len(b) else ()
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype("int64")

    key = ("query_block", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


ship(__name__)
