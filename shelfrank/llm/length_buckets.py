"""Packing: length buckets with the least padding, and batches of a token budget inside each bucket.

Texts longer than the window are cut into consecutive pieces of one window, so lengths lie
between 1 and the window and their histogram over all pieces has at most ``window``
entries. Boundaries come from dynamic programming over that histogram: exact, whatever the
number of rows, as a bucket's padding depends on counts and sums of lengths alone.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import numbered, pick, ship, stored

WINDOW, BUCKETS, BUDGET = 4096, 12, 65536
WORDS = r"[^\x20\x09-\x0D]+"


def best_boundaries(lengths, numbers, buckets: int) -> list[int]:
    """Upper lengths, ascending, of at most ``buckets`` buckets with the least total padding.

    ``numbers[i]`` rows have length ``lengths[i]``. Every length fits the smallest boundary
    not below it. Of equally good choices the one with fewer buckets is taken, then that with
    the smaller last cut.
    """
    order = np.argsort(lengths)
    length, number = np.asarray(lengths, np.int64)[order], np.asarray(numbers, np.int64)[order]
    n = len(length)
    if not n:
        return []
    # Python's integers would be exact at any size; 64 bits hold rows x window up to 9e18.
    rows = np.concatenate([[0], np.cumsum(number)])
    tokens = np.concatenate([[0], np.cumsum(number * length)])
    padding = lambda i, j: length[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])  # noqa: E731  lengths i to j - 1 in one bucket
    ends = np.arange(1, n + 1)
    cost = np.concatenate([[0], padding(0, ends)])
    cuts = [np.zeros(n + 1, np.int64)]
    best = [int(cost[n])]
    for _ in range(1, min(buckets, n)):
        cost, cut = _layer(cost, padding, n)
        cuts.append(cut)
        best.append(int(cost[n]))
    k, j, found = int(np.argmin(best)), n, []
    while j:
        found.append(int(length[j - 1]))
        j, k = int(cuts[k][j]), k - 1
    return found[::-1]


def _layer(cost, padding, n):
    """Least cost of the first j lengths with one bucket more, and where its last bucket starts.

    The best start never moves left as j grows, so each half of the ends searches its side only.
    """
    new, cut = cost.copy(), np.zeros(n + 1, np.int64)
    work = [(1, n, 0, n - 1)]
    while work:
        low, high, first, last = work.pop()
        if low > high:
            continue
        j = (low + high) // 2
        starts = np.arange(first, min(last, j - 1) + 1)
        total = cost[starts] + padding(starts, j)
        at = int(np.argmin(total))
        new[j], cut[j] = total[at], starts[at]
        work += [(low, j - 1, first, int(starts[at])), (j + 1, high, int(starts[at]), last)]
    return new, cut


def pieces(df: DataFrame, id_col: str, length: Column, window: int) -> DataFrame:
    """(id, piece, start, tokens): each row cut into consecutive pieces of ``window`` tokens; empty rows give none."""
    measured = df.select(F.col(id_col).alias("id"), length.cast("bigint").alias("n"))
    cut = measured.filter("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {window}"))).alias("piece"))
    return cut.select("id", "piece", (F.col("piece") * window).alias("start"), F.least(F.lit(window).cast("bigint"), F.col("n") - F.col("piece") * window).alias("tokens"))


def length_buckets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, window: int = WINDOW, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per piece: (id, piece, start, tokens, bucket, bucket_tokens, batch, position, padding).

    ``length`` counts a row's tokens from its columns; without it, words of ``text`` are
    counted. Each piece is padded to ``bucket_tokens``, its bucket's boundary. Batches are
    numbered from 0 inside a bucket and hold ``budget // bucket_tokens`` pieces (at least
    one), so none holds more padded tokens than ``budget`` unless one piece does; only a
    bucket's last batch may be short. Null and empty texts have no tokens and no piece.
    Repeated rows are packed each; an empty table gives no rows.
    """
    if min(window, buckets, budget) < 1:
        raise ValueError("window, buckets and budget are at least 1")
    if length is None:
        df, id_col, length = pick(df, id=id_col, text=text_col), "id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS))
    cut = stored(pieces(df, id_col, length, window))
    # At most one row per length up to the window.
    histogram = cut.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    bounds = best_boundaries([r.tokens for r in histogram], [r.n for r in histogram], buckets)
    bucket = F.lit(0)
    for at, bound in enumerate(bounds[:-1]):
        bucket = bucket + (F.col("tokens") > bound).cast("int")
    padded = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds or [1]]), F.col("bucket") + 1)
    placed = numbered(cut.withColumn("bucket", bucket), ["bucket"], ["id", "piece", "tokens"], "slot").withColumn("bucket_tokens", padded)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return placed.select(
        "id", "piece", "start", "tokens", "bucket", "bucket_tokens",
        F.floor(F.col("slot") / room).alias("batch"), F.pmod("slot", room).alias("position"), (F.col("bucket_tokens") - F.col("tokens")).alias("padding"),
    )


ship(__name__)
