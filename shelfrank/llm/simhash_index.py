"""Near-duplicate texts by SimHash fingerprints and an inverted index over their bytes.

A fingerprint has eight bytes. Two fingerprints with at most three differing bits differ
in at most three bytes, so at least five positional bytes are shared: the guaranteed
minimum. Postings of single bytes hold one row in 256 each, and their pairs grow with the
square of the table, so a posting's key is four positional bytes, one row in four billion.
Fourteen sets of four positions suffice: those whose numbers, 0 to 7, cancel under
exclusive or. Each three positions stand in exactly one such set, and the rest of a set is one
as well, so outside the at most three positions that differ a whole set remains, and
nothing is lost. Where two fingerprints meet, their shared positional bytes are tallied, pairs below the
minimum go, and the others are verified by counting differing bits.

Copies share a fingerprint and enter the index once, whatever their number.
"""

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import components, pick, ship, stored, utf8

BITS, POSITIONS, SEED = 64, 8, 42
# Any five of the eight positions hold one of these fourteen sets.
QUADS = [q for q in combinations(range(POSITIONS), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def simhash(raw: bytes, size: int) -> int:
    """Fingerprint of one text as a signed number: bits set in over half of its shingles' hashes; no word, 0."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[-1:] if len(words) < size else ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts[:n].tolist(), last.tolist())], dtype="<u8")
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, POSITIONS)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_udf(size: int):
    @F.pandas_udf("bigint")
    def of(raw: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, size) for x in raw], dtype="int64")

    return of


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fingerprint) of every row of ``df``: a SimHash over ``size``-word shingles of the whole text.

    A-Z are lower-cased, words are runs of other characters than ASCII white space. A text
    with fewer words is one shingle; a null, empty or blank text has fingerprint 0.
    """
    return pick(df, id=id_col, text=text_col).select("id", fingerprint_udf(size)(utf8(F.col("text"))).alias("fingerprint"))


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that differ in 1 to ``most`` bits (at most 3).

    ``distinct`` has one row per ``fingerprint``. A pair is reported by the first posting both are in.
    """
    if not 0 <= most <= 3:
        raise ValueError("four positional bytes of one set are only guaranteed for up to 3 differing bits")
    keys = [
        reduce(lambda key, p: F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fingerprint"), p)), quad, F.lit(t).cast("bigint"))
        for t, quad in enumerate(QUADS)
    ]
    postings = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    left = postings.select(F.col("key").alias("key_a"), F.col("fingerprint").alias("a"))
    right = postings.select(F.col("key").alias("key_b"), F.col("fingerprint").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    tally = reduce(lambda n, p: n + F.when(_byte(differing, p) == 0, 1).otherwise(0), range(POSITIONS), F.lit(0))
    first = F.lit(len(QUADS))
    for t, quad in reversed(list(enumerate(QUADS))):
        mask = sum(255 << (8 * p) for p in quad)
        mask -= (mask >> 63) << 64
        first = F.when(differing.bitwiseAND(F.lit(mask).cast("bigint")) == 0, F.lit(t)).otherwise(first)
    found_here = F.shiftright("key_a", 32) == first
    met = (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b"))
    return left.join(right, met & (tally >= POSITIONS - most) & (F.bit_count(differing) <= most) & found_here).select("a", "b")


def _grouped(df: DataFrame, id_col: str, text_col: str, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, fingerprint) rows, and for each fingerprint its group's ``root`` and ``best``: the row to keep.

    ``best`` is the row with the smallest id, then the smallest hash and length of its text,
    and ``n`` counts its repeats.
    """
    raw = utf8(F.col("text"))
    texts = pick(df, id=id_col, text=text_col)
    rows = stored(texts.select("id", fingerprint_udf(size)(raw).alias("fingerprint"), F.xxhash64(raw).alias("hash"), F.octet_length(raw).alias("bytes")))
    counted = rows.groupBy("fingerprint", "id", "hash", "bytes").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "bytes", "n")).alias("best")
    distinct = stored(counted.groupBy("fingerprint").agg(best))
    roots = components(df.sparkSession, links(distinct.select("fingerprint"), most)).select(F.col("node").alias("fingerprint"), "root")
    rooted = stored(distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    named = rooted.select("fingerprint", "root").join(rooted.groupBy("root").agg(F.min("best").alias("best")), "root")
    return rows, named


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row: the smallest id reachable over links of at most ``most`` bits.

    Null ids are never the smallest; a group of nothing but null ids has a null
    component_id. Repeated rows are repeated in the result. An empty table gives no rows.
    """
    rows, named = _grouped(df, id_col, text_col, size, most)
    return rows.join(named.select("fingerprint", F.col("best.id").alias("component_id")), "fingerprint").select("id", "fingerprint", "component_id")


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``df`` with one left of each group: that with the smallest id.

    Of several rows with that id, the one whose text has the smallest hash stays, once. A
    group of nothing but null ids keeps one row as well.
    """
    _, named = _grouped(df, id_col, text_col, size, most)
    best = stored(named.filter(F.col("fingerprint") == F.col("root")).select("best.*"))
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    raw = utf8(F.col(f"_{names.index(text_col)}"))
    keyed = plain.withColumns({"_hash": F.xxhash64(raw), "_bytes": F.octet_length(raw)})
    same = F.col(f"_{names.index(id_col)}").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")) & (F.col("_bytes") == F.col("bytes"))
    kept = keyed.join(best, same)
    if not best.filter("n > 1").isEmpty():
        kept = kept.filter("n = 1").union(kept.filter("n > 1").dropDuplicates([f"_{names.index(id_col)}", "_hash", "_bytes"]))
    return kept.select(*[F.col(f"_{i}") for i in range(len(names))]).toDF(*names)


ship(__name__)
