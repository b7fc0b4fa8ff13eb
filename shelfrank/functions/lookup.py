"""Small lookup tables as one map value per query, with a check of their size."""

from pyspark.sql import DataFrame, functions as F

# Tables up to this many rows and about this many bytes are sent to every task when a join asks for it.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
# Up to this many entries a lookup travels inside the plan as one map; beyond it the jobs join.
MAX_INLINE_ENTRIES = 2000


def fits_inline(lookup: DataFrame, limit: int = MAX_INLINE_ENTRIES) -> bool:
    """True when the table has at most ``limit`` rows; reads no more than that plus one."""
    return lookup.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, most_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast after measuring up to ``limit`` rows of it; one with more rows or bytes is joined by shuffle.

    Bytes are those of the rows as JSON text. Both ways give the same rows.
    """
    written = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(written), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most_bytes else df


def last_of(lookup: DataFrame, keys, value: str) -> DataFrame:
    """One row per key: the value of the last row by ``seq`` where the table has that column, else the largest."""
    chosen = F.max_by(value, "seq") if "seq" in lookup.columns else F.max(value)
    return lookup.groupBy(*keys).agg(chosen.alias(value))


def as_map(lookup: DataFrame, key, value):
    """One map value holding a whole (checked, small, unique-key) lookup table."""
    return lookup.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def as_array(lookup: DataFrame, *columns):
    """One sorted array of structs holding a whole (checked, small) lookup table."""
    return lookup.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()


def bind(value, expression):
    """``expression(value)`` with ``value`` computed once, also where lambdas use it repeatedly."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))
