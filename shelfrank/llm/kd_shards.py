"""Sharding by a k-d tree over metadata: nodes are halved at weighted medians until leaves reach their bytes.

Every dimension of a row becomes one long: its value scaled to 2^20 steps between the
smallest and the largest of the table, followed by 40 bits of a hash of the row's id and
text. A text's value is its rank among the distinct ones, counted in bytes of the rows before it. The hash orders rows whose values tie, so a source with a third of all rows is cut
like any other, and both halves of a cut have the bytes asked for.

A cut is found by counting bytes in equal ranges of the key and counting again inside the
range that holds the median, for all nodes of a level in one job. The driver sees at most
nodes x ranges sums, never rows.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfrank.llm.common import numbered, pick, ship, stored, utf8

STEPS, TIE_BITS, RANGES = 2**20, 40, 2048
NEVER = 2**63 - 1


@dataclass
class Node:
    """A subtree of ``shards`` leaves; ``cut``: rows whose key of ``dimension`` is above it go to the second child."""

    shards: int
    dimension: int = 0
    cut: int = NEVER


def as_number(kind: T.DataType, column: Column) -> Column:
    """A numeric metadata column as a number, another one as text. NaN and infinite: null."""
    if isinstance(kind, T.NumericType):
        value = column.cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    return column.cast("string")


def text_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of each distinct text of ``column``: the bytes of all rows with a smaller one.

    Distinct values are range-sorted and summed in their parts; only one row a part is summed in one task.
    """
    held = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum("size").alias("bytes"))
    dealt = stored(held.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("part").agg(F.sum("bytes").alias("held"))
    starts = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(starts, "part").select("value", (F.col("start") + F.coalesce(before, F.lit(0))).cast("double").alias("rank"))


def _keyed(rows: DataFrame, dimensions: int) -> DataFrame:
    """Adds ``keys``: one long per dimension. A dimension's nulls come first."""
    ends = rows.agg(*[f(f"d{i}") for i in range(dimensions) for f in (F.min, F.max)]).first()
    tie = F.xxhash64("id", "text_crc32", "size").bitwiseAND(F.lit(2**TIE_BITS - 1))
    keys = []
    for i in range(dimensions):
        low, high = ends[2 * i], ends[2 * i + 1]
        value = F.lit(0.0) if low is None or high <= low else F.coalesce(1 + (STEPS - 1) * ((F.col(f"d{i}") - low) / (high - low)), F.lit(0.0))
        keys.append(F.shiftleft(F.floor(value).cast("bigint"), TIE_BITS).bitwiseOR(tie))
    return rows.withColumn("keys", F.array(*keys)).drop(*[f"d{i}" for i in range(dimensions)])


def _step(node: Column, level: list[Node]) -> Column:
    """The child each row goes to; children are numbered from left to right."""
    first = np.concatenate([[0], np.cumsum([1 + (n.shards > 1) for n in level])]).tolist()
    pick_long = lambda values: F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), node + 1)
    key = F.element_at(F.col("keys"), (pick_long([n.dimension for n in level]) + 1).cast("int"))
    return (pick_long(first[:-1]) + (key > pick_long([n.cut for n in level])).cast("int")).cast("int")


def _set_cuts(rows: DataFrame, level: list[Node], dimensions: int, close: float) -> None:
    """Sets the dimension of each node that is to be split, its widest, and the cut nearest to its share of the bytes."""
    ends = [f(F.col("keys")[i]) for i in range(dimensions) for f in (F.min, F.max)]
    search = {}
    for node, total, *end in rows.groupBy("node").agg(F.sum("size"), *ends).collect():
        if level[node].shards > 1:
            wide = [(end[2 * i + 1] >> TIE_BITS) - (end[2 * i] >> TIE_BITS) for i in range(dimensions)]
            level[node].dimension = at = int(np.argmax(wide))
            left = (level[node].shards + 1) // 2
            search[node] = {"low": end[2 * at], "high": end[2 * at + 1], "below": 0, "goal": total * left / level[node].shards, "slack": close * total}
    while search:
        asked = [search.get(i, {"low": 1, "high": 0}) for i in range(len(level))]
        at_node = lambda values: F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("node") + 1)
        widths = [max(1, -(-(x["high"] - x["low"] + 1) // RANGES)) for x in asked]
        key = F.element_at(F.col("keys"), (at_node([n.dimension for n in level]) + 1).cast("int"))
        inside = rows.select("node", "size", key.alias("key"), at_node([x["low"] for x in asked]).alias("low"), at_node([x["high"] for x in asked]).alias("high"), at_node(widths).alias("width"))
        counted = inside.filter("key >= low AND key <= high").groupBy("node", F.expr("(key - low) div width").alias("range")).agg(F.sum("size").alias("bytes"))
        sums: dict[int, list] = {}
        for node, part, held in counted.collect():
            sums.setdefault(node, []).append((part, held))
        for node, parts in sums.items():
            x, width = search[node], widths[node]
            for part, held in sorted(parts):
                low, high = x["low"] + part * width, min(x["high"], x["low"] + (part + 1) * width - 1)
                if x["below"] + held >= x["goal"]:
                    break
                x["below"] += held
            if width == 1 or held <= x["slack"]:
                over = x["below"] + held - x["goal"] <= x["goal"] - x["below"]
                level[node].cut = high if over else low - 1
                del search[node]
            else:
                x["low"], x["high"] = low, high


def kd_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", by=("lang", "source"), shards: int | None = None, target_bytes: int = 2**30, close: float = 1e-4) -> tuple[DataFrame, list[list[Node]]]:
    """(id, size, text_crc32, shard, slot) of every row, and the tree's levels.

    Dimensions are the logarithm of the text's bytes and the columns ``by``. A node is split
    across its widest dimension, as a share of the table's range, so that its children's bytes
    are in the ratio of the leaves below them; ``shards`` leaves, or as many as ``target_bytes``
    asks for. A cut misses its goal by ``close`` of the node's bytes or one row at most.
    ``slot`` numbers a shard's rows from 0.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has none, and the CRC of no
    bytes, 0. Null metadata come before all values. Rows alike in id and text can't be told
    apart and share a shard. An empty table gives no rows. Texts are ordered by their UTF-8 bytes, over their whole length.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    rows = pick(df, id=id_col, text=text_col, **{f"by{i}": c for i, c in enumerate(by)})
    size = F.octet_length(utf8(F.col("text"))).cast("bigint") + 1
    numbers = [F.log2(size), *[as_number(kinds[c], F.col(f"by{i}")) for i, c in enumerate(by)]]
    rows = stored(rows.select("id", size.alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"), *[n.alias(f"d{i}") for i, n in enumerate(numbers)]))
    # A frequent value is one hot key of a plain join, which Spark can split.
    for name in [f.name for f in rows.schema if f.name != "id" and isinstance(f.dataType, T.StringType)]:
        rows = rows.join(text_ranks(rows, name), F.col(name) == F.col("value"), "left").withColumn(name, F.col("rank")).drop("value", "rank")
    rows = stored(rows)
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    keyed = _keyed(rows, len(numbers)).withColumn("node", F.lit(0))
    level, tree = [Node(shards)], []
    while any(n.shards > 1 for n in level):
        _set_cuts(keyed, level, len(numbers), close)
        tree.append(level)
        # Written, so a level's plan does not hold those above it.
        keyed = stored(keyed.withColumn("node", _step(F.col("node"), level)))
        level = [Node(k) for n in level for k in ([(n.shards + 1) // 2, n.shards // 2] if n.shards > 1 else [1])]
    placed = keyed.select("id", "size", "text_crc32", F.col("node").alias("shard"))
    return numbered(placed, ["shard"], ["id", "text_crc32", "size"], "slot"), tree


ship(__name__)
