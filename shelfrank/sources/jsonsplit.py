"""Large single JSON files as many tasks: the elements of one array or the entries of one object.

A file is read in byte ranges, cut at a closing bracket. What a bracket or quote means depends on what
stands before, so every range is first summed up for both cases, begun inside a string or outside: how
deep it leads, and whether it ends inside a string. These sums, one row a range, are put together in order, and
with its true beginning each range is cut into elements. An element that crosses ranges is put together from its parts.
"""

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfrank.sources.readers import QUERY_SCHEMA

_TO_QUOTE = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_PLACE = ("file", "start")
_SUMS = "file string, start bigint, inside_0 boolean, depth_0 bigint, inside_1 boolean, depth_1 bigint"
_PARTS = "file string, start bigint, number bigint, opens boolean, closes boolean, part string"


def step(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind ``piece``, and how much deeper it leads; ``inside``: it begins in a string."""
    if inside:
        end = _TO_QUOTE.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end() :]
    plain = _STRING.sub("", piece)
    quote = plain.find('"')
    if quote >= 0:
        plain = plain[:quote]
    return quote >= 0, sum(map(plain.count, "{[")) - sum(map(plain.count, "}]"))


def _summed(batches):
    """For each byte range, in both cases, where it leads."""
    key, state = None, None
    out = []
    for batch in batches:
        for file, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
            if key != (file, start):
                if key:
                    out.append((*key, *state[0], *state[1]))
                key, state = (file, start), [(False, 0), (True, 0)]
            for case in (0, 1):
                inside, depth = step(value, state[case][0])
                state[case] = inside, state[case][1] + depth - (not inside)
    if key:
        out.append((*key, *state[0], *state[1]))
    if out:
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "start", "inside_0", "depth_0", "inside_1", "depth_1"])


def _begun(rows: pd.DataFrame) -> pd.DataFrame:
    """The state each range of a file begins in."""
    inside, depth, out = False, 0, []
    for r in rows.sort_values("start").itertuples():
        out.append((r.file, r.start, inside, depth))
        inside, depth = (r.inside_1, depth + r.depth_1) if inside else (r.inside_0, depth + r.depth_0)
    return pd.DataFrame(out, columns=["file", "start", "inside", "depth"])


def _cut(closer: str):
    """Cuts ranges into elements: whole ones, and the open parts at a range's ends."""

    def run(batches):
        key = None
        names = [c.split()[0] for c in _PARTS.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())

        def part(closes):
            nonlocal number
            row = (*key, number, opens, closes, "".join(held))
            number += 1
            held.clear()
            return row

        for batch in batches:
            out, size = [], 0
            for file, start, value, inside0, depth0 in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value", "inside", "depth"))):
                if key != (file, start):
                    if key and held:
                        out.append(part(False))
                    key, held, number = (file, start), [], 0
                    inside, depth, opens = inside0, depth0, not inside0 and depth0 <= 1
                if depth == 0 and not inside:
                    # The file's own bracket belongs to no element.
                    before, bracket, behind = value.partition("[" if closer == "}" else "{")
                    held += [behind if bracket else value, closer]
                else:
                    held += [value, closer]
                inside, deeper = step(value, inside)
                depth += deeper - (not inside)
                if not inside and depth == 1:
                    out.append(part(True))
                    size += len(out[-1][-1])
                    opens = True
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if key and held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(part(False), kinds)], names)

    return run


def json_elements(spark: SparkSession, path, closer: str = "}") -> DataFrame:
    """(file, text) of every top-level element that ends with ``closer`` of files that hold one JSON array or object each.

    For an array of objects the closer is ``}``, for an object of arrays ``]``; the text begins behind the separator.
    Ranges are as large as the session's file partitions. The text is read twice and not shuffled, but for the parts of elements
    that cross ranges.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    pieces = spark.read.option("lineSep", closer).text(path).select(*place, "value")
    starts = pieces.mapInArrow(_summed, _SUMS).groupBy("file").applyInPandas(_begun, "file string, start bigint, inside boolean, depth bigint")
    # One row a range: the scheduler holds as many. The pieces keep their order beside it.
    parts = pieces.join(F.broadcast(starts), list(_PLACE)).mapInArrow(_cut(closer), _PARTS)
    whole = parts.filter("opens AND closes").select("file", F.col("part").alias("text"))
    # At most two open parts a range.
    open_parts = parts.filter("NOT (opens AND closes)")
    return whole.unionByName(_joined(open_parts)).select("file", F.regexp_replace("text", r"^[\s,]+", "").alias("text"))


def _joined(parts: DataFrame) -> DataFrame:
    """Elements put together from the parts at the ends of ranges: one begins where a part opens."""
    order = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("element", F.sum(F.col("opens").cast("int")).over(order))
    made = numbered.groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("start", "number", "part", "closes"))).alias("parts"))
    return made.filter(F.exists("parts", lambda p: p["closes"])).select("file", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def scan_large_json_array(spark: SparkSession, path, schema: str = QUERY_SCHEMA) -> DataFrame:
    """Objects of files that each hold one JSON array, as ``scan_json_array`` reads them, one file in many tasks."""
    return json_elements(spark, path, "}").select(F.from_json("text", schema).alias("row")).select("row.*")


def scan_large_result_map(spark: SparkSession, path) -> DataFrame:
    """Files that hold one JSON object {query id: [ids]} each, as ``scan_result_map`` reads them, one file in many tasks."""
    entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string, array<string>>")
    return json_elements(spark, path, "]").select(F.explode(entry).alias("query_id", "product_ids"))
