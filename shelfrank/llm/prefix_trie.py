"""Trie of conversation prefixes, rolled up by centroid decomposition of its parent edges.

Turns are put in order and numbered by a range partitioning, so a conversation with most of the
turns is spread over tasks. A prefix is known by the exclusive or of its turns' hashes, each salted with
its depth, which adds up in pieces; equal prefixes are nodes, and every node checks that its members'
last turns are the same text, so by induction over depths equal keys are equal sequences. A node's name
is (smallest member, depth).

The rollup of values over subtrees does not follow the trie level by level: a trie may be as
deep as its longest conversation. Every component of the parent-edge forest is split at its centroid, the deepest
node with more than half of the component below it. The total of what hangs at the centroid is added to each
node on the path from the centroid to the component's top, and the parts go on separately. No part has more
than half of its component, so the rounds grow with the logarithm of the nodes, whatever the depth. Components
within ``local`` nodes are finished inside tasks, many in each.
"""

import hashlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.llm.common import pick, ship, stored

# Turns of one conversation whose prefixes are built together.
PIECE = 4096
# Ids joined into one string before hashing.
ENDS = 4096
# Nodes of a component that one task finishes, and components still split by joins, at most.
LOCAL, SPLIT = 4096, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, a, b, words) of every turn: its place from 1, 120 bits of SHA-256 of role and text, and the words of its text.

    Turns are ordered by ``turn``, null first, then by role and text; equal turns keep their number. Null
    roles and texts count as empty. Rows without a conversation take no part.
    """
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).filter(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    # Equal rows are alike in all that follows, but many of them must not meet in one task.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    by = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("row").asc()]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    at = F.monotonically_increasing_id()
    turns = stored(dealt.select("conv_id", half(1).alias("a"), half(16).alias("b"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"), at.alias("at")))
    # The numbers rise along each task, and the tasks follow each other in the order of the turns.
    turns = turns.withColumn("task", F.shiftright("at", 33))
    parts = turns.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("start"))
    return turns.join(starts, ["conv_id", "task"]).select("conv_id", (F.col("at") + F.col("start")).alias("position"), "a", "b", "words")


def with_shared_starts(turns: DataFrame, other: Column, most: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``most`` turns are those of conversation ``other``: (conv_id, depth, a, b, words), and (conv_id, n) of all.

    ``other`` and ``most`` are columns on ``conv_id``; ``most`` is small. Of a shorter conversation all turns are
    taken, of an absent one none; the own turns after the first ``most`` follow.
    """
    turns = stored(turns)
    own = turns.groupBy("conv_id").agg(F.max("position").alias("own"))
    plan = own.select("conv_id", "own", other.alias("other"), most.cast("bigint").alias("most"))
    plan = stored(plan.join(own.select(F.col("conv_id").alias("other"), F.col("own").alias("theirs")), "other", "left"))
    plan = plan.select("conv_id", "other", "own", "most", F.least("most", F.coalesce("theirs", F.lit(0))).alias("taken"))
    # One row for each place taken over: as few as ``most`` says.
    places = plan.filter("taken > 0").select("conv_id", "other", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("taken"))).alias("position"))
    heads = turns.select(F.col("conv_id").alias("other"), "position", "a", "b", "words")
    taken = places.join(heads, ["other", "position"]).select("conv_id", F.col("position").alias("depth"), "a", "b", "words")
    kept = turns.join(plan.select("conv_id", "most", "taken"), "conv_id").filter("position > most")
    kept = kept.select("conv_id", (F.col("position") - F.col("most") + F.col("taken")).alias("depth"), "a", "b", "words")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("most"), F.lit(0))).alias("n"))
    return taken.union(kept), lengths


def _keys(turns: DataFrame) -> DataFrame:
    """Each turn with ``ka``, ``kb``, the key of the prefix it ends, and ``pa``, ``pb``, that of the prefix before."""
    salted = turns.select("conv_id", "depth", "a", "b", "words", F.xxhash64("a", "b", "depth").alias("ha"), F.xxhash64("depth", "b", "a", F.lit(1)).alias("hb"), F.floor(F.col("depth") / PIECE).alias("piece"))
    salted = stored(salted)
    totals = salted.groupBy("conv_id", "piece").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "piece", *(F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(s) for t, s in (("ta", "sa"), ("tb", "sb"))))
    along = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = salted.withColumns({"ra": F.bit_xor("ha").over(along), "rb": F.bit_xor("hb").over(along)}).join(starts, ["conv_id", "piece"])
    ka, kb = F.col("ra").bitwiseXOR(F.col("sa")), F.col("rb").bitwiseXOR(F.col("sb"))
    return run.select("conv_id", "depth", "a", "b", "words", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("ha")).alias("pa"), kb.bitwiseXOR(F.col("hb")).alias("pb"))


def paths_and_nodes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``paths`` (conv_id, depth, node, parent): each conversation's node at each depth, and ``nodes``, one row each.

    ``nodes`` has (node, depth, parent, n_convs, words) and the number of nodes in its subtree, ``size``. A node
    is the smallest conversation that passes through it, at its depth. Depth 0 is the root; it is no row of ``paths``.
    """
    keyed = stored(_keys(turns))
    same = (F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))
    node = F.when(same, F.min("conv_id")).otherwise(F.raise_error(F.lit("two prefixes share a key")).cast("bigint"))
    made = stored(keyed.groupBy("depth", "ka", "kb").agg(node.alias("node"), F.count(F.lit(1)).alias("n_convs"), *(F.first(c).alias(c) for c in ("pa", "pb", "words"))))
    least, all_convs = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    up = made.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("node").alias("parent"))
    named = made.join(up, ["depth", "pa", "pb"], "left").withColumn("parent", F.coalesce("parent", F.lit(least)))
    named = stored(named.select("node", "depth", "parent", "n_convs", "words", "ka", "kb"))
    paths = stored(keyed.select("conv_id", "depth", "ka", "kb").join(named.select("depth", "ka", "kb", "node", "parent"), ["depth", "ka", "kb"]).select("conv_id", "depth", "node", "parent"))
    # A conversation that is the smallest at some depth is so below: its own nodes are the end of its path.
    own = paths.filter("conv_id = node").groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    others = paths.filter("conv_id <> node").join(own, "conv_id").groupBy("node", "depth").agg(F.sum("own").alias("others"))
    mine = named.select("node", "depth", "parent", "n_convs", "words").join(lengths.select(F.col("conv_id").alias("node"), "n"), "node").join(others, ["node", "depth"], "left")
    inner = mine.select("node", "depth", "parent", "n_convs", "words", (F.col("n") - F.col("depth") + 1 + F.coalesce("others", F.lit(0))).alias("size"))
    whole = named.count() + 1
    root = lengths.sparkSession.range(0 if least is None else 1).select(
        F.lit(least).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent"),
        F.lit(all_convs).alias("n_convs"), F.lit(0).cast("bigint").alias("words"), F.lit(whole).alias("size"),
    )
    return paths, stored(inner.union(root))


def finish_forest(parents: list[int], values: list[tuple], width: int) -> list[list[int]]:
    """Subtree totals of every node by centroid decomposition, in memory; ``parents`` are places, -1 at a component's top."""
    children = [[] for _ in parents]
    for v, p in enumerate(parents):
        if p >= 0:
            children[p].append(v)
    out, gone = [[0] * width for _ in parents], [False] * len(parents)
    todo = [v for v, p in enumerate(parents) if p < 0]
    while todo:
        top = todo.pop()
        order = [top]
        for v in order:
            order += [c for c in children[v] if not gone[c]]
        size, total = dict.fromkeys(order, 1), {v: list(values[v]) for v in order}
        for v in reversed(order[1:]):
            p = parents[v]
            size[p] += size[v]
            total[p] = [x + y for x, y in zip(total[p], total[v])]
        # Of the nodes with more than half below them, all on one path, the deepest is met last.
        centroid = next(v for v in reversed(order) if 2 * size[v] > len(order))
        hanging, v = total[centroid], centroid
        while True:
            out[v] = [x + y for x, y in zip(out[v], hanging)]
            if v == top:
                break
            v = parents[v]
        todo += [c for c in children[centroid] if not gone[c]]
        gone[centroid] = True
        if centroid != top:
            todo.append(top)
    return out


def _finish(values: list[str]):
    """Finishes all components of a group of rows."""
    columns = ["node", "depth", *(f"sum_{v}" for v in values)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node, depth = rows["node"].tolist(), rows["depth"].tolist()
        place = {k: i for i, k in enumerate(zip(node, depth))}
        is_top = ((rows["node"] == rows["top"]) & (rows["depth"] == rows["top_depth"])).tolist()
        parents = [-1 if t else place[p, d - 1] for t, p, d in zip(is_top, rows["parent"].tolist(), depth)]
        sums = finish_forest(parents, list(zip(*(rows[v].tolist() for v in values))), len(values))
        before = zip(*(rows[f"sum_{v}"].tolist() for v in values))
        made = [(n, d, *(x + y for x, y in zip(a, b))) for n, d, a, b in zip(node, depth, before, sums)]
        return pd.DataFrame(made, columns=columns).astype("int64")

    return run


def rolled_up(paths: DataFrame, nodes: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """(node, depth, sum_v for each of ``values``): every node's totals over its subtree, itself included.

    ``nodes`` has one row a node with (node, depth, parent, size) and the ``values``, ``paths`` the nodes of each
    conversation, both as from ``paths_and_nodes``. A round splits all components of more than ``local`` nodes.
    These are ``SPLIT`` at most, as ``local`` rises with the number of nodes, and only their centroids are broadcast.
    """
    sums = [f"sum_{v}" for v in values]
    root, count = nodes.filter("depth = 0").first(), nodes.count()
    local = max(local, -(-count // SPLIT))
    zero = F.lit(0).cast("bigint")
    state = nodes.select(
        "node", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "size", *values, *(zero.alias(s) for s in sums),
        F.lit(root.node if root else None).cast("bigint").alias("top"), zero.alias("top_depth"), F.lit(count).cast("bigint").alias("whole"),
    )
    kept = state.columns
    done, small = [], []
    while True:
        small.append(state.filter(F.col("whole") <= local))
        large = state.filter(F.col("whole") > local)
        # Of the nodes with more than half of their component below them, all on one path, the deepest.
        heavy = large.filter(2 * F.col("size") > F.col("whole")).groupBy("top", "top_depth", "whole").agg(F.max(F.struct("depth", "node", "size")).alias("c"))
        centroids = stored(heavy.select("top", "top_depth", F.col("c.node").alias("centroid"), F.col("c.depth").alias("at"), F.col("c.size").alias("hanging")))
        if centroids.isEmpty():
            break
        few = F.broadcast(centroids)
        # Conversations through a centroid, with the node they go on to: the top of the part their own nodes fall into.
        through = paths.join(few, (paths["parent"] == F.col("centroid")) & (paths["depth"] == F.col("at") + 1)).select(F.col("conv_id").alias("owner"), F.col("top").alias("t"), F.col("top_depth").alias("td"), F.col("node").alias("branch"))
        placed = large.join(through, (large["node"] == F.col("owner")) & (large["top"] == F.col("t")) & (large["top_depth"] == F.col("td")), "left").select(*large.columns, "branch").join(few, ["top", "top_depth"])
        below = (F.col("depth") > F.col("at")) & F.col("branch").isNotNull()
        placed = stored(placed.withColumns({"below": below, "here": (F.col("node") == F.col("centroid")) & (F.col("depth") == F.col("at"))}))
        # What hangs at a centroid, added to each node from there to the top: the nodes of the centroid's own conversation.
        hung = placed.filter("below OR here").groupBy("centroid", "at", "top", "top_depth", "hanging").agg(*(F.sum(v).alias(f"add_{v}") for v in values))
        hung = stored(hung.select("centroid", "at", "top", "top_depth", F.col("hanging").alias("less"), *(f"add_{v}" for v in values)))
        adds = ["less", *(f"add_{v}" for v in values)]
        along = paths.join(F.broadcast(hung), (paths["conv_id"] == F.col("centroid")) & paths["depth"].between(F.col("top_depth"), F.col("at"))).select(F.col("node").alias("on"), F.col("depth").alias("on_depth"), *adds)
        along = along.union(hung.filter("top_depth = 0").select(F.col("top").alias("on"), zero.alias("on_depth"), *adds))
        sizes = placed.filter("below AND node = branch AND depth = at + 1").select(F.col("branch").alias("part"), F.col("depth").alias("part_depth"), F.col("size").alias("part_size"))
        added = placed.join(along, (placed["node"] == F.col("on")) & (placed["depth"] == F.col("on_depth")), "left").join(sizes, F.col("below") & (F.col("branch") == F.col("part")) & (F.col("at") + 1 == F.col("part_depth")), "left")
        added = added.select(
            "node", "depth", "parent", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), *values,
            *((F.col(s) + F.coalesce(f"add_{v}", F.lit(0))).alias(s) for v, s in zip(values, sums)),
            F.when(F.col("below"), F.col("branch")).otherwise(F.col("top")).alias("top"), F.when(F.col("below"), F.col("at") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            F.when(F.col("below"), F.col("part_size")).otherwise(F.col("whole") - F.col("hanging")).alias("whole"), "here",
        )
        added = stored(added)
        done.append(added.filter("here").select("node", "depth", *sums))
        state = added.filter("NOT here").select(*kept)
    # A group holds whole components, each of ``local`` nodes at most, some ``local`` x 8 nodes together.
    groups = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // (8 * local)))
    rest = reduce(DataFrame.union, small).withColumn("group", F.pmod(F.xxhash64("top", "top_depth"), F.lit(groups)))
    schema = ", ".join(f"{c} bigint" for c in ("node", "depth", *sums))
    return reduce(DataFrame.union, done, rest.groupBy("group").applyInPandas(_finish(values), schema))


def _hashes(batches):
    """SHA-256 of each node's pieces, which arrive in order; one state is held at a time."""
    key, state = None, None
    names = ["node", "depth", "ends_sha256"]
    for batch in batches:
        out = []
        for node, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "piece"))):
            if key != (node, depth):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) from (node, depth, conv_id): the hash of a node's ids, ascending and joined by commas.

    Ids are joined in pieces of ``ENDS`` numbers, as a hash can only be read in order: one task reads few
    strings even for a node with most of the ids.
    """
    pieces = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / ENDS).alias("at")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))
    pieces = pieces.select("node", "depth", "at", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("piece"))
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "at").select("node", "depth", "piece").mapInArrow(_hashes, "node bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv_id, depth from 1 without gaps, a, b, words), ``lengths`` (conv_id, n) every conversation, also those
    without turns. ``n_leaves`` and ``saved_tokens``, the words of last turns that all members but one could share, are totals over
    a node's subtree. Without conversations there are no rows.
    """
    paths, nodes = paths_and_nodes(turns, lengths)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    valued = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    totals = rolled_up(paths, valued, ["leaf", "saved"], local)
    root = nodes.filter("depth = 0").first()
    last = lengths.filter("n > 0").join(paths.select("conv_id", F.col("depth").alias("n"), "node"), ["conv_id", "n"]).select("node", F.col("n").alias("depth"), "conv_id")
    none = lengths.filter("n = 0").select(F.lit(root.node if root else None).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("depth"), "conv_id")
    joined = nodes.join(totals, ["node", "depth"]).join(end_hashes(last.union(none)), ["node", "depth"], "left")
    return joined.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


ship(__name__)
