"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A prefix is known by sums of hashes of (place, turn), which tasks can add up in
pieces; no conversation is held whole.  A node's heavy child is the one with the
most members (then the smallest member), so a light child has half its parent's
members at most, and a conversation crosses a logarithmic number of light nodes.
Each light node is the top of a path.  Paths are summed from the end up, deepest
level first; a path's total is then attached to the parent of its top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

#: Places of a conversation or path that one window holds; longer ones are summed block by block.
BLOCK = 4096
KEY = ["k0", "k1"]
LANES = ["h0", "h1", "h2", "h3"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, n_bytes): the turns of each conversation by turn, null first, from place 1; a and b are hashes of role and text.

    Equal turns are ordered by these hashes.  Rows are range-partitioned by conversation and turn and counted in each
    part, so that a long conversation is spread over tasks.
    """
    content = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.xxhash64(F.lit(1), *content).alias("a"), F.xxhash64(F.lit(2), *content).alias("b"), F.octet_length(content[1]).cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    rows = checkpointed(rows)
    dealt = checkpointed(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    shift = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = dealt.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return placed.join(shift, ["conv_id", "part"]).select("conv_id", (F.col("own") + F.col("shift")).alias("place"), "a", "b", "n_bytes")


def with_shared_heads(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, as turns (conv_id, depth, a, b, n_bytes) and (conv_id, length).

    Conversation c gets the first h turns of conversation c - c % group, then its own turns after its first h,
    with h = crc32(decimal c) % heads.
    """
    turns = checkpointed(turns)
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = own.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = checkpointed(own.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    rest = turns.join(own.select("conv_id", "h", "k"), "conv_id").where("place > h").withColumn("depth", F.expr("place - h + k"))
    first = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "h"), "base").where("place <= h").withColumn("depth", F.col("place"))
    columns = ["conv_id", "depth", "a", "b", "n_bytes"]
    return rest.select(*columns).unionByName(first.select(*columns)), own.select("conv_id", "length")


def running(rows: DataFrame, keys: Sequence[str], at: str, sums: Sequence[str], *, up: bool = False) -> DataFrame:
    """`rows` with each of `sums` added up along `at` within `keys` (from the largest `at` with `up`), in blocks of places."""
    side = Window.unboundedPreceding
    order = [F.col(c).desc() if up else F.col(c) for c in (at, "__block")]
    blocked = rows.withColumn("__block", F.floor(F.col(at) / BLOCK))
    total = blocked.groupBy(*keys, "__block").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*keys).orderBy(order[1]).rowsBetween(side, -1)
    carried = total.select(*keys, "__block", *[F.sum(c).over(before).alias(f"__{c}") for c in sums]).where(F.col(f"__{sums[0]}").isNotNull())
    inside = Window.partitionBy(*keys, "__block").orderBy(order[0]).rowsBetween(side, 0)
    within = blocked.select(*[F.sum(c).over(inside).alias(c) if c in sums else F.col(c) for c in blocked.columns])
    joined = within.join(carried, [*keys, "__block"], "left")
    return joined.select(*[(F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in rows.columns])


def _key(depth: Column, lanes: Sequence[Column], names: Sequence[str]) -> list[Column]:
    return [F.xxhash64(F.lit(i), depth, *lanes).alias(n) for i, n in enumerate(names)]


def _members(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, n_bytes, last): each conversation at each of its nodes, the root included."""
    depth, low = F.col("depth"), (1 << 32) - 1
    whole = [F.xxhash64(F.lit(i), "depth", "a", "b") for i in (3, 4)]
    lanes = [half for x in whole for half in (F.shiftrightunsigned(x, 32), x.bitwiseAND(low))]
    salted = turns.select("conv_id", "depth", "n_bytes", *[x.alias(n) for x, n in zip(lanes, LANES, strict=True)], *[x.alias(f"own_{n}") for x, n in zip(lanes, LANES, strict=True)])
    sums = running(salted, ["conv_id"], "depth", LANES)
    keyed = sums.select("conv_id", "depth", "n_bytes", *_key(depth, [F.col(n) for n in LANES], KEY), *_key(depth - 1, [F.col(n) - F.col(f"own_{n}") for n in LANES], ["p0", "p1"]))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("n_bytes"), *_key(zero, [zero] * 4, KEY), none.alias("p0"), none.alias("p1"), (F.col("length") == 0).alias("last"))
    ended = keyed.join(lengths, "conv_id").withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return checkpointed(roots.unionByName(ended.select(*roots.columns)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order to texts of one node's consecutive ids each."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in KEY], 1)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, np.int64)
        ids = batch.column("conv_id").to_pylist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(ids)], strict=True)] if len(keys) else []
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts, 0], pa.int64()), pa.array(keys[starts, 1], pa.int64()), pa.array([ids[a] for a in starts.tolist()], pa.int64()), pa.array(texts, pa.string())], [*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; the state of one node is held."""
    now, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for k0, k1, text in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
            if (k0, k1) == now:
                state.update(b"," + text.encode())
                continue
            if now:
                out.append((*now, state.hexdigest()))
            now, state = (k0, k1), hashlib.sha256(text.encode())
        yield _digest_rows(out)
    yield _digest_rows([(*now, state.hexdigest())] if now else [])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256) of the nodes where conversations end.

    Ids are joined to pieces within range partitions, then a node's pieces are hashed in order as a stream.
    """
    n = shuffle_partitions(members.sparkSession)
    ids = members.where("last").select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = ids.mapInArrow(_pieces, "k0 long, k1 long, first long, ids string")
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "k0 long, k1 long, ends_sha256 string")


def _nodes(members: DataFrame) -> DataFrame:
    """One row for each node, with its parent's smallest member and whether it is the top of a heavy path."""
    nodes = members.groupBy(*KEY, "depth").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("n_bytes").alias("n_bytes"))
    nodes = checkpointed(nodes)
    kids = nodes.where("depth > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    nodes = nodes.join(kids, KEY, "left").join(_ends(members), KEY, "left")
    nodes = checkpointed(nodes.fillna({"n_children": 0, "ends_sha256": hashlib.sha256(b"").hexdigest()}))
    parents = nodes.where("n_children > 0").select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("parent_heavy"))
    return nodes.join(parents, ["p0", "p1"], "left").withColumn("top", ~F.coalesce(F.col("conv_id") == F.col("parent_heavy"), F.lit(False))).drop("p0", "p1", "heavy", "parent_heavy")


def _paths(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """`nodes` with their path (the smallest member and depth of its top) and level, the number of light nodes above or at them.

    The light nodes of a conversation are few (a logarithm), so that they fit in one array.
    """
    light = nodes.where("top and depth > 0").select(*KEY, F.col("depth").alias("top_depth"), F.col("conv_id").alias("top_conv"))
    tops = members.where("depth > 0").join(light, KEY).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("top_depth", "top_conv"))).alias("tops"))
    rows = nodes.drop(*KEY, "top").join(tops, "conv_id", "left")
    own = F.filter(F.coalesce("tops", F.array().cast("array<struct<top_depth:bigint,top_conv:bigint>>")), lambda t: t["top_depth"] <= F.col("depth"))
    rows = rows.withColumn("own", own).withColumn("level", F.size("own")).withColumn("path", F.when(F.col("level") > 0, F.element_at("own", -1)))
    zero = F.lit(0).cast("long")
    return rows.select(*[c for c in nodes.columns if c not in (*KEY, "top")], "level", F.coalesce("path.top_depth", zero).alias("top_depth"), F.coalesce("path.top_conv", zero).alias("top_conv"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each prefix of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has (conv_id, depth from 1 without gaps, a, b, n_bytes) with two hashes of a turn, `lengths` each conversation with
    its number of turns, 0 included.  Columns are as in the contract of op11: conv_id is the smallest member, n_leaves
    counts the childless nodes below or at a node, saved_tokens sums (n_convs - 1) * n_bytes over them, ends_sha256 digests the
    ids of the conversations that end there.  Without conversations there are no nodes.  Equal conversations are members
    of the same nodes.  Turns are equal if both 64-bit hashes are.
    """
    members = _members(turns, lengths)
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")
    leaves = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    paths = checkpointed(_paths(checkpointed(_nodes(members)), members).select("*", saved, leaves))
    levels = paths.agg(F.max("level")).first()[0]
    sums, below = ["saved_tokens", "n_leaves"], None
    out = paths.limit(0)
    for level in range(levels if levels is not None else -1, -1, -1):
        rows = paths.where(F.col("level") == level)
        if below is not None:
            joined = rows.join(below, ["conv_id", "depth"], "left")
            rows = joined.select(*[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in paths.columns])
        done = checkpointed(running(rows, ["top_conv", "top_depth"], "depth", sums, up=True))
        tops = done.where("depth = top_depth")
        below = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        out = out.unionByName(done)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
