"""Prefix trie of conversations, with a count-min sketch that keeps lone tails out of the shuffle.

A conversation is a sequence of turns; every distinct sequence of first turns is a
node. Nearly all nodes lie in the tail of a single conversation. A count-min
sketch over the digests of all prefixes never counts too low, so an estimate of
one proves that a prefix, and with it all longer ones, has one member: such tails
become rows where they are. Only prefixes that may be shared are shuffled and
grouped exactly.

Every conversation is cut into pieces of bounded length before anything is
gathered, and what a prefix needs from earlier pieces is a running total, so a
conversation of any length is spread over many tasks. Subtree figures need no
walk over the tree:

* the smallest member c of a node is also the smallest member of every longer
  prefix of c, so a conversation names nodes from one depth on (``first``);
* a leaf has one smallest member, so the leaves below a node are those of its
  members that name a leaf;
* the text a subtree saves is what its members read again: for each member, the
  turns from the node on that other members name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shopfloor.operators.sequence import dense_sequence, join_groups
from shopfloor.sources.staging import stage

PIECE_TURNS = 1024
"""Turns gathered into one row at most."""
ROWS = 3
"""Independent rows of the sketch."""
MOST_CELLS = 1 << 26
"""Cells of a sketch row at most: 24 MB of bits for all rows. With more prefixes than that, estimates run higher and
more prefixes are grouped exactly; the result stays the same."""
BLOCK = 1 << 16
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]
_NODE = ["depth", "h1", "h2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def pieces(turns: DataFrame, piece_turns: int, key: str = "conv_id") -> DataFrame:
    """(conv, chunk, turns): the turns of each conversation in order, as (z1, z2, chars), in pieces of bounded length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = turns.select(F.col(key).cast("long").alias("conv"), F.col("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = dense_sequence(named.where("conv is not null"), ["conv"], order, out="place")
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    digested = placed.withColumn("_d", digest).select(
        "conv",
        F.floor(F.col("place") / piece_turns).cast("long").alias("chunk"),
        F.struct(
            "place",
            F.xxhash64(F.lit(1), "_d").alias("z1"),
            F.xxhash64(F.lit(2), "_d").alias("z2"),
            F.length("text").cast("long").alias("chars"),
        ).alias("turn"),
    )
    gathered = digested.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return stage(gathered.select("conv", "chunk", F.expr("transform(turns, t -> struct(t.z1, t.z2, t.chars))").alias("turns")), "pieces")


def led_in(own: DataFrame, group: int, most: int, piece_turns: int) -> DataFrame:
    """(conv, chunk, start, turns): conversations that begin with the first turns of their group's first one.

    Conversation c begins with the first h = crc32(c) mod ``most`` turns of
    conversation c - c mod ``group`` (all if fewer, none if there is no such
    conversation) and goes on with its own after its first h. ``start`` is the
    depth before the piece.
    """
    if most > piece_turns:
        raise ValueError("the lead must fit into a piece")
    heads = own.where((F.col("chunk") == 0) & (F.col("conv") % group == 0))
    heads = heads.select(F.col("conv").alias("donor"), F.slice("turns", 1, most).alias("lead"))
    first = own.where("chunk = 0").select(
        "conv", "turns", (F.col("conv") - F.col("conv") % group).alias("donor"), (F.crc32(F.col("conv").cast("string")) % most).cast("int").alias("h")
    )
    first = first.join(heads, "donor", "left").withColumn("lead", F.coalesce(F.expr("slice(lead, 1, h)"), F.expr("slice(turns, 1, 0)")))
    # Later pieces only learn how much shorter the lead is than what it replaced: one small row a piece.
    shifts = own.where("chunk > 0").select("conv", "chunk")
    shifts = shifts.join(first.select("conv", (F.size("lead") - F.col("h")).alias("shift")), "conv")
    later = own.where("chunk > 0").join(shifts, ["conv", "chunk"])
    later = later.select("conv", "chunk", (F.col("chunk") * piece_turns + F.col("shift")).alias("start"), "turns")
    first = first.select(
        "conv", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("start"),
        F.expr("concat(lead, slice(turns, h + 1, size(turns)))").alias("turns"),
    )
    return first.unionByName(later)


def _mixed(z: np.ndarray, depth: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A 64-bit hash of each turn's digest at its depth."""
    x = z.astype(np.int64).view(np.uint64) ^ (depth.astype(np.uint64) * salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests and characters along each piece, and their totals."""
    for batch in batches:
        turns = batch.column(3)
        sizes = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = turns.flatten()
        z1, z2, chars = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        ends = np.cumsum(sizes)
        heads = ends - sizes
        place = np.arange(len(z1)) - np.repeat(heads, sizes)
        depth = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), sizes) + place + 1
        lists, totals = [], []
        for running, undo, values in (
            (np.bitwise_xor.accumulate, np.bitwise_xor, _mixed(z1, depth, _MIX[0])),
            (np.bitwise_xor.accumulate, np.bitwise_xor, _mixed(z2, depth, _MIX[1])),
            (np.cumsum, np.subtract, chars.astype(np.int64)),
        ):
            along = np.concatenate([np.zeros(1, values.dtype), running(values) if len(values) else values])
            inside = undo(along[1:], np.repeat(along[heads], sizes)).view(np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)), pa.int32()), pa.array(inside)))
            totals.append(pa.array(undo(along[ends], along[heads]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, *totals], names=_PREFIXED)


_PREFIXED = ["conv", "chunk", "start", "h1", "h2", "chars", "t1", "t2", "tc"]


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv, chunk, start, h1, h2, chars, base): digests of all prefixes that end in a piece, and the characters up
    to there; ``base`` is the characters before the piece.

    A prefix's digest is the exclusive or of its turns' digests, each mixed with its
    depth, so pieces are computed apart and joined by a running total.
    """
    schema = "conv long, chunk long, start long, h1 array<long>, h2 array<long>, chars array<long>, t1 long, t2 long, tc long"
    local = stage(sequences.mapInArrow(_prefixed, schema), "prefixes")
    # Running totals for conversations of several pieces, over rows without the turns.
    long = local.where("chunk > 0").select("conv").distinct()
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.select("conv", "chunk", "t1", "t2", "tc").join(long, "conv", "left_semi")
    totals = totals.select(
        "conv", "chunk", F.bit_xor("t1").over(earlier).alias("i1"), F.bit_xor("t2").over(earlier).alias("i2"), F.sum("tc").over(earlier).alias("ic")
    )
    none = F.lit(0).cast("long")
    found = local.join(totals.where("chunk > 0"), ["conv", "chunk"], "left").withColumns({c: F.coalesce(c, none) for c in ("i1", "i2", "ic")})
    return found.select(
        "conv", "chunk", "start",
        F.expr("transform(h1, x -> x ^ i1)").alias("h1"),
        F.expr("transform(h2, x -> x ^ i2)").alias("h2"),
        F.expr("transform(chars, x -> x + ic)").alias("chars"),
        F.col("ic").alias("base"),
    )


def sketch_bits(prefix_count: int, most_cells: int = MOST_CELLS) -> int:
    """Bits of a cell number: four cells for each prefix, within the bounds."""
    return min(max((4 * prefix_count - 1).bit_length(), 12), most_cells.bit_length() - 1)


def _cells(h1: np.ndarray, bits: int) -> np.ndarray:
    """Cell of every digest in every row of the sketch, rows one after the other."""
    rows = [((h1.view(np.uint64) * salt) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r, salt in enumerate(_MIX[:ROWS])]
    return np.stack(rows)


def count_min(found: DataFrame, bits: int) -> np.ndarray:
    """Whether each cell of the sketch counts two prefixes or more.

    Each batch reports the cells it hits once and those it hits more often, block
    by block; a block's reports are added, up to two, as they stream in.
    """
    block_bits = max(12, bits - 10)
    blocks = ROWS << (bits - block_bits)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, counts = np.unique(_cells(batch.column(0).flatten().to_numpy(zero_copy_only=False), bits), return_counts=True)
            owner = cells >> block_bits
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            offsets, many = (cells & ((1 << block_bits) - 1)).astype("<u2"), counts > 1
            once, more = [], []
            for start, end in zip(edges, [*edges[1:], len(cells)]):
                once.append(offsets[start:end][~many[start:end]].tobytes())
                more.append(offsets[start:end][many[start:end]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[edges], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"]
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                counts = held.setdefault(block, np.zeros(1 << block_bits, np.uint8))
                at = np.frombuffer(once, "<u2")
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(more, "<u2")] = 2
        if held:
            bitmaps = [np.packbits(c > 1, bitorder="little").tobytes() for c in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(bitmaps, pa.binary())], names=["block", "bitmap"])

    reports = found.select("h1").mapInArrow(report, "block long, once binary, more binary")
    merged = reports.repartition(min(blocks, 256), "block").mapInArrow(added, "block long, bitmap binary")
    out = np.zeros((blocks, 1 << (block_bits - 3)), np.uint8)
    for r in merged.collect():  # as many bits as the sketch has cells: bounded by ROWS * MOST_CELLS
        out[r.block] = np.frombuffer(r.bitmap, np.uint8)
    return out.reshape(-1)


def screened(found: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """Prefix pieces with ``last`` (turns of the conversation) and ``lone``: the first depth that provably no other
    conversation shares, ``last`` + 1 if there is none. The empty prefix counts as shared."""
    spark = found.sparkSession
    count = found.agg(F.sum(F.size("h1"))).first()[0] or 0
    bits = sketch_bits(count, most_cells)
    sketch = spark.sparkContext.broadcast(count_min(found, bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cells = _cells(lists.flatten().to_numpy(zero_copy_only=False), bits)
            shared = ((sketch.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=0)
            ends = np.cumsum(sizes)
            # The first place at or after each piece's head that is not shared, if it lies in the piece.
            alone = np.append(np.flatnonzero(~shared), len(shared) + 1)
            first = alone[np.searchsorted(alone, ends - sizes)]
            depth = batch.column(2).to_numpy(zero_copy_only=False) + first - (ends - sizes) + 1
            lone = pa.array(depth, pa.int64(), mask=first >= ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, lone], names=[*batch.schema.names, "alone"])

    schema = StructType([*found.schema.fields, StructField("alone", LongType())])
    looked = stage(found.mapInArrow(look, schema), "looked").withColumn("stop", F.col("start") + F.size("h1"))
    long = looked.where("chunk > 0").select("conv").distinct()
    whole = Window.partitionBy("conv")
    facts = looked.select("conv", "chunk", "alone", "stop").join(long, "conv", "left_semi")
    facts = facts.select("conv", "chunk", F.min("alone").over(whole).alias("_lone"), F.max("stop").over(whole).alias("_last"))
    out = looked.join(facts, ["conv", "chunk"], "left").withColumn("last", F.coalesce("_last", "stop"))
    return out.withColumn("lone", F.coalesce("_lone", "alone", F.col("last") + 1)).drop("_lone", "_last", "alone")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to one row a node and partition, more where a node has very many."""
    node, first, text, size = None, None, [], 0

    def row() -> pa.RecordBatch:
        values = [[node[0]], [node[1]], [node[2]], [first], [",".join(text)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64()] * 4 + [pa.string()])], names=[*_NODE, "first", "ids"])

    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node or size >= 1 << 20:
                if text:
                    yield row()
                node, first, text, size = key, conv, [], 0
            text.append(str(conv))
            size += len(text[-1]) + 1
    if text:
        yield row()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, first, ids) rows to the digest of each node's ids, a row at a time."""
    node, digest, made = None, None, []

    def given() -> pa.RecordBatch:
        columns = list(zip(*made))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*_NODE, "ends"])

    for batch in batches:
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node:
                if node:
                    made.append([*node, digest.hexdigest()])
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if made:
            yield given()
            made.clear()
    if node:
        made.append([*node, digest.hexdigest()])
        yield given()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, in order and joined by commas.

    Ids are sorted over all tasks first, so that a node where very many end arrives
    as a few long strings; only the hashing itself, a stream, is one task's.
    """
    ordered = ends.repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv").select(*_NODE, "conv")
    joined = ordered.mapInArrow(_joined_ids, "depth long, h1 long, h2 long, first long, ids string")
    grouped = joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return grouped.mapInArrow(_hashed_ids, "depth long, h1 long, h2 long, ends string")


def prefix_trie(
    turns: DataFrame,
    lead: tuple[int, int] | None = None,
    *,
    piece_turns: int = PIECE_TURNS,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """One row per node of the prefix trie of (conv_id, turn, role, text) rows.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, members but one times the
    code points of the node's last text), ends_sha256 (of the ids of the
    conversations that end at the node).

    Turns go by turn, null first; rows with the same turn by role and text, repeated
    rows stay. Null role and text are empty. Rows without a conv_id belong to no
    conversation and make no node; an empty table has no node, not even a root.
    ``lead`` = (group, most) has conversations begin with turns of another one, see
    ``led_in``. Other columns are not read. Prefixes are told apart by 128-bit
    digests made from SHA-256 of their turns.
    """
    own = pieces(turns, piece_turns)
    sequences = led_in(own, *lead, piece_turns) if lead else own.select("conv", "chunk", (F.col("chunk") * piece_turns).alias("start"), "turns")
    known = screened(prefixes(sequences), most_cells)

    # Rows of the prefixes that may be shared; the empty prefix of every conversation among them.
    kept = F.expr("slice(h1, 1, int(greatest(0, least(size(h1), lone - 1 - start))))")
    row = "named_struct('depth', start + i + 1, 'h1', x, 'h2', h2[i], 'upto', chars[i], 'before', if(i = 0, base, chars[i - 1]))"
    root = "named_struct('depth', 0L, 'h1', 0L, 'h2', 0L, 'upto', 0L, 'before', 0L)"
    rows = known.withColumn("_kept", kept).selectExpr(
        "conv", "lone", "last", f"inline(concat(if(chunk = 0, array({root}), slice(array({root}), 1, 0)), transform(_kept, (x, i) -> {row})))"
    )
    shared = stage(rows, "shared")
    ending = (F.col("depth") == F.col("last")).cast("long")
    groups = stage(
        shared.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("rep"), F.sum(ending).alias("n_ends")), "nodes"
    )

    # From which depth on each conversation names its nodes, and whether its last one is a leaf.
    named = groups.groupBy(F.col("rep").alias("conv")).agg(F.min("depth").alias("_first"), F.max(F.col("n_ends") == F.col("n_convs")).alias("_leaf"))
    firsts = shared.where("depth = 0").select("conv", "lone", "last").join(named, "conv", "left")
    firsts = firsts.select(
        "conv", "lone", "last",
        F.coalesce("_first", "lone").alias("first"),
        (F.coalesce("_leaf", F.lit(False)) | (F.col("lone") <= F.col("last"))).cast("long").alias("leaf"),
    ).withColumn("depth", F.col("first") - 1)
    above = firsts.join(shared.select("conv", *_NODE, F.col("upto").alias("read")), ["conv", "depth"], "left")
    parents = groups.select(*_NODE, F.col("rep").alias("parent"))
    known_convs = stage(
        join_groups(above, parents, _NODE, "left").select("conv", "lone", "last", "first", "leaf", F.coalesce("read", F.lit(0)).alias("read"), "parent"),
        "members",
    )

    member = join_groups(shared.select("conv", *_NODE, "before"), known_convs, ["conv"])
    own_parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).when(F.col("depth") == F.col("first"), F.col("parent"))
    has_child = ((F.col("first") <= F.col("depth") + 1) & (F.col("depth") < F.col("last"))).cast("long")
    reread = F.when(F.col("depth") < F.col("first"), F.col("read") - F.col("before")).otherwise(0)
    nodes = member.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"),
        F.max(own_parent).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(has_child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(reread).alias("saved_tokens"),
    )
    nodes = nodes.join(end_digests(shared.where("depth = last").select(*_NODE, "conv")), _NODE, "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).select(*columns)

    def alone(conv: Column, depth: Column, parent: Column, last: Column) -> list[Column]:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = F.when(depth == last, F.sha2(conv.cast("string"), 256)).otherwise(NO_ENDS)
        values = [conv, depth, parent, one, (depth < last).cast("long"), one, none, ends]
        return [v.alias(c) for v, c in zip(values, columns)]

    # The first node of a lone tail hangs below a shared one; the rest of the tail needs nobody.
    heads = known_convs.where("lone <= last")
    above_head = F.when(F.col("first") < F.col("lone"), F.col("conv")).otherwise(F.col("parent"))
    heads = heads.select(*alone(F.col("conv"), F.col("lone"), above_head, F.col("last")))
    tails = known.where("stop > greatest(lone, start)").select(
        "conv", "last", F.explode(F.expr("sequence(greatest(lone, start) + 1, stop)")).alias("depth")
    )
    tails = tails.select(*alone(F.col("conv"), F.col("depth"), F.col("conv"), F.col("last")))
    return nodes.unionByName(heads).unionByName(tails)
