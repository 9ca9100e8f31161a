"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, exact verification.

Documents with the same set of shingles are compared as one set, its smallest id.
In the global order of shingles, rarest first, two sets of similarity t share one of
the first n - ceil(t n) + 1 shingles of each. A shingle that only one document has
matches nothing, so a set with that many such shingles has no partner and is
out; all that ever returns to the sets are the shingles that two or more have.

Frequencies are counted in buckets of the hash space, each of bounded size; the
few shingles of a fixed share of all sets are known beforehand from a pass that
aggregates per task, and never enter a bucket.

Links are taken in two rounds. First each set is compared with the least edited
set of its lists. Then only sets that are still apart are compared, all of them:
of a group of near copies, pairs that are connected already are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.components import components
from shopfloor.llm.shingles import shingle_sets, signature
from shopfloor.llm.workers import own_turn
from shopfloor.sources.staging import stage

BATCH_CHARS = 3_000_000
BUCKET_ENTRIES = 1_500_000
"""Shingles counted together in one group; with the hot ones apart this bounds a task's memory."""
HOT_SHARE = 0.002
"""Shingles in more than this share of all sets are hot: at most the mean set size / HOT_SHARE of them."""
REPORTED = 4
"""Sets of one batch that must have a shingle for the batch to report it."""
COPY_SHARE = 0.0001
"""Of sets that more than this share of all documents have only one document is placed: at most 1 / COPY_SHARE of them."""
MARKED_TOGETHER = 1_000_000
"""Sets whose ids and sizes a task sorts by part at once."""
CLASSES = 16
_HOT_RANK = 1 << 31


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts (second column) have at most BATCH_CHARS characters, or one row."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and held + size > BATCH_CHARS:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def signatures(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles, sig; on the first row of a batch also the shingles many of its sets have."""

    @own_turn()
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch):
                sets = shingle_sets(batch.column(1)[a:b].to_pylist(), n)
                sigs = [signature(s) for s in sets]
                distinct = dict(zip(sigs, sets))
                found, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                many = counts >= REPORTED
                rest = [None] * (b - a - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sigs, pa.binary()),
                        pa.array([found[many].view(np.int64).tolist(), *rest], pa.list_(pa.int64())),
                        pa.array([counts[many].tolist(), *rest], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sig", "hot", "hot_sets"],
                )

    schema = "doc_id long, n_shingles long, sig binary, hot array<long>, hot_sets array<long>"
    return docs.select(F.col(key).cast("long"), text).mapInArrow(sign, schema)


def hot_shingles(signed: DataFrame, n_sets: int) -> np.ndarray:
    """Hot shingles in order of their reported frequency. Bounded: see HOT_SHARE."""
    pairs = signed.where("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_sets")).alias("p"))
    counted = pairs.groupBy(F.col("p.hot").alias("h")).agg(F.sum("p.hot_sets").alias("c"))
    rows = counted.where(F.col("c") >= max(HOT_SHARE * n_sets, REPORTED)).select("c", "h").collect()
    return np.array([h for _, h in sorted((r["c"], r["h"]) for r in rows)], np.int64).view(np.uint64)


_PACKED = ["ids", "sizes", "counts", "hashes", "ranks"]
_FORWARD = "bucket int, ids binary, sizes binary, counts binary, hashes binary, ranks binary"


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers at the least width that holds all of them; the width goes first."""
    width = np.min_scalar_type(int(values.max(initial=0))).itemsize
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _packed(key: int, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray, low: bool, sizes: np.ndarray | None = None, ranks: np.ndarray | None = None) -> tuple:
    """One row for the hashes of the sets with these ascending ids: differences of ids, hashes a set, then the hashes.

    A row that tells the sizes of its sets makes them candidates.
    """
    data = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 6 if low else 8])
    steps = np.diff(ids, prepend=ids[:1]).view(np.uint64)
    return (
        key,
        ids[:1].astype("<i8").tobytes() + _narrow(steps),
        _narrow(np.zeros(0, np.uint8) if sizes is None else sizes),
        _narrow(counts),
        data.tobytes(),
        _narrow(np.zeros(0, np.uint8) if ranks is None else ranks),
    )


def _rows(packed: list[tuple], key: str) -> pa.RecordBatch:
    columns = list(zip(*packed)) if packed else [()] * 6
    arrays = [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]]
    return pa.RecordBatch.from_arrays(arrays, names=[key, *_PACKED])


def _unpacked(table: pa.Table, low: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: set ids, sizes where the row tells them (else 0), and owner, hash and rank of each entry."""
    ids, sizes, counts, ranks = [], [], [], []
    for some, told, each, order in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "counts", "ranks"))):
        first = np.frombuffer(some, "<i8", 1).view(np.uint64)
        ids.append((first + np.cumsum(_wide(some[8:]), dtype=np.uint64)).view(np.int64))
        counts.append(_wide(each).astype(np.int64))
        sizes.append(_wide(told).astype(np.int64) if len(told) > 1 else np.zeros(len(ids[-1]), np.int64))
        ranks.append(_wide(order).astype(np.uint32))
    raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, 6 if low else 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    ids, sizes, counts, ranks = (np.concatenate(x) for x in (ids, sizes, counts, ranks))
    return ids, sizes, np.repeat(np.arange(len(counts), dtype=np.int32), counts), wide.view("<u8").ravel(), ranks


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """Even split of sets by their id."""
    return _slot(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts).astype(np.int64)


def _slot(values: np.ndarray, slots: int) -> np.ndarray:
    """Even split of 64-bit hashes by their upper half."""
    return ((values >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)


def shared_shingles(
    texts: DataFrame, reps: DataFrame, n: int, hot: np.ndarray, copied: dict[bytes, int], buckets: int, threshold: tuple[int, int]
) -> DataFrame:
    """Sets that may have a partner: rep, n, alone (shingles of no other document), tokens, prefix (t, pos), classes.

    ``texts`` are (id, text), ``reps`` (rep, n) the document that stands for each
    set and its size; of a signature in ``copied`` only that document is placed.
    Other copies are placed and counted like any document: that changes the order
    of the shingles, for all in the same way, and nothing else. The reps go to the
    parts where sets are put together, so copies end there and no set moves again.
    ``tokens`` are the shingles that two documents or more have; ``prefix`` those
    of them among the rarest n - ceil(t n) + 1, with their place in the order.
    """
    order = np.argsort(hot)
    hot_sorted = hot[order]
    num, den = threshold

    @own_turn()
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch):
                found = dict(zip(batch.column(0)[a:b].to_pylist(), shingle_sets(batch.column(1)[a:b].to_pylist(), n)))
                found = {i: found[i] for i in sorted(found) if len(found[i]) and copied.get(signature(found[i]), i) == i}
                if not found:
                    continue
                ids, sizes = np.array(list(found), np.int64), np.array([len(s) for s in found.values()])
                owner, hashes = np.repeat(np.arange(len(ids)), sizes), np.concatenate(list(found.values()))
                del found
                at = np.searchsorted(hot_sorted, hashes)
                at[at == len(hot_sorted)] = 0
                is_hot = hot_sorted[at] == hashes if len(hot_sorted) else np.zeros(len(hashes), bool)
                packed = []
                # The rank of hot ones is known, so they go straight to the part of their set.
                part, hots = _part(ids, buckets), np.flatnonzero(is_hot)
                hots = hots[np.argsort(part[owner[hots]], kind="stable")]
                cuts = np.flatnonzero(np.diff(part[owner[hots]], prepend=-1, append=-2)) if len(hots) else []
                for i, j in zip(cuts, cuts[1:]):
                    rows = hots[i:j]
                    owners, counts = np.unique(owner[rows], return_counts=True)
                    packed.append(_packed(buckets + int(part[owners[0]]), ids[owners], counts, hashes[rows], False, ranks=order[at[rows]] + _HOT_RANK))
                owner, hashes = owner[~is_hot], hashes[~is_hot]
                home = _slot(hashes, buckets).astype(np.int64)
                by_home = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[by_home], prepend=-1, append=-2))
                for i, j in zip(cuts, cuts[1:]):
                    rows = by_home[i:j]
                    owners, counts = np.unique(owner[rows], return_counts=True)
                    packed.append(_packed(int(home[rows[0]]), ids[owners], counts, hashes[rows], True))
                    if len(packed) >= 64:
                        yield _rows(packed, "bucket")
                        packed = []
                yield _rows(packed, "bucket")

    @own_turn()
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)

        def marked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, sizes = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(2))
            part = _part(ids, buckets)
            rows = np.lexsort((ids, part))
            cuts = np.flatnonzero(np.diff(part[rows], prepend=-1, append=-2))
            mine = [rows[i:j] for i, j in zip(cuts, cuts[1:])]
            return _rows([_packed(int(part[m[0]]), ids[m], np.zeros(len(m), np.uint8), none, False, sizes[m]) for m in mine], "part")

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= MARKED_TOGETHER:
                yield marked(held)
                held = []
        if held:
            yield marked(held)

    def count(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        if k >= buckets:
            return table.set_column(0, "part", pa.array([k - buckets] * len(table), pa.int32()))
        ids, _, owner, hashes, _ = _unpacked(table, low=True)
        names, first, same = np.unique(ids, return_index=True, return_inverse=True)
        if len(names) < len(ids):  # rows that repeat an id
            mine = first[same][owner] == owner
            owner, hashes = owner[mine], hashes[mine]
        owner = same[owner]
        order = np.argsort(hashes)
        owner, hashes = owner[order], hashes[order]
        first_of = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        counts = np.diff(first_of, append=len(hashes))
        shared = np.repeat(counts > 1, counts)
        ranks = np.repeat(counts, counts)[shared]
        owner, hashes = owner[shared], hashes[shared]
        # The bucket stands for the upper bits that were left out.
        hashes = hashes | (np.uint64(k % 65536) << np.uint64(48))
        part = _part(names, buckets)[owner]
        by_part = np.lexsort((owner, part))
        cuts = np.flatnonzero(np.diff(part[by_part], prepend=-1, append=-2))
        packed = []
        for i, j in zip(cuts, cuts[1:]):
            rows = by_part[i:j]
            owners, counts = np.unique(owner[rows], return_counts=True)
            packed.append(_packed(int(part[rows[0]]), names[owners], counts, hashes[rows], False, ranks=ranks[rows]))
        return pa.Table.from_batches([_rows(packed, "part")])

    def gather(table: pa.Table) -> pa.Table:
        ids, told, owner, hashes, ranks = _unpacked(table, low=False)
        names, same = np.unique(ids, return_inverse=True)
        sizes = np.zeros(len(names), np.int64)
        np.maximum.at(sizes, same, told)
        owner = same[owner]
        rows = np.lexsort((hashes, ranks, owner))
        owner, hashes = owner[rows], hashes[rows]
        # Hot shingles of rows that repeat an id arrive more than once.
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))])
        out: dict[str, list] = {c: [] for c in ("rep", "n", "alone", "tokens", "prefix", "classes")}
        for k in range(len(names)):
            tokens = hashes[ends[k] : ends[k + 1]].view(np.int64)
            size = int(sizes[k])
            alone = size - len(tokens)
            reach = size - -(-num * size // den) + 1
            if not size or alone >= reach:
                continue
            out["rep"].append(int(names[k]))
            out["n"].append(size)
            out["alone"].append(alone)
            out["tokens"].append(np.sort(tokens).tolist())
            out["prefix"].append([{"t": t, "pos": alone + i} for i, t in enumerate(tokens[: reach - alone].tolist())])
            out["classes"].append(np.bincount(tokens.view(np.uint64) % np.uint64(CLASSES), minlength=CLASSES).tolist())
        return pa.table(out, schema=_SETS_ARROW)

    placed = texts.mapInArrow(place, _FORWARD)
    counted = placed.groupBy("bucket").applyInArrow(count, _FORWARD.replace("bucket", "part"))
    marks = reps.select(F.col("rep").cast("long"), F.col("n").cast("long")).mapInArrow(mark, _FORWARD.replace("bucket", "part"))
    return counted.union(marks).groupBy("part").applyInArrow(gather, _SETS)


_SETS = "rep long, n int, alone int, tokens array<long>, prefix array<struct<t long, pos int>>, classes array<int>"
_SETS_ARROW = pa.schema(
    [
        ("rep", pa.int64()),
        ("n", pa.int32()),
        ("alone", pa.int32()),
        ("tokens", pa.list_(pa.int64())),
        ("prefix", pa.list_(pa.struct([("t", pa.int64()), ("pos", pa.int32())]))),
        ("classes", pa.list_(pa.int32())),
    ]
)


def _needed(nx: Column, ny: Column, num: int, den: int) -> Column:
    """Smallest intersection of sets of these sizes that reaches the similarity."""
    return F.ceil(F.lit(num) * (nx + ny) / F.lit(num + den))


def _filters(x: str, y: str, num: int, den: int) -> Column:
    """Length filter and positional filter of two list entries: what can still be shared from this place on."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (left >= _needed(nx, ny, num, den))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: suffix filter, then the exact intersection.

    The suffix filter cuts both sets into classes by hash; the smaller count of
    each class bounds what they share.
    """
    x = sets.select(F.col("rep").alias("a"), F.struct("n", "tokens", "classes").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.struct("n", "tokens", "classes").alias("y"))
    least = F.zip_with("x.classes", "y.classes", lambda a, b: F.least(a, b))
    bound = F.aggregate(least, F.lit(0), lambda s, c: s + c)
    needed = _needed(F.col("x.n"), F.col("y.n"), num, den)
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return pairs.join(x, "a").join(y, "b").where(F.when(bound >= needed, shared >= needed).otherwise(False)).select("a", "b")


def jaccard_components(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (3, 4), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when their sets of n-word shingles have a Jaccard
    similarity of at least ``threshold`` (numerator, denominator). Documents
    without words have no shingles and link with nothing. Rows are kept, repeated
    ones too: equal texts link. A null key takes part in nothing and gets a null
    component; rows that repeat a key should hold the same text. An empty table
    gives no rows.
    """
    num, den = threshold
    spark = docs.sparkSession
    signed = stage(signatures(docs, n, key, text), "signatures")
    groups = stage(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")),
        "sets",
    )
    n_sets, n_docs, entries = groups.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("copies", F.col("copies") * F.col("n"))]).first()
    copied = groups.where((F.col("copies") > 1) & (F.col("copies") > COPY_SHARE * n_docs)).select("sig", "rep").collect()
    copied = {bytes(r["sig"]): r["rep"] for r in copied}
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ENTRIES))
    hot = hot_shingles(signed, n_sets)
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    sets = stage(shared_shingles(texts, groups.select("rep", "n"), n, hot, copied, buckets, threshold), "candidates")
    lists = stage(sets.select(F.explode("prefix").alias("p"), "rep", "n", "alone").select("p.t", "p.pos", "rep", "n", "alone"), "lists")

    # Round one: the least edited set of each list; every set is compared with the best of those.
    least = F.min(F.struct("alone", "rep", "n", "pos")).alias("c")
    centers = stage(lists.groupBy("t").agg(least, F.count("*").alias("members")).where("members > 1"), "centers")
    c = centers.select("t", F.col("c.alone").alias("alone"), F.col("c.rep").alias("rep"), F.col("c.n").alias("n"), F.col("c.pos").alias("pos"))
    near = lists.alias("x").join(c.alias("y"), "t").where((F.col("x.rep") != F.col("y.rep")) & _filters("x", "y", num, den))
    best = near.groupBy(F.col("x.rep").alias("a")).agg(F.min(F.struct("y.alone", "y.rep")).alias("c"))
    tried = stage(best.select("a", F.col("c.rep").alias("b")), "tried")
    first = stage(verified(tried, sets, num, den), "links")

    # Round two: whatever is still apart. Labels need not be final: equal labels are connected, others may be.
    label = first
    for _ in range(2):
        up = first.select(F.col("a").alias("b"), F.col("b").alias("up"))
        label = label.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b"))
    label = stage(label, "labels")
    labelled = lists.join(label.select(F.col("a").alias("rep"), F.col("b").alias("l")), "rep", "left")
    labelled = stage(labelled.withColumn("l", F.coalesce("l", "rep")), "labelled")
    home = stage(
        labelled.groupBy("t").agg(F.min_by("l", F.struct("alone", "rep")).alias("home"), F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo != hi"),
        "homes",
    )
    mixed = stage(labelled.join(home.select("t", "home"), "t"), "mixed")
    apart = mixed.where("l != home")
    # Sets of the list's home label are met by all others; two of the others meet once.
    meet = (F.col("x.l") != F.col("y.l")) & ((F.col("y.l") == F.col("y.home")) | (F.col("x.rep") < F.col("y.rep")))
    pairs = apart.alias("x").join(mixed.alias("y"), "t").where(meet & _filters("x", "y", num, den))
    pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = verified(stage(pairs.join(done, ["a", "b"], "left_anti"), "pairs"), sets, num, den)

    roots = stage(components(first.unionByName(second)), "roots")
    named = groups.select("sig", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = stage(named.select("sig", F.coalesce("root", "rep").alias("root")), "named")
    found = signed.select("doc_id", "n_shingles", "sig").join(named, "sig", "left")
    own = F.col("doc_id").isNotNull()
    return found.select("doc_id", "n_shingles", F.when(own, F.coalesce("root", "doc_id")).alias("component_id"))
