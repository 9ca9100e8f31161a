"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors with equal labels are cut into shards of bounded size, each with a graph
of its own; every vector is a query to every shard of its label. A shard audits
itself: the answers to some queries are compared with brute force over the
shard, and the beam widens until enough true pairs, or where these are few
enough nearest neighbours, are found. Found pairs are
verified by their cosine in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.components import components
from shopfloor.sources.staging import stage

SHARD = 8_192
"""Vectors per graph at most, about: what one task holds is two shards, whatever the size of a label."""
DEGREE = 12
BUILD_BEAM = 40
BEAM = 32
MOST_BEAM = 128
"""A search costs its beam squared; queries that need a wider one are answered by a matrix product over the shard."""
AUDITED = 64
"""Queries per shard and batch that brute force answers too."""
RECALL = 0.98
EVIDENCE = 256
"""True pairs that an audit must see; with fewer, the nearest vertices are asked for too."""
NEAREST = 4
QUERIES = 4_096
"""Queries that go through a graph together."""
PAIR_NUMBERS = 1 << 21
"""Numbers of vectors held at a time, on either side, to verify pairs."""
MOST_TASKS = 10_000
"""Tasks that shards, or pairs of shards, are dealt to at most; a task takes them one after another."""


class Hnsw:
    """A graph over unit vectors; insertion and search take many vectors at a time.

    Level 0 links every vector, each higher level about a sixteenth of the one
    below. A search goes down greedily from the top and keeps a beam at level 0.
    """

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 0):
        self.vectors = vectors
        self.width = 0
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(16)).astype(np.int64), 6)
        order = np.argsort(-self.levels, kind="stable")
        # The vertices of the top come first, so every level is connected from its own entry.
        self.links = [np.full((n, 2 * degree if level == 0 else degree), -1, np.int64) for level in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            # As many at a time as there are vectors to link to, up to a bound.
            batch = order[done : done + min(done, 512)]
            self._insert(batch, beam)
            done += len(batch)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        links = {f"links{k}": table.astype(np.int32) for k, table in enumerate(self.links)}
        np.savez(out, vectors=self.vectors, levels=self.levels.astype(np.int8), entry=np.array([self.entry]), width=np.array([self.width]), **links)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Hnsw":
        graph = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            graph.vectors, graph.levels, graph.entry = parts["vectors"], parts["levels"].astype(np.int64), int(parts["entry"][0])
            graph.width = int(parts["width"][0])
            graph.links = [parts[f"links{k}"].astype(np.int64) for k in range(len(parts.files) - 4)]
        return graph

    def _near(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cosines of each query with its row of vertices; -2 where there is none."""
        found = np.einsum("qd,qkd->qk", queries, self.vectors[ids])
        return np.where(ids >= 0, found, -2.0)

    def _search(self, queries: np.ndarray, starts: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` vertices of each query at a level (ids, cosines), from the given starts."""
        n = len(queries)
        ids = np.full((n, beam), -1, np.int64)
        ids[:, : starts.shape[1]] = starts
        near = self._near(queries, ids)
        opened = ids < 0
        live = np.arange(n)
        while len(live):
            waiting = np.where(opened[live], -3.0, near[live])
            best = waiting.argmax(axis=1)
            more = waiting[np.arange(len(live)), best] > -2.0
            live, best = live[more], best[more]
            if not len(live):
                break
            opened[live, best] = True
            new = self.links[level][ids[live, best]]
            # Vertices already in the beam come back marked as none; those that fell out of it are too far anyway.
            new = np.where((new[:, :, None] == ids[live][:, None, :]).any(axis=2), -1, new)
            cosines = self._near(queries[live], new)
            all_ids = np.concatenate([ids[live], new], axis=1)
            all_near = np.concatenate([near[live], cosines], axis=1)
            all_open = np.concatenate([opened[live], new < 0], axis=1)
            keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            near[live] = np.take_along_axis(all_near, keep, 1)
            opened[live] = np.take_along_axis(all_open, keep, 1) | (ids[live] < 0)
        return ids, near

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        starts = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, to, -1):
            starts = self._search(queries, starts, level, 1)[0]
        return starts

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        queries = self.vectors[batch]
        starts = np.full((len(batch), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            member = self.levels[batch] >= level
            if not member.any():
                starts = self._search(queries, starts, level, 1)[0]
                continue
            found, near = self._search(queries, starts, level, beam)
            table = self.links[level]
            width = table.shape[1]
            order = np.argsort(-near, axis=1)
            found = np.take_along_axis(found, order, 1)
            for i in np.flatnonzero(member).tolist():
                chosen = found[i][found[i] >= 0]
                chosen = self._spread(batch[i], chosen, width // 2)
                table[batch[i], : len(chosen)] = chosen
                for other in chosen.tolist():
                    self._link(table, other, int(batch[i]))
            starts = found[:, :1] if level else found

    def _spread(self, vertex: int, around: np.ndarray, most: int) -> np.ndarray:
        """Neighbours nearest first, leaving out those nearer to a chosen one than to the vertex; filled up in order."""
        if len(around) <= most:
            return around
        near = self.vectors[around] @ self.vectors[vertex]
        among = self.vectors[around] @ self.vectors[around].T
        chosen: list[int] = []
        for k in range(len(around)):
            if len(chosen) == most:
                break
            if not chosen or among[k, chosen].max() < near[k]:
                chosen.append(k)
        rest = [k for k in range(len(around)) if k not in set(chosen)]
        return around[np.array(chosen + rest[: most - len(chosen)], np.int64)]

    def _link(self, table: np.ndarray, vertex: int, new: int) -> None:
        row = table[vertex]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        around = np.append(row, new)
        near = self.vectors[around] @ self.vectors[vertex]
        table[vertex] = self._spread(vertex, around[np.argsort(-near, kind="stable")], len(row))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query at level 0: ids (-1 where none) and cosines."""
        return self._search(queries, self._descend(queries, 0), 0, beam)

    def within(
        self, queries: np.ndarray, cosine: float, beam: int = BEAM, audited: int = AUDITED, recall: float = RECALL, own: bool = False
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, vertex) of at least that cosine, a part of the queries at a time.

        A beam that is full of hits was too narrow, so it doubles for that query
        till it is not. Besides, each part is audited from the widest beam found
        so far; ``own`` says that the queries are the graph's vectors themselves.
        """
        width = max(beam, self.width)
        for at in range(0, len(queries), QUERIES):
            part = queries[at : at + QUERIES]
            width = self.audit(part, cosine, width, audited, recall, at if own else None)
            for q, v in self._hits(part, cosine, width):
                yield q + at, v

    def audit(self, part: np.ndarray, cosine: float, beam: int, audited: int = AUDITED, recall: float = RECALL, own_at: int | None = None) -> int:
        """The beam, doubled until it reaches the recall on some queries that brute force answers too.

        A query's match with itself is no evidence. Where the sample has few true
        pairs, its NEAREST vertices have to be found as well. A beam as wide as the
        shard is brute force itself.
        """
        n = len(self.vectors)
        width = min(beam, n)
        sample = np.arange(0, len(part), max(1, len(part) // audited))
        itself = np.full(len(sample), -1) if own_at is None else sample + own_at
        true = part[sample] @ self.vectors.T
        if own_at is not None:
            true[np.arange(len(sample)), itself] = -2.0
        truth = int((true >= cosine).sum())
        k = min(NEAREST, n - (own_at is not None))
        nearest = np.partition(true, n - k, axis=1)[:, n - k] if k > 0 else None
        while width < n:
            hits = sum(int((v != itself[q]).sum()) for q, v in self._hits(part[sample], cosine, width))
            enough = hits >= recall * truth
            if enough and truth < EVIDENCE and nearest is not None:
                ids, near = self.search(part[sample], max(width, k + 1))
                met = (near >= nearest[:, None] - 1e-12) & (ids >= 0) & (ids != itself[:, None])
                enough = np.minimum(met.sum(axis=1), k).sum() >= recall * k * len(sample)
            if enough:
                break
            width = min(2 * width, n) if width < MOST_BEAM else n
        return width

    def _hits(self, queries: np.ndarray, cosine: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, todo = len(self.vectors), np.arange(len(queries))
        while len(todo):
            if beam >= min(n, MOST_BEAM + 1):
                # As dear as brute force, so it is that.
                for at in range(0, len(todo), 256):
                    q, v = np.nonzero(queries[todo[at : at + 256]] @ self.vectors.T >= cosine)
                    yield todo[at + q], v
                return
            step, again = max(1, (1 << 16) // beam), []
            for at in range(0, len(todo), step):
                now = todo[at : at + step]
                ids, near = self.search(queries[now], beam)
                hit = (near >= cosine) & (ids >= 0)
                full = hit.all(axis=1)
                again.append(now[full])
                hit[full] = False
                q, k = np.nonzero(hit)
                yield now[q], ids[q, k]
            todo, beam = np.concatenate(again), min(2 * beam, n)


def linked(one: Hnsw, other: Hnsw | None, cosine: float) -> np.ndarray:
    """True where a vector of one graph links with one of the other (None: with another of its own), asked in both directions.

    The matrix is all that is kept, however many pairs there are: a byte for each pair of two shards.
    """
    to = one if other is None else other
    links = np.zeros((len(one.vectors), len(to.vectors)), bool)
    step = max(1, PAIR_NUMBERS // max(one.vectors.shape[1], 1))
    for graph, asking, seen in [(to, one, links)] + ([] if other is None else [(one, to, links.T)]):
        for q, v in graph.within(asking.vectors, cosine - 1e-9, own=other is None):
            new = ~seen[q, v]
            q, v = q[new], v[new]
            for at in range(0, len(q), step):
                i, j = q[at : at + step], v[at : at + step]
                near = np.einsum("ij,ij->i", asking.vectors[i], graph.vectors[j]) >= cosine
                seen[i[near], j[near]] = True
    if other is None:
        np.fill_diagonal(links, False)
        links |= links.T.copy()
    return links


def weighed(links: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Per row the copies of the vectors it links with."""
    parts = [links[at : at + 256].astype(np.float64) @ copies.astype(np.float64) for at in range(0, len(links), 256)]
    return np.concatenate([np.zeros(0), *parts]).astype(np.int64)


def stars_of(links: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Connected parts of rows and columns: the first row, and all rows and columns; each is looked at once."""
    waiting, unseen = links.any(axis=1), np.ones(links.shape[1], bool)
    for seed in np.flatnonzero(waiting).tolist():
        if not waiting[seed]:
            continue
        waiting[seed] = False
        rows, columns, now = [np.array([seed])], [], np.array([seed])
        while len(now):
            reached = np.zeros_like(unseen)
            for at in range(0, len(now), 256):
                reached |= links[now[at : at + 256]].any(axis=0)
            reached = np.flatnonzero(reached & unseen)
            unseen[reached] = False
            columns.append(reached)
            more = np.zeros_like(waiting)
            for at in range(0, len(reached), 256):
                more |= links[:, reached[at : at + 256]].any(axis=1)
            now = np.flatnonzero(more & waiting)
            waiting[now] = False
            rows.append(now)
        yield seed, np.concatenate(rows), np.concatenate(columns)


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_size: int = SHARD
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id, kept.

    Two vectors link if their labels are equal and not null, they have as many
    components, and their cosine is at least ``cosine``. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do
    null keys. Equal vectors of a label are one vertex of the graphs; each counts
    as linked to all the others. Keys should be unique. An empty table gives no
    rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0.0)
    good = F.coalesce(sound & finite, F.lit(False))
    rows = stage(rows.withColumn("same", F.when(good, F.xxhash64("v"))), "vectors")
    # Equal vectors are one vertex; a hash decides only together with the vector itself.
    points = rows.where("same is not null").groupBy("label", "same", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    points = stage(points.withColumn("size", F.size("v")), "points")
    counts = points.groupBy("label", "size").count()
    shards = stage(counts.select("label", "size", F.ceil(F.col("count") / shard_size).cast("int").alias("shards")), "shards")
    homes = stage(points.join(shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")), "homes")

    def build(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        order = np.argsort(rep)
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)[order]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        first = {c: table.column(c)[:1] for c in ("label", "size", "shard")}
        copies = table.column("copies").to_numpy()[order].astype("<i8").tobytes()
        graph = Hnsw(x)
        # Every block that asks this graph starts from the beam its own vectors need.
        graph.width = graph.audit(x[:QUERIES], cosine - 1e-9, BEAM, own_at=0)
        return pa.table({**first, "reps": [rep[order].astype("<i8").tobytes()], "copies": [copies], "graph": [graph.to_bytes()]})

    def link(table: pa.Table) -> pa.Table:
        """Two shards, or one with itself: links of each vector, and edges that span what is linked."""
        a_ids, b_ids, a_copies, b_copies = (np.frombuffer(table.column(c)[0].as_py(), "<i8") for c in ("asking", "reps", "a_copies", "copies"))
        one, other = (Hnsw.from_bytes(table.column(c)[0].as_py()) for c in ("vectors", "graph"))
        same = table.column("shard")[0].as_py() == table.column("block")[0].as_py()
        links = linked(one, None if same else other, cosine)
        vertices, sums = [a_ids], [weighed(links, b_copies)]
        if not same:
            vertices, sums = [a_ids, b_ids], [*sums, weighed(links.T, a_copies)]
        vertices, sums = np.concatenate(vertices), np.concatenate(sums)
        stars = [(a_ids[seed], np.concatenate([a_ids[rows], b_ids[columns]])) for seed, rows, columns in stars_of(links)]
        stars = [(np.full(len(members), seed), members) for seed, members in stars]
        seeds, members = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (zip(*stars) if stars else ((), ())))
        apart, met_ = seeds != members, sums > 0
        a = np.concatenate([vertices[met_], seeds[apart]])
        b = pa.array(np.concatenate([vertices[met_], members[apart]]), mask=np.arange(len(a)) < met_.sum())
        return pa.table({"a": a, "b": b, "others": np.concatenate([sums[met_], np.zeros(apart.sum(), np.int64)])})

    kind = vectors.schema[label].dataType.simpleString()
    # A few large rows weigh too little to be spread by their bytes, so the tasks are counted.
    number = shards.agg(F.sum("shards").alias("one"), F.sum(F.expr("shards * (shards + 1) div 2")).alias("two")).first()
    tasks, met_tasks = (min(max(n or 1, 1), MOST_TASKS) for n in number)
    built = homes.select("label", "size", "shard", "rep", "v", "copies").repartition(tasks, "label", "size", "shard").groupBy("label", "size", "shard")
    graphs = stage(built.applyInArrow(build, f"label {kind}, size int, shard int, reps binary, copies binary, graph binary"), "graphs")
    asking = [F.col(c).alias(name) for c, name in (("shard", "block"), ("reps", "asking"), ("copies", "a_copies"), ("graph", "vectors"))]
    # Each pair of shards meets once, in both directions.
    met = graphs.select("label", "size", *asking).join(graphs, ["label", "size"]).where("block <= shard")
    met = met.repartition(met_tasks, "label", "size", "shard", "block")
    found = stage(met.groupBy("label", "size", "shard", "block").applyInArrow(link, "a long, b long, others long"), "vector-links")
    both = found.where("b is null").groupBy("a").agg(F.sum("others").alias("others"))
    pairs = found.where("b is not null").select("a", "b")
    roots = components(pairs)
    named = homes.select("label", "same", "v", "rep", "copies").join(both.withColumnRenamed("a", "rep"), "rep", "left")
    named = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = stage(
        named.select("label", "same", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")),
        "named",
    )
    out = rows.join(named, ["label", "same", "v"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
