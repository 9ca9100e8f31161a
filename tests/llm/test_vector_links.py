"""Links of embedding shards: dense clusters and audits, against brute force."""

import time

import numpy as np
import pytest
from test_vectors_and_pages import SCHEMA, by_brute_force, clustered

from shopfloor.llm import hnsw


def near_copies(n, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    center = rng.standard_normal(dims)
    return [(10_000 + k, (center + 0.01 * rng.standard_normal(dims)).astype(np.float32).tolist(), 0, "") for k in range(n)]


def test_a_cluster_of_near_copies_makes_no_row_a_pair(spark, monkeypatch):
    rows = clustered(300) + near_copies(400)
    staged = {}

    def counted(frame, label, stage=hnsw.stage):
        out = stage(frame, label)
        staged[label] = out.count()
        return out

    monkeypatch.setattr(hnsw, "stage", counted)
    got = hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA), cosine=0.93, shard_size=100).collect()
    truth = by_brute_force(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id >= 10_000} == {i: t for i, t in truth.items() if i >= 10_000}
    # 79 800 pairs of the cluster; a vector has a count and an edge at most for each shard it meets.
    assert max(staged.values()) < 2 * len(rows) * 8


@pytest.mark.parametrize("same", [True, False])
def test_stars_span_what_is_linked(same):
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, m = rng.integers(1, 40, 2)
        m = n if same else m
        links = rng.random((n, m)) < 0.04
        if same:
            links |= links.T
        copies = rng.integers(1, 9, m)
        assert (hnsw.weighed(links, copies) == (links * copies).sum(axis=1)).all()
        part = {}
        for k, (_, rows, columns) in enumerate(hnsw.stars_of(links)):
            assert len(set(rows.tolist())) == len(rows) and len(set(columns.tolist())) == len(columns)
            part |= {("a", i): k for i in rows.tolist()} | {("b", j): k for j in columns.tolist()}
        assert set(part) == {("a", i) for i in np.flatnonzero(links.any(axis=1)).tolist()} | {("b", j) for j in np.flatnonzero(links.any(axis=0)).tolist()}
        assert all(part["a", i] == part["b", j] for i, j in np.argwhere(links).tolist())


def test_rare_pairs_of_another_shard_are_audited():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2_000, 24))
    asking = rng.standard_normal((640, 24))
    # None of the audited queries, every tenth, has a partner.
    asking[5::10] = x[:64] + 0.02 * rng.standard_normal((64, 24))
    x, asking = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, asking))
    graph = hnsw.Hnsw(x, degree=2, beam=4)
    truth = int((asking @ x.T >= 0.93).sum())
    assert truth >= 64 and not (asking[::10] @ x.T >= 0.93).any()
    assert sum(len(q) for q, _ in graph.within(asking, 0.93, beam=2)) >= 0.98 * truth


class FindsItself(hnsw.Hnsw):
    """A graph whose beams hold nothing but the nearest vertex."""

    def search(self, queries, beam):
        near = queries @ self.vectors.T
        ids = np.full((len(queries), beam), -1)
        ids[:, 0] = near.argmax(axis=1)
        return ids, np.where(ids >= 0, near.max(axis=1)[:, None], -2.0)


def test_matches_of_vectors_with_themselves_are_no_evidence():
    x = np.random.default_rng(6).standard_normal((640, 24))
    x[5] = x[0] + 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # 64 audited vectors find themselves, and one of them misses its partner.
    links = hnsw.linked(FindsItself(x), None, 0.93)
    assert np.argwhere(links).tolist() == [[0, 5], [5, 0]]


def test_a_dense_cluster_in_one_shard_is_quick():
    """Every vector links with nearly every other: beams stop widening and the shard is multiplied through."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=64)
    x = centre / np.linalg.norm(centre) + 0.02 * rng.normal(size=(3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Hnsw(x)
    graph.width = graph.audit(x, 0.93, hnsw.BEAM, own_at=0)
    began = time.perf_counter()
    links = hnsw.linked(graph, None, 0.93)
    assert time.perf_counter() - began < 60
    expected = x @ x.T >= 0.93
    np.fill_diagonal(expected, False)
    assert (links == expected).mean() > 0.9999
