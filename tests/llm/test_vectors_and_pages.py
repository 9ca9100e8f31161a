"""Embedding near-duplicates and archives against brute force and round trips."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from shopfloor.llm import hnsw, warc
from shopfloor.llm.files import opened

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def clustered(n, seed=0, dims=16, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((max(n // 6, 1), dims))
    x = centers[rng.integers(0, len(centers), n)] + 0.16 * rng.standard_normal((n, dims))
    return [(k, v.astype(np.float32).tolist(), int(k) % labels, "") for k, v in enumerate(x)]


def by_brute_force(rows, cosine):
    """{vec_id: (n_links, component_id)}."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= cosine) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(root, np.where(near, root[None], len(rows)).min(axis=1))
        if (new == root).all():
            break
        root = new
    return {i: (int(near[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("shard", [60, 8_192])
def test_links_equal_brute_force(spark, shard):
    rows = clustered(600)
    rows += [(1_000 + k, rows[0][1], rows[0][2], "") for k in range(40)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA), cosine=0.93, shard_size=shard).collect()
    truth = by_brute_force(rows, 0.93)
    assert sum(t[0] for t in truth.values()) > 500
    assert sum(r.n_links for r in got) >= 0.9 * sum(t[0] for t in truth.values())
    assert all(r.n_links <= truth[r.vec_id][0] for r in got)
    assert np.mean([r.component_id == truth[r.vec_id][1] for r in got]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2_000, 24))
    x = np.concatenate([x, x[:300] + 0.02 * rng.standard_normal((300, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Hnsw.from_bytes(hnsw.Hnsw(x, degree=2, beam=4).to_bytes())
    truth = int((x @ x.T >= 0.93).sum())
    found = sum(len(q) for q, _ in graph.within(x, 0.93, beam=2, audited=512, recall=0.95))
    assert found >= 0.9 * truth


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1)]
    rows += [(7, v, None), (8, v, None), (None, v, 1), (9, v, 1), (10, v, 1), (11, [2.0, 4.0], 1), (12, [1.0, 2.0, 0.0], 1), (13, v, 2)]
    frame = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    found = hnsw.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8, 12, 13)}
    assert got == {**alone, 9: (2, 9, True), 10: (2, 9, False), 11: (2, 9, False)}
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


PAGES = "page_id long, url string, html string, file string"


def pages():
    rows = [(k, f"http://h{k % 3}.example/{k}", "<p>" + "same" * (k % 4) + "</p>", "x") for k in range(40)]
    rows += [(50, None, None, None), (51, "a\r\nWARC-Type: x", "", "y"), (52, "u", "é\r\n\r\nWARC/1.0\r\n" * 3, "z"), (53, "u", "b" * 3_000_000, "z")]
    return rows + [rows[3], (None, "u", "<p></p>", "w")]


def test_archives_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.normalise(warc.write_archives(frame))
    got = warc.read_archives(manifest, with_payload=True).collect()
    assert len(got) == len(rows)
    payload = {i: (h or "").encode() for i, _, h, _ in rows}
    first = {}
    for i in sorted(i for i in payload if i is not None):
        first.setdefault(payload[i], i)
    for r in got:
        data = payload[r.page_id]
        response = first[data] == r.page_id
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == ("response" if response else "revisit")
        assert r.refers_to == (None if response else first[data])
        assert r.payload == (data if response else None)
    assert {r.url for r in got if r.page_id == 51} == {"a WARC-Type: x"}


def test_each_record_is_a_member_of_its_own(spark):
    frame = spark.createDataFrame(pages(), PAGES).coalesce(1)
    archives = warc.write_archives(frame)
    source = opened(archives.first().file).read()
    made = warc.normalise(archives).first()
    data, index = opened(made.file).read(), opened(made["index"]).read().splitlines()
    assert len(index) == made.n_records == len(pages())
    assert gzip.decompress(data) == gzip.decompress(source)
    assert data.count(b"\x1f\x8b\x08") >= made.n_records


def test_small_payloads_are_never_revisits(spark):
    frame = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], PAGES)
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.normalise(warc.write_archives(frame, least_bytes=3))).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_tables_and_damaged_streams(spark):
    empty = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_archives(warc.normalise(empty)).count() == 0
    whole = warc.serialised({"WARC-Type": "response"}, b"x" * 100)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(iter([whole[:-20]])))
    with pytest.raises(ValueError, match="not a record"):
        list(warc.records(iter([b"HTTP/1.1 200\r\n\r\n"])))
    many = gzip.compress(whole) + gzip.compress(whole)
    assert len(list(warc.records(warc.inflated(io.BytesIO(many))))) == 2
