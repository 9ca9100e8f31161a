"""The pipeline and the registered queries against brute force on the smallest tables."""

import re

import __spark_entry__ as contract
import corpus_pipeline
import numpy as np
import public_tokenizers
from fixtures import WORD, awkward, documents, entities, jaccard_groups, joined, measures, sha256
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def passes_rules(text):
    n, chars, symbols, dup_lines, repeated = measures(text)
    lines = sum(bool(WORD.search(line)) for line in (text or "").split("\n"))
    return not (
        n < 50
        or 100 * repeated > 50 * n
        or 10 * symbols > 3 * n
        or not 2 * n <= chars <= 20 * n
        or (lines >= 4 and 2 * dup_lines > lines)
        or 10 * (text or "").count("!") > 3 * n
    )


def without_personal_data(text):
    out, at = [], 0
    for kind, start, end in sorted(entities(text), key=lambda s: (s[1], -s[2])):
        if end > at:
            out += [text[at : max(start, at)], f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, SMALL)
    assert known.columns == docs.columns
    texts = {r.doc_id: r.text for r in known.collect()}
    dropped = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in texts}
    assert not [t for t in dropped.values() if passes_rules(t)], "a clean document was dropped"
    texts = {i: t for i, t in texts.items() if passes_rules(t)}
    groups = jaccard_groups(list(texts.items()))
    texts = {i: without_personal_data(t) for i, t in texts.items() if groups[i][1] == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    got: dict[int, int] = {}
    fill: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert got == expected
    assert max(fill.values()) <= 1024 and len(fill) <= sum(expected.values()) / 1024 + 2


def test_stages_take_awkward_rows_and_empty_tables(spark):
    for rows in (awkward(), []):
        docs = documents(spark, rows)
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, "")
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows), name
        kept = corpus_pipeline.one_of_each_group(spark, docs, "")
        if rows:
            ids = [r.doc_id for r in kept.collect()]
            assert len(ids) == len(set(ids))
            assert ids.count(None) == 1 and ids.count(6) == 1 and 7 not in ids and 9 not in ids
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_queries_over_whole_tables(spark):
    queries = contract.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    of = lambda n: queries[next(q for q in queries if re.match(rf"op{n}_", q))](spark, SMALL)
    joined_rows = {r.doc_id: (r.n_shingles, r.component_id) for r in of(1).collect()}
    assert joined_rows == jaccard_groups(list(docs.items()))
    personal = {r.doc_id: (r.base_sha256, r.spans) for r in of(9).collect()}
    assert {i: p[0] for i, p in personal.items()} == {i: sha256(joined(entities(t))) for i, t in docs.items()}
    for r in of(10).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == passes_rules(docs[r.doc_id])
    found = of(4).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert len(found) == len(docs) and np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.95
    scores = of(2).collect()
    assert len(scores) == len(docs) and all(r.predicted == int(r.score >= 0.3) for r in scores)
    assert sorted(r.doc_id for r in of(5).collect()) == sorted(docs) == sorted(r.doc_id for r in of(8).collect())


def test_every_operator_is_registered():
    names = contract.queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", q)) for q in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
