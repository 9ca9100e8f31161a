"""Operators on whole texts against plain restatements of their contracts."""

import random

import numpy as np
import pytest
from fixtures import awkward, documents, entities, jaccard_groups, joined, measures, sha256
from pyspark.sql import functions as F

from shopfloor.llm import langid, ngram_join, pii, quality, rules
from shopfloor.llm.components import components
from shopfloor.llm.shingles import shingle_sets


def near_copies(n=120, seed=7):
    """Groups of near copies around the threshold, a passage that all share, and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for group in range(6):
        base = [word() for _ in range(90)]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words) + (" " + passage if group % 2 else "")))
    rows += [(len(rows) + k, rows[0][1]) for k in range(30)]
    return rows


def groups_of(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_shingle_sets_count_distinct_shingles():
    found = shingle_sets(["a b c d e f", "A B\tC  D\nE f", "a b", None, "", "w " * 50, "x" * 200 + " a b c d", "é à ü ö ß ñ"])
    assert [len(s) for s in found] == [2, 2, 1, 0, 0, 1, 1, 2]
    assert (found[0] == found[1]).all()
    short = shingle_sets(["a b", "a b ", "a  b", "a c", "b a", "ab"])
    assert len({int(s[0]) for s in short}) == 4


@pytest.mark.parametrize("hot", [0.002, 0.05])
def test_join_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_SHARE", hot)
    monkeypatch.setattr(ngram_join, "REPORTED", 2)
    rows = near_copies()
    docs = documents(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    assert groups_of(ngram_join.jaccard_components(docs)) == jaccard_groups(rows)


def test_join_takes_awkward_rows(spark):
    rows = awkward()
    found = ngram_join.jaccard_components(documents(spark, rows))
    assert found.count() == len(rows)
    expected = jaccard_groups([(i, t) for i, t, _ in rows])
    got = groups_of(found)
    assert got.pop(None) == (7, None)
    assert got == expected
    assert got[7] == (1, 6) and got[9] == got[8] and got[2] == (0, 2)
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0


def test_copies_end_where_sets_are_put_together(spark, monkeypatch):
    """Only the smallest id of a set becomes a candidate, without a join that moves the sets once more."""
    made, stage = {}, ngram_join.stage

    def seen(frame, label):
        made[label] = stage(frame, label), frame._jdf.queryExecution().optimizedPlan().toString()
        return made[label][0]

    monkeypatch.setattr(ngram_join, "stage", seen)
    monkeypatch.setattr(ngram_join, "COPY_SHARE", 1.0)  # every copy is placed
    monkeypatch.setattr(ngram_join, "MARKED_TOGETHER", 10)
    rows = near_copies()
    docs = documents(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    assert groups_of(ngram_join.jaccard_components(docs)) == jaccard_groups(rows)
    sets, plan = made["candidates"]
    assert "Join" not in plan
    found = {r.rep: r.n for r in sets.collect()}
    assert len(found) == sets.count() and set(found) <= {r.rep for r in made["sets"][0].collect()}
    assert 0 in found and not set(found) & {i for i, t in rows[1:] if t == rows[0][1]}
    assert all(n == len(shingle_sets([rows[i][1]])[0]) for i, n in found.items())


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rule_measures(spark):
    texts = [t for _, t, _ in awkward()]
    texts += ["a a a", "a a a a", "a b a b a", "a b c a b c", "x\nx\n\n \nx", "a b c d", "#*$ %&| <>", "a b c\nz a b c", "one\n", "a b"]
    docs = documents(spark, [(k, t, "en") for k, t in enumerate(texts)])
    got = {r.doc_id: tuple(r[m] for m in rules.MEASURES) for r in rules.measured(docs).collect()}
    assert got == {k: measures(t) for k, t in enumerate(texts)}


def test_the_order_of_rules_does_not_change_the_verdict(spark):
    texts = [t for _, t, _ in awkward()] + ["w" + str(k % 60) + " " + "x y " * k for k in range(60)] + ["a*** " * 60, "GO!! " * 60]
    docs = documents(spark, [(k, t, "en") for k, t in enumerate(texts)])
    kept = {r.doc_id for r in rules.apply_rules(docs).where("rejected_by is null").collect()}
    backwards = {r.doc_id for r in rules.apply_rules(docs, rules.RULES[::-1]).where("rejected_by is null").collect()}
    single = set(range(len(texts)))
    for rule in rules.RULES:
        single -= {r.doc_id for r in docs.where(rule.rejects(F.coalesce("text", F.lit("")))).collect()}
    assert kept == backwards == single
    assert rules.apply_rules(documents(spark, [])).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    rule = lambda name: rules.Rule(name, None)
    found = [rules.Estimate(rule("dear"), 2.0, 100), rules.Estimate(rule("cheap"), 0.1, 50), rules.Estimate(rule("idle"), 0.01, 0)]
    assert [r.name for r in rules.ordered(found)] == ["cheap", "dear", "idle"]


def test_rules_stay_native(spark):
    plan = rules.apply_rules(rules.measured(documents(spark, awkward())))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PERSONAL = [
    "a.b@c.d@e.f and @x.y me@host bad@-.- q@w.e.r.t.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "4111-1111 1111-1111 4111111111111112 0000 0000 0000 12",
    "+1 (301) 555-0346 +49.30.123456 +12 +1234567890123456 ++1 23456789",
    "0" * 5_000 + ".1.1.1 " + "9" * 5_000 + "." + "9" * 5_000 + ".1.1 " + "a" * 5_000 + "@" + "b" * 5_000,
]


def test_fixed_patterns():
    for text in PERSONAL + [t for _, t, _ in awkward()]:
        assert [(k, s, e) for k, s, e in pii.base_spans(text)] == entities(text), repr(text)[:80]


def test_personal_data_digest(spark):
    rows = [(k, t, "en") for k, t in enumerate(PERSONAL)] + [(i if i is None else 100 + i, t, lang) for i, t, lang in awkward()]
    got = pii.find_personal_data(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        spans = entities(texts[r.doc_id])
        assert r.base_sha256 == sha256(joined(spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    known = [(k, f"please call us on +1 (301) 555-{1000 + k} today", "en") for k in range(12)]
    unseen = [(50, "please call us on 555-77-1234 today", "en"), (51, "the lot 555-77-9999 is sold", "en")]
    frame = pii.find_personal_data(documents(spark, known + unseen)).withColumn("spans", pii.spans_text(F.col("found")))
    got = {r.doc_id: r.spans for r in frame.collect()}
    assert got[50] == "phone:18:29" and got[51] == ""
    text = {r.doc_id: r.text for r in pii.masked(documents(spark, known + unseen)).collect()}
    assert text[50] == "please call us on [phone] today" and text[0] == text[50] and text[51] == unseen[1][1]


def test_masking_keeps_rows_and_columns(spark):
    docs = documents(spark, awkward())
    clean = pii.masked(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[12] == "mail [email], [phone] or [card] at [ip]" and text[1] is None and text[2] == ""


LANGUAGES = {"aa": "ba na ra ta la", "bb": "xu qi zo vy wu", "cc": "schrift pfund zwerg"}


def spoken(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(LANGUAGES))
        syllables = LANGUAGES[lang].split()
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        rows.append((k, " ".join(words), lang))
    return rows


def test_gradients_are_those_of_the_loss():
    net = langid.Network.fresh(["a", "b", "c"], seed=1)
    rng = np.random.default_rng(0)
    rows, labels = rng.integers(97, 123, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.probabilities(rows)[np.arange(5), labels]).mean()
    for parameter, gradient in zip(net.parameters(), net.gradients(rows, labels)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept = parameter[at]
        parameter[at] = kept + 1e-2
        up = loss()
        parameter[at] = kept - 1e-2
        down = loss()
        parameter[at] = kept
        assert abs((up - down) / 2e-2 - gradient[at]) < 0.1 * abs(gradient[at]) + 1e-3


def test_training_rows_are_bounded_whatever_the_copies(spark):
    rows = [("one and the same text", "en")] * 600 + [(f"text number {k}", "en") for k in range(300)] + [("ein text", "de"), (None, "de"), ("x", None)]
    drawn = langid.training_rows(spark.createDataFrame(rows, "text string, lang string"), per_language=40)
    assert len(drawn) == len(set(drawn)) and [sum(l == k for _, l in drawn) for k in ("en", "de")] == [40, 1]
    everything = langid.training_rows(spark.createDataFrame(rows, "text string, lang string"), per_language=1000)
    assert len(everything) == 302 and ("one and the same text", "en") in everything


def test_language_of_unseen_texts(spark):
    rows = spoken(400)
    found = langid.identify(documents(spark, rows), learn=F.col("doc_id") % 4 != 0).where("doc_id % 4 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(spark):
    rows = awkward() + [(900, "123 456 !!", "en")]
    found = langid.identify(documents(spark, rows))
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert found.count() == len(rows)
    for i in (1, 2, 3, 900):
        assert got[i] == ("und", 0.0)
    assert got[4][0] != "und"
    unlabelled = langid.identify(documents(spark, [(1, "some text", None)])).collect()
    assert unlabelled[0].lang_pred == "und"
    assert langid.identify(documents(spark, [])).count() == 0


def test_windows_cover_the_whole_text():
    text = "a" * 1_000 + "B"
    rows = langid.windows(text)
    assert rows.size >= 1_001 and rows.ravel()[1_000] == ord("b") and (rows.ravel()[1_001:] == 0).all()


def test_quality_is_learned_from_labels(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for k in range(300):
        good = rng.random() < 0.8
        text = " ".join(word() + ("" if good else rng.choice(["***", "!!", "&&&"])) for _ in range(rng.randrange(60, 200)))
        rows.append((k, text, "en"))
        labels.append((k, int(good), 0))
    marked = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (9_999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows), marked, F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").collect()
    truth = {i: q for i, q, _ in labels}
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in got]) > 0.95


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none, F.lit(True)).collect()
    assert len(got) == len(awkward()) and {r.score for r in got} == {0.5}
    few = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, few, F.lit(True)).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.classify(documents(spark, []), few, F.lit(True)).count() == 0


def test_sql_of_the_quality_rules():
    import duckdb
    import pyarrow as pa

    from shopfloor.llm.queries import SQL

    texts = [t for _, t, _ in awkward()] + ["", "a a a a", "x\nx\n\n \nx\nx", "w " * 60, "a b c\nz a b c", " ".join(f"w{k}" for k in range(60))]
    with duckdb.connect() as con:
        con.register("documents", pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())}))
        got = {r[0]: r[1:] for r in con.execute(SQL["op10_quality_rules"]).fetchall()}
    assert {k: r[:5] for k, r in got.items()} == {k: measures(t) for k, t in enumerate(texts)}
    assert [got[k][6] for k in (len(texts) - 1, len(texts) - 3)] == [True, False]
