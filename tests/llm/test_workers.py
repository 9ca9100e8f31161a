"""What stays in a Python worker when the tasks of other operators come."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
from fixtures import documents
from pyspark import cloudpickle

from shopfloor.llm import langid, ngram_join, packing, pii, shingles, units

BYTES = public_tokenizers.path("byte_bpe_50k.json")


class At:
    """The context of a task."""

    get = classmethod(lambda cls: cls)
    partitionId = classmethod(lambda cls: 0)


class Task:
    """A frame that hands out the function its worker would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = cloudpickle.loads(cloudpickle.dumps(run))  # as it comes to a worker
        return self


def rows():
    return pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["a b c d e f", None, "a b"])], names=["doc_id", "text"])


def remembered():
    return [len(e.slot) for e in units.kept(units.ENCODERS).values()]


def test_a_task_of_the_join_begins_without_the_units_of_the_tokenizer(spark):
    units.encoder(BYTES, 1_000).encode(["one two three"])
    assert remembered() == [3]
    found = list(ngram_join.signatures(Task(), 5, "doc_id", "text").run(iter([rows()])))
    assert found[0].column("n_shingles").to_pylist() == [2, 0, 1]
    assert remembered() == []


def test_tasks_of_one_operator_share_what_it_remembers(spark, monkeypatch):
    units.encoder(BYTES, 1_000).encode(["one two three"])
    monkeypatch.setattr(packing, "TaskContext", At)
    pack = packing._pieces(Task(), BYTES, 2, 1024, "doc_id", "text", 1_000).run
    for _ in range(2):
        assert sum(len(b) for b in pack(iter([rows()]))) == 3
    assert remembered() == [3 + 6]


def test_workers_of_all_stages_in_a_row(spark):
    texts = [f"word{k} is said to {k * 7} people here and there by someone@example.org" for k in range(40)]
    docs = documents(spark, [(k, t, "en") for k, t in enumerate(texts)])
    for _ in range(2):
        assert packing.pack_documents(docs, BYTES).count() == len(texts)
        assert langid.identify(docs).where("lang_pred is null").count() == 0
        assert ngram_join.jaccard_components(docs).count() == len(texts)
        assert pii.masked(docs).where("text like '%[email]%'").count() == len(texts)


def test_memory_of_shingles_follows_the_sets_not_the_words():
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(600)) for _ in range(700)] + [None, "", "a b"]
    whole = [shingles.shingle_sets([t])[0] for t in texts]
    tracemalloc.start()
    found = shingles.shingle_sets(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f.tolist() for f in found] == [w.tolist() for w in whole]
    assert most < 5 * sum(f.nbytes for f in found)  # 15 times when all words are hashed at once
    assert shingles.shingle_sets([]) == []
