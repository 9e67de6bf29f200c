"""The stages of the corpus pipeline, each against what its operator says row by row."""

from collections import Counter

import pytest

import corpus_pipeline
from strandframe.llm import exact_dedup, mixing, simhash, toxicity
from strandframe.session import materialize, table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, DATA, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        found.append(docs)
    return found


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mix", "packing"]


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxic_documents_go(spark, steps):
    scores = toxicity.toxicity_scores(steps[0], table(spark, DATA, "labels")).where("predicted = 0")
    assert ids(steps[1]) == ids(scores)


def test_copies_go(steps):
    assert ids(steps[2]) == ids(exact_dedup.exact_dedup(steps[1]).where("kept"))


def test_one_of_each_near_group_stays(steps):
    groups = simhash.simhash_groups(steps[2])
    assert ids(steps[3]) == Counter({r[0]: 1 for r in groups.select("component_id").distinct().collect()})


def test_the_mix_holds_the_words_taken(steps):
    taken = {r.doc_id: r.taken for r in mixing.mix_report(steps[3]).collect() if r.taken}
    words = Counter()
    for r in steps[4].collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert words == Counter(taken)


def test_packing_is_whole(steps):
    pieces = steps[5].collect()
    sizes = Counter()
    for r in pieces:
        sizes[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 and n < 2048 for n in sizes.values())
    rows = ids(steps[4])
    assert set(rows) == {r.doc_id for r in pieces}
    starts = Counter(r.doc_id for r in pieces if r.start == 0)
    assert starts == rows


def test_run_gives_the_last_stage(spark, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "doc_tokens", "start").where("start = 0").collect())) == Counter(map(tuple, steps[5].select("doc_id", "doc_tokens", "start").where("start = 0").collect()))


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words here", None, None, None)]
    docs = spark.createDataFrame(rows, table(spark, DATA, "documents").schema)
    for start in (docs, docs.limit(0)):
        step = start
        for name, stage in corpus_pipeline.STAGES:
            step = materialize(stage(spark, step, DATA), name)
        # one row without words goes in the mix; the other is taken once whole and once in part
        assert step.count() == (2 if start is docs else 0)
