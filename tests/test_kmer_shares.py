"""K-mers of one document only, counted without a join back to their loci."""

import re

import duckdb
import pytest

from strandframe.plans import QUERIES, SQL


def test_unique_kmers_exchange_no_locus(spark, tmp_path):
    texts = [(1, "a" * 21 + "bcd"), (2, "b" * 20), (3, "b" * 20), (None, "cdab" * 5 + "c"), (4, "short"), (5, None), (6, "d" * 19 + "a"), (6, "d" * 20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["unique_vs_repeat"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.unique_kmers, r.repeat_kmers) for r in df.collect()}
    assert got == {1: (3, 2), 2: (0, 1), 3: (0, 1), None: (2, 0), 6: (2, 0)}


@pytest.mark.parametrize("name", ["sql_kmers_lateral", "library_annotate", "annotate_both_strands"])
def test_totals_exchange_no_kmer(spark, tmp_path, name):
    long = "the lazy dog jumped over a fox, and so on and on it went " * 3
    texts = [(1, long), (2, "abcd" * 30), (1, "abcd" * 12 + long), (3, None), (4, "short"), (None, long), (None, "dcba" * 9), (5, long[20:] * 90)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, long), (8, "abcd" * 12), (8, "dcba" * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[doc_id#\d+L?\], \[doc_id|Aggregate \[doc_id#\d+L?, kmer|Aggregate \[id#\d+L?\], \[id.*distinct", plan)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(db.execute(SQL[name]).fetchall(), key=key)


def test_overlap_splits_look_seeds_up_once(spark, tmp_path):
    passage = "the lazy dog jumped over a fox and so on and on it went "
    spark.createDataFrame([(1, passage[:40] + passage[30:]), (2, passage * 2), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = QUERIES["overlap_splits"](spark, str(tmp_path))
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()  # seeds are read back, not looked up for each use
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = (sorted(map(tuple, x)) for x in (df.collect(), db.execute(SQL["overlap_splits"]).fetchall()))
    assert got and len(got) == len(want) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(got, want))
