"""Functions and table functions that SQL text can call."""

import random

from pyspark.sql import functions as F

from strandframe.functions import cigar, registered
from strandframe.functions import sequence as S
from strandframe.operators import alignment


def test_table_functions_give_the_kmers_and_syncmers_of_each_row(spark):
    registered.register(spark)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ACGTacgtN", k=rng.randrange(0, 90)))) for i in range(60)] + [(60, None), (61, ""), (62, "ACGT"), (63, "ACGTé" * 9), (0, "ACGTACGTACGTACG")]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    for s, call in ((None, "sf_kmers(t.seq, 9)"), (5, "sf_syncmers(t.seq, 9, 5)")):
        got = spark.sql(f"SELECT id, pos, kmer FROM {{t}} t, LATERAL {call}", t=df)
        want = S.kmers(df, "id", "seq", 9, s)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
        assert spark.sql(f"SELECT id FROM {{t}} t, LATERAL {call}", t=df.where("false")).count() == 0
    plan = spark.sql("SELECT id, pos FROM {t} t, LATERAL sf_kmers(t.seq, 9)", t=df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "EvalPythonUDTF" in plan


def test_cigar_functions_equal_the_column_functions(spark):
    registered.register(spark)
    rows = [("5S10=2X3I4=7D1=5H",), ("10M",), ("",), (None,), ("3I2D",), ("0=",)]
    df = spark.createDataFrame(rows, "cigar string")
    ops = cigar.parse(F.col("cigar"))
    got = spark.sql("SELECT cigar, sf_query_length(cigar) AS q, sf_ref_span(cigar) AS r, sf_edit_distance(cigar) AS e, sf_identity(cigar) AS i FROM {t}", t=df)
    want = df.select("cigar", cigar.query_length(ops).alias("q"), cigar.reference_span(ops).alias("r"), cigar.edit_distance(ops).alias("e"))
    assert sorted(map(str, got.drop("i").collect())) == sorted(map(str, want.collect()))
    assert {r.cigar: r.i for r in got.collect()} == {"5S10=2X3I4=7D1=5H": 15 / 27, "10M": None, "": None, None: None, "3I2D": 0.0, "0=": None}


def test_alignment_from_sql(spark):
    registered.register(spark)
    rows = [("ACGTACGT", "ACGACGT"), ("", "AC"), (None, "A"), ("AAAA", "AAAA")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r.a, r.b): r.x for r in spark.sql("SELECT a, b, sf_align(a, b) AS x FROM {t}", t=df).collect()}
    for a, b in rows[:2] + rows[3:]:
        assert tuple(got[a, b]) == alignment.align(a, b)
    assert got[None, "A"].cigar is None
