"""Alignment-like inputs made of the driver's tables, as expressions that both SQL dialects read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import AS_BASES, LETTERS
from ..session import table

LEN = "cast(l_quantity as bigint)"
ALIGNMENT = {
    "read": "l_orderkey",
    "rank": "cast(l_linenumber as bigint)",
    "chrom": "concat('chr', l_suppkey % 5)",
    "reverse": "l_linestatus = 'F'",
    "mapq": "l_partkey % 61",
    "qs": "(l_linenumber - 1) * 60 + l_suppkey % 7",
    "qe": f"(l_linenumber - 1) * 60 + l_suppkey % 7 + {LEN}",
    "rs": "(l_partkey * 7) % 10000",
    "re": f"(l_partkey * 7) % 10000 + {LEN}",
    "read_len": "cast(500 as bigint)",
    "cigar": f"concat(l_linenumber, 'S', {LEN}, '=', cast(round(l_discount * 100) as bigint) + 1, 'X', {LEN} + 3, '=', l_suppkey % 9 + 1, 'I', {LEN}, '=', l_partkey % 40 + 1, 'D', 5, '=', l_linenumber + 1, 'H')",
}
#: A second aligner: it misses some reads and places some records elsewhere.
MOVED = "(case when l_partkey % 6 = 0 then 40 when l_partkey % 11 = 0 then 900 else 0 end)"
OTHER = ALIGNMENT | {"rs": f"(l_partkey * 7) % 10000 + {MOVED}", "re": f"(l_partkey * 7) % 10000 + {LEN} + {MOVED}", "chrom": "concat('chr', (l_suppkey + (case when l_partkey % 13 = 0 then 1 else 0 end)) % 5)"}
OTHER_WHERE, FIRST_WHERE = "l_orderkey % 9 <> 0", "l_orderkey % 7 <> 0"
SEQ = f"translate(coalesce(text, ''), '{LETTERS}', '{AS_BASES}')"


def columns(spec: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in spec.items())


#: CTEs for the SQL side.
ALN = f"aln AS (SELECT {columns(ALIGNMENT)} FROM lineitem)"
LHS = f"lhs AS (SELECT {columns(ALIGNMENT)} FROM lineitem WHERE {FIRST_WHERE})"
RHS = f"rhs AS (SELECT {columns(OTHER)} FROM lineitem WHERE {OTHER_WHERE})"


def alignments(spark: SparkSession, sf_dir: str, spec: dict[str, str] = ALIGNMENT, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(where).selectExpr(*(f"{e} AS {n}" for n, e in spec.items()))


def sequences(spark: SparkSession, sf_dir: str, name: str, id_col: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(f"{id_col} AS id", f"{SEQ} AS seq")


#: Line items with one row for each order and line number, which the table does not promise.
LINES = "(SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES as a DataFrame; of ``l_linestatus`` it keeps how the greatest compares with F: ``A`` stands for all before it, ``O`` for all after.

    Spark hashes a maximum of numbers and booleans, but sorts all rows for one of strings.
    """
    status = F.col("l_linestatus")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")), F.max(status > "F").alias("_after"), F.max(status == "F").alias("_is"))
    held = F.when(F.col("_after"), "O").when(F.col("_is"), "F").when(F.col("_is").isNotNull(), "A")
    return sums.withColumn("l_linestatus", held).drop("_after", "_is")
