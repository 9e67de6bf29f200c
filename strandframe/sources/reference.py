"""References as tables of blocks: read from FASTA in splits, written so that a range reads its own files only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import localization, reference_group
from ..operators.reference import WIDTH, windows
from ..session import materialize, prepare

#: Blocks that stand together in one folder, and folders; a folder is told by chromosome and group, so there are as many for a million scaffolds as for one chromosome.
GROUP, SHELVES = 64, 256
_PIECE = "file string, split long, piece long, name string, description string, offset long, bases string"


def _pieces(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Stretches of bases of each split of the files, in order; ``name`` is null before the split's first header, offsets count from there."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        name = description = None
        number = offset = size = 0
        held: list[str] = []
        out: list[tuple] = []

        def put() -> None:
            nonlocal number, offset, size, held
            out.append((*at, number, name, description, offset, "".join(held)))
            number, offset, size, held = number + 1, offset + size, 0, []

        for batch in batches:
            for line, *place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != tuple(place):
                    if at is not None:
                        put()
                    at, name, description, number, offset, size, held = tuple(place), None, None, 0, 0, 0, []
                if line.startswith(">"):
                    put()
                    head = line[1:].strip().split(None, 1)
                    name, description, offset = head[0] if head else "", head[1].strip() if len(head) > 1 else "", 0
                    continue
                bases = "".join(line.split()).upper()
                held.append(bases)
                size += len(bases)
                if size >= width:
                    put()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES], names=[f.split()[0] for f in _PIECE.split(", ")])
            out = []
        if at is not None:
            put()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=[f.split()[0] for f in _PIECE.split(", ")])

    return lines.mapInArrow(run, _PIECE)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def read_fasta_blocks(spark: SparkSession, path: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``blocks (chrom, block, bases)`` and ``contigs (name, description, localization, reference_group, length)`` of FASTA files.

    A plain file is read in as many splits as Spark cuts it into, whatever the length of its contigs: each split
    counts its bases, the splits' totals (one row each) carry names and offsets on, and pieces are cut at the
    blocks' borders. A compressed file is one split. Bases come in upper case; what stands before the first
    header is left out, and so are contigs' blocks without bases. Names must differ.
    """
    prepare(spark)
    pieces = materialize(_pieces(spark, path, width), "fasta")
    size = F.length("bases").cast("long")
    last = F.max(F.when(F.col("name").isNotNull(), F.struct("piece", "name", "description")))
    tail = F.max(F.struct("piece", (F.col("offset") + size).alias("upto")))["upto"]
    splits = pieces.groupBy("file", "split").agg(last.alias("last"), tail.alias("tail"))
    by_file = Window.partitionBy("file").orderBy("split")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    headed = splits.withColumn("_c", F.count("last").over(by_file))
    run_on = headed.withColumn("_sum", F.sum("tail").over(Window.partitionBy("file", "_c").orderBy("split")))
    carried = run_on.select("file", "split", F.coalesce(F.lag("_sum").over(by_file), F.lit(0)).alias("_base"), F.last("last", ignorenulls=True).over(before).alias("_from"))
    both = pieces.join(carried, ["file", "split"]).select(
        F.coalesce("name", "_from.name").alias("name"), F.coalesce("description", "_from.description").alias("description"), (F.col("offset") + F.when(F.col("name").isNull(), F.col("_base")).otherwise(0)).alias("start"), "bases", size.alias("n")
    ).where("name is not null")
    contigs = both.groupBy("name").agg(F.first("description").alias("description"), F.max(F.col("start") + F.col("n")).alias("length"))
    contigs = contigs.select("name", "description", localization(F.col("name"), F.col("description")).alias("localization"), reference_group(F.col("description")).alias("reference_group"), "length")
    touched = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width))).alias("block")
    cut = both.where("n > 0").select(F.col("name").alias("chrom"), "start", "bases", "n", touched)
    first = F.greatest(F.col("block") * width - F.col("start"), F.lit(0))
    part = F.substring("bases", (first + 1).cast("int"), (F.least((F.col("block") + 1) * width - F.col("start"), F.col("n")) - first).cast("int"))
    parts = cut.select("chrom", "block", F.struct("start", part.alias("bases")).alias("p")).groupBy("chrom", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("chrom", "block", F.array_join(F.transform("p", lambda x: x["bases"]), "").alias("bases")), contigs


def save_reference(blocks: DataFrame, contigs: DataFrame, path: str, width: int = WIDTH, shelves: int = SHELVES, group: int = GROUP) -> None:
    """Blocks as parquet in folders by chromosome and group of blocks, sorted, with the contigs and the parameters beside them."""
    shelf = (F.crc32(F.concat_ws(":", "chrom", F.floor(F.col("block") / group).cast("string"))) % shelves).cast("int")
    blocks.withColumn("shelf", shelf).repartition("shelf").sortWithinPartitions("shelf", "chrom", "block").write.partitionBy("shelf").parquet(f"{path}/blocks")
    contigs.write.parquet(f"{path}/contigs")
    blocks.sparkSession.createDataFrame([(1, width, shelves, group)], "version int, width int, shelves int, group int").coalesce(1).write.json(f"{path}/metadata")


def load_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """``blocks, contigs, width`` of a saved reference."""
    meta = spark.read.json(f"{path}/metadata").first()
    if meta.version != 1:
        raise ValueError(f"the reference has version {meta.version}")
    return spark.read.parquet(f"{path}/blocks").drop("shelf"), spark.read.parquet(f"{path}/contigs"), meta.width


def fetch_range(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """One row ``seq``: the bases of a range of a saved reference, clamped to the contig; empty where the range is, or on an unknown contig.

    Only the folders of the range's blocks are read.
    """
    meta = spark.read.json(f"{path}/metadata").first()
    low, high = max(start, 0) // meta.width, max(end - 1, 0) // meta.width
    shelves = sorted({zlib.crc32(f"{chrom}:{g}".encode()) % meta.shelves for g in range(low // meta.group, high // meta.group + 1)})
    held = spark.read.parquet(f"{path}/blocks").where(F.col("shelf").isin(shelves) & (F.col("chrom") == chrom) & F.col("block").between(low, high))
    wanted = spark.createDataFrame([(0, chrom, start, end)], "id int, chrom string, start long, end long")
    return windows(wanted, held, ["id"], width=meta.width).select(F.col("bases").alias("seq"))
