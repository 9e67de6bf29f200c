"""Readers and writers of sequence, interval, alignment and variant files as DataFrames."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions.scalars import localization, reference_group, repeat_coverage
from ..operators.intervals import merge
from ..session import prepare

OPENERS = {b"\x1f\x8b": gzip.decompress, b"BZh": bz2.decompress, b"\xfd7zXZ\x00": lzma.decompress}


def decompress(data: bytes) -> bytes:
    """Contents of a gzip, bzip2 or xz file, told by its first bytes; others as they are."""
    return next((f(data) for magic, f in OPENERS.items() if data.startswith(magic)), data)


def read_fasta(spark: SparkSession, path: str, primary_only: bool = False) -> DataFrame:
    """``name, description, localization, reference_group, length, seq`` (upper case), one row for each contig; gzip as Spark reads it."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s+", ""))
    rows = text.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), seq.alias("seq"))
    rows = rows.select("name", "description", localization(F.col("name"), F.col("description")).alias("localization"), reference_group(F.col("description")).alias("reference_group"), F.length("seq").cast("long").alias("length"), "seq")
    return rows.where("localization = 'Chromosome'") if primary_only else rows


def fetch(contigs: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Bases of a range, clamped to the contig; empty where the range is."""
    return contigs.where(F.col("name") == chrom).select(F.substring("seq", max(start, 0) + 1, max(end - max(start, 0), 0)).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, qual``; gzip, bzip2, xz or plain. A record that is cut off or does not begin with @ is an error.

    A file is one task; cut large files with write_fastq_chunks first.
    """
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                lines = decompress(content.as_py()).decode("utf-8", "replace").replace("\r\n", "\n").rstrip("\n").split("\n")
                if lines == [""]:
                    continue
                if len(lines) % 4 == 3:
                    lines.append("")  # an empty quality line at the end
                if len(lines) % 4:
                    raise ValueError("a FASTQ file ends within a record")
                for at in range(0, len(lines), 40_000):
                    part = lines[at : at + 40_000]
                    if any(not x.startswith("@") for x in part[::4]) or any(not x.startswith("+") for x in part[2::4]):
                        raise ValueError("a FASTQ record does not begin with @ or lacks its +")
                    if any(len(x) != len(y) for x, y in zip(part[1::4], part[3::4])):
                        raise ValueError("a FASTQ record has not as many qualities as bases")
                    yield pa.RecordBatch.from_arrays([pa.array([(x[1:].split() or ["unnamed"])[0] for x in part[::4]]), pa.array(part[1::4]), pa.array(part[3::4])], names=["name", "seq", "qual"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, seq string, qual string")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed fields, positions from 0 as ``start`` and ``mate_start``, and ``tags``, a map of ``type:value``; header lines and short lines are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).where(F.size(f) >= 11)
    tags = F.map_from_entries(F.transform(F.slice(f, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1 << 30))))
    return rows.select(
        f[0].alias("read"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        f[6].alias("mate_chrom"), (f[7].cast("long") - 1).alias("mate_start"), f[8].cast("long").alias("template"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"),
    )


def region(alignments: DataFrame, chrom: str) -> DataFrame:
    """Mapped, primary or supplementary, unflagged records of a contig."""
    return alignments.where((F.col("chrom") == chrom) & (F.col("flag").bitwiseAND(0x704) == 0))


def write_sam(records: DataFrame, contigs: DataFrame, path: str, program: str = "strandframe", groups: DataFrame | None = None, by_place: bool = True) -> None:
    """SAM text, a header in its first file, in coordinate order unless ``by_place`` is off. Records as read_sam gives them.

    Mate columns may be missing; null fields are written as the format says (``*``, 0 or 255). ``groups
    (id, sample)`` become read group lines.
    """
    spark = records.sparkSession
    line = lambda rows, o, c: rows.select(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c)).alias("value"), F.lit(o).alias("o"), F.lit("").alias("c"), F.monotonically_increasing_id().alias("p"))
    order = "coordinate" if by_place else "unsorted"
    head = [line(spark.range(1), 0, [f"@HD\tVN:1.6\tSO:{order}"]), line(contigs.orderBy("name"), 1, ["@SQ\tSN:", F.col("name"), "\tLN:", F.col("length").cast("string")]), line(spark.range(1), 3, [f"@PG\tID:{program}\tPN:{program}"])]
    if groups is not None:
        head.append(line(groups.orderBy("id"), 2, ["@RG\tID:", F.col("id"), "\tSM:", F.col("sample")]))
    have = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in records.columns else F.lit(other)
    place = lambda c: F.coalesce((F.col(c) + 1).cast("string"), F.lit("0")) if c in records.columns else F.lit("0")
    tags = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t")
    body = F.concat_ws("\t", have("read", "*"), have("flag", "0"), have("chrom", "*"), place("start"), have("mapq", "255"), have("cigar", "*"), have("mate_chrom", "*"), place("mate_start"), have("template", "0"), have("seq", "*"), have("qual", "*"), F.nullif(tags, F.lit("")))
    if by_place:  # contigs in the header's order, records without one last
        known = contigs.select(F.col("name").alias("_name"), F.row_number().over(Window.orderBy("name")).cast("string").alias("_n"))
        rows = records.join(F.broadcast(known), F.col("chrom") == F.col("_name"), "left").select(body.alias("value"), F.lit(4).alias("o"), F.coalesce(F.lpad("_n", 9, "0"), F.lit("~")).alias("c"), F.coalesce("start", F.lit(0)).alias("p"))
    else:
        rows = records.select(body.alias("value"), F.lit(4).alias("o"), F.lit("").alias("c"), F.monotonically_increasing_id().alias("p"))
    for part in head:
        rows = rows.unionByName(part)
    rows.repartitionByRange("o", "c", "p").sortWithinPartitions("o", "c", "p").select("value").write.text(path)


def read_bed(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    """``chrom, start, end`` (and ``name, score, strand`` if unmerged); track, browser and comment lines are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).where(F.size(f) >= 3)
    rows = rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"), F.get(f, F.lit(4)).alias("score"), F.coalesce(F.get(f, F.lit(5)), F.lit("+")).alias("strand"))
    return merge(rows, ["chrom"]).select("chrom", "start", "end") if merged else rows


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """BED6 whose names are ``name|class|family``; other rows are left out."""
    parts = F.split("name", r"\|", 3)
    return read_bed(spark, path, merged=False).where(F.size(parts) == 3).select("chrom", "start", "end", parts[0].alias("rep_name"), parts[1].alias("rep_class"), parts[2].alias("rep_family"), "strand")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos`` (from 1) ``, id, ref, alt, qual, filter, info`` with INFO as a map; flags map to null."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(f) >= 8)
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), f[5].alias("qual"), f[6].alias("filter"), F.str_to_map(f[7], F.lit(";"), F.lit("=")).alias("info"))


def write_vcf(variants: DataFrame, contigs: DataFrame, path: str, infos: dict[str, tuple[str, str, str]] | None = None) -> None:
    """VCF text in coordinate order; variants as read_vcf gives them, ``infos``: INFO id -> number, type, description."""
    spark = variants.sparkSession
    known = contigs.select(F.col("name").alias("_name"), F.row_number().over(Window.orderBy("name")).cast("int").alias("_n"), "length")
    lines = ["##fileformat=VCFv4.2", *(f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in (infos or {}).items())]
    head = spark.createDataFrame([(x, -2, i) for i, x in enumerate(lines)] + [("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", 0, 0)], "value string, o int, p long")
    listed = known.select(F.concat(F.lit("##contig=<ID="), "_name", F.lit(",length="), "length", F.lit(">")).alias("value"), F.lit(-1).alias("o"), F.col("_n").cast("long").alias("p"))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    rows = variants.join(F.broadcast(known.drop("length")), F.col("chrom") == F.col("_name"), "left").select(
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), *(field(c) for c in ("id", "ref", "alt", "qual", "filter")), F.coalesce(F.nullif(info, F.lit("")), F.lit("."))).alias("value"), F.coalesce("_n", F.lit(1 << 30)).alias("o"), F.col("pos").alias("p")
    )
    head.unionByName(listed).unionByName(rows).repartitionByRange("o", "p").sortWithinPartitions("o", "p").select("value").write.text(path)


#: Places of the columns of a genome browser's repeat table that are read.
REPEAT_COLUMNS = {"chrom": 5, "start": 6, "end": 7, "strand": 9, "rep_name": 10, "rep_class": 11, "rep_family": 12, "rep_start": 13, "rep_end": 14, "rep_left": 15}


def read_repeat_table(spark: SparkSession, path: str) -> DataFrame:
    """A genome browser's repeat table, 17 tab-separated columns with or without a header line, and the share of the consensus that each repeat covers.

    Rows with fewer columns or without numbers where they belong have no place and are left out.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(f) >= 17)
    kinds = {c: "int" if c in ("start", "end", "rep_start", "rep_end", "rep_left") else "string" for c in REPEAT_COLUMNS}
    rows = rows.select(*(F.expr(f"try_cast(split(value, '\t')[{i}] AS {kinds[c]})").alias(c) for c, i in REPEAT_COLUMNS.items())).where("start is not null and end is not null")
    return rows.withColumn("coverage", repeat_coverage(F.col("rep_start"), F.col("rep_end"), F.col("rep_left")))


def write_per_read(reads: DataFrame, path: str) -> None:
    """FASTQ text, a folder for each read (``name=...``)."""
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")
    reads.select("name", record).write.partitionBy("name").text(path)


def write_debug(rows: DataFrame, path: str | None) -> DataFrame:
    """``rows`` as they are, and as TSV under ``path`` if there is one: a look at what lies between two steps."""
    if path:
        write_tsv(rows, path)
    return rows


def read_strata(spark: SparkSession, path: str) -> DataFrame:
    """``stratum, priority, chrom, start, end`` of a list of ``name, bed path`` lines, in their order."""
    listed = [r.value.split("\t") for r in spark.read.text(path).collect() if r.value.strip() and not r.value.startswith(("#", "name\t"))]
    if any(len(x) != 2 for x in listed):
        raise ValueError("a stratum line needs a name and a path")
    out = None
    for i, (name, bed) in enumerate(listed):
        rows = read_bed(spark, bed).select(F.lit(name).alias("stratum"), F.lit(i).alias("priority"), "chrom", "start", "end")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "stratum string, priority int, chrom string, start long, end long")


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header line."""
    return spark.read.csv(path, sep=sep, header=True)


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60) -> None:
    rows.select(F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))).write.text(path)


def write_fastq_chunks(reads: DataFrame, path: str, per_file: int = 50_000) -> None:
    """FASTQ files of ``per_file`` reads at the most."""
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.select(record).write.option("maxRecordsPerFile", per_file).text(path)


def write_tsv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Tab-separated files with headers; with ``by``, a folder for each of its values."""
    writer = rows.write.option("sep", "\t").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def save_index(index: DataFrame, path: str, k: int, s: int, shards: int = 16) -> None:
    """A seed index as parquet, dealt by k-mer, with its parameters beside it."""
    index.withColumn("shard", F.pmod(F.xxhash64("kmer"), F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(f"{path}/seeds")
    index.sparkSession.createDataFrame([(3, k, s)], "version int, k int, s int").coalesce(1).write.json(f"{path}/metadata")


def load_index(spark: SparkSession, path: str, k: int, s: int) -> DataFrame:
    found = spark.read.json(f"{path}/metadata").first()
    if (found.version, found.k, found.s) != (3, k, s):
        raise ValueError(f"the index has version {found.version}, k {found.k}, s {found.s}")
    return spark.read.parquet(f"{path}/seeds").drop("shard")


def check_compatible(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both contig tables (``name, length``) are equal, in order too if both number their contigs (``index``)."""
    columns = ["name", "length", *(["index"] if "index" in a.columns and "index" in b.columns else [])]
    x, y = a.select(*columns), b.select(*columns)
    odd = x.exceptAll(y).unionAll(y.exceptAll(x))
    if not odd.isEmpty():
        raise ValueError(f"contigs differ: {[tuple(r) for r in odd.limit(3).collect()]}")
