"""Readers of sequence, interval, coverage, splice and list files.

Sequence and coverage files are Python data sources, one partition per file, decompressed as
a stream by suffix (gz, bz2, xz, zst). Text tables use Spark's own splits and codecs. Paths
must be readable from all executors.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import lzma
import os
import struct
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BATCH = 4096


def open_any(path: str) -> IO[bytes]:
    """A file as a byte stream, decompressed by its suffix."""
    path = path.removeprefix("file://")
    if path.endswith(".gz"):
        return gzip.open(path, "rb")
    if path.endswith(".bz2"):
        return bz2.open(path, "rb")
    if path.endswith(".xz"):
        return lzma.open(path, "rb")
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), closefd=True)
    return open(path, "rb")


def _lines(stream: IO[bytes]) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 20):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        yield from (p.rstrip(b"\r") for p in parts)
    if rest:
        yield rest.rstrip(b"\r")


def fastx_records(stream: IO[bytes]) -> Iterator[tuple[str, str, str | None]]:
    """(name, sequence, qualities or None) of FASTA or FASTQ; both may wrap lines."""
    name, seq, qual, state = None, [], [], ""
    for line in _lines(stream):
        if state == "qual":
            if sum(map(len, qual)) < sum(map(len, seq)):
                qual.append(line)
                continue
            yield name, b"".join(seq).decode(), b"".join(qual).decode("latin-1")
            name, seq, qual, state = None, [], [], ""
        if line[:1] in (b">", b"@") and state != "qual":
            if name is not None:
                yield name, b"".join(seq).decode(), None
            name, seq, qual, state = line[1:].decode("utf-8", "replace"), [], [], "seq"
        elif line[:1] == b"+" and state == "seq":
            state = "qual"
        elif state == "seq":
            seq.append(line.strip())
    if name is not None:
        yield name, b"".join(seq).decode(), b"".join(qual).decode("latin-1") if state == "qual" else None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _expand(paths: str) -> list[str]:
    out: list[str] = []
    for p in paths.split(","):
        hits = sorted(glob.glob(p)) if glob.has_magic(p) else [p]
        for h in hits:
            out += sorted(os.path.join(h, x) for x in os.listdir(h)) if os.path.isdir(h) else [h]
    return out


class FastxSource(DataSource):
    """Format ``fastx``: records of FASTA/FASTQ files, comma-separated paths or globs."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "path string, ordinal bigint, name string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _FastxReader(self.options["path"])


class _FastxReader(DataSourceReader):
    def __init__(self, paths: str):
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _expand(self.paths)]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        names = ["path", "ordinal", "name", "seq", "qual"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        rows: list[tuple] = []
        size = 0
        with open_any(part.path) as stream:
            for n, (name, seq, qual) in enumerate(fastx_records(stream)):
                rows.append((part.path, n, name, seq, qual))
                size += len(seq)
                if len(rows) >= _BATCH or size > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class BigWigSource(DataSource):
    """Format ``bigwig``: all interval blocks of all contigs."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "path string, chrom string, start bigint, end bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return _BigWigReader(self.options["path"])


class _BigWigReader(DataSourceReader):
    def __init__(self, paths: str):
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _expand(self.paths)]

    def read(self, part: _File) -> Iterator[tuple]:
        with open(part.path.removeprefix("file://"), "rb") as f:
            for chrom, start, end, value in bigwig_intervals(f):
                yield part.path, chrom, start, end, value


def bigwig_intervals(f: IO[bytes]) -> Iterator[tuple[str, int, int, float]]:
    """Intervals of a bigWig file, following its published layout."""
    head = f.read(64)
    order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == 0x888FFC26), None)
    if order is None:
        raise ValueError("not a bigWig file")
    chrom_at, _, index_at = struct.unpack(order + "QQQ", head[8:32])
    packed = struct.unpack(order + "I", head[52:56])[0] > 0
    f.seek(chrom_at)
    _, _, key_size, value_size = struct.unpack(order + "IIII", f.read(16))
    names: dict[int, str] = {}
    todo = [chrom_at + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, count = struct.unpack(order + "BBH", f.read(4))
        for _ in range(count):
            key = f.read(key_size).rstrip(b"\0").decode()
            if leaf:
                number, _ = struct.unpack(order + "II", f.read(value_size))
                names[number] = key
            else:
                todo.append(struct.unpack(order + "Q", f.read(8))[0])
    blocks, todo = [], [index_at + 48]
    while todo:
        f.seek(todo.pop())
        leaf, _, count = struct.unpack(order + "BBH", f.read(4))
        for _ in range(count):
            _, _, _, _, at = struct.unpack(order + "IIIIQ", f.read(24))
            if leaf:
                blocks.append((at, struct.unpack(order + "Q", f.read(8))[0]))
            else:
                todo.append(at)
    for at, size in sorted(blocks):
        f.seek(at)
        data = f.read(size)
        data = zlib.decompress(data) if packed else data
        number, start, _, step, span, kind, _, count = struct.unpack(order + "IIIIIBBH", data[:24])
        for i in range(count):
            if kind == 1:
                a, b, v = struct.unpack_from(order + "IIf", data, 24 + 12 * i)
            elif kind == 2:
                a, v = struct.unpack_from(order + "If", data, 24 + 8 * i)
                b = a + span
            else:
                a = start + i * step
                b, v = a + span, struct.unpack_from(order + "f", data, 24 + 4 * i)[0]
            yield names[number], a, b, v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)
    spark.dataSource.register(BigWigSource)


def read_fastx(spark: SparkSession, paths: str) -> DataFrame:
    """``[path, ordinal, name, seq, qual]``, one row per record; an empty file has none."""
    register(spark)
    return spark.read.format("fastx").load(paths)


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Read pairs ``[ordinal, r1, r2]``: two files in lock step."""
    side = lambda p, n: read_fastx(spark, p).select("ordinal", F.struct("name", "seq").alias(n))
    return side(first, "r1").join(side(second, "r2"), "ordinal")


def read_bigwig(spark: SparkSession, paths: str) -> DataFrame:
    register(spark)
    return spark.read.format("bigwig").load(paths)


def _tab(spark: SparkSession, paths: str) -> DataFrame:
    lines = spark.read.text(paths.split(",")).select(F.regexp_replace("value", "\\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"))
    return lines.where("line <> '' and line not like '#%' and line not like 'track%'")


def read_bed(spark: SparkSession, paths: str, strip_chr: bool = False) -> DataFrame:
    """``[path, chrom, start, end]``; comments and blank lines are skipped, a line without
    three columns is an error."""
    c = F.split("line", "\t")
    chrom = F.regexp_replace(c[0], "^chr", "") if strip_chr else c[0]
    bad = F.raise_error(F.concat(F.lit("not an interval line: "), F.col("line"))).cast("bigint")
    whole = F.size(c) >= 3
    return _tab(spark, paths).select("path", chrom.alias("chrom"), F.when(whole, F.try_element_at(c, F.lit(2)).cast("bigint")).otherwise(bad).alias("start"), F.when(whole, F.try_element_at(c, F.lit(3)).cast("bigint")).alias("end"))


def read_bedgraph(spark: SparkSession, paths: str) -> DataFrame:
    c = F.split("line", "\\s+")
    return _tab(spark, paths).select("path", c[0].alias("chrom"), c[1].cast("bigint").alias("start"), c[2].cast("bigint").alias("end"), c[3].cast("double").alias("value"))


def read_splice(spark: SparkSession, path: str) -> DataFrame:
    """``[sample, junction, num, den]`` of a splice table; its first line names the samples."""
    with open_any(path) as f:
        names = next(_lines(f)).decode().split()
    samples = names[1:] if names and names[0] == "chrom" else names
    rows = spark.read.text(path).where(F.split("value", " ")[0].contains(":"))
    c = F.split("value", " ")
    cells = rows.select(c[0].alias("junction"), F.posexplode(F.slice(c, F.lit(2), F.size(c))).alias("n", "cell"))
    n = F.split("cell", "/")
    name = F.element_at(F.array(*[F.lit(s) for s in samples]), F.col("n") + 1)
    return cells.select(name.alias("sample"), "junction", n[0].cast("bigint").alias("num"), n[1].cast("bigint").alias("den"))


def read_paths(spark: SparkSession, listing: str, queries: str | None = None) -> DataFrame:
    """``[entity_id, path, is_query]``: one entity per line, several paths by blanks."""
    def one(p: str, q: bool) -> list[tuple]:
        with open_any(p) as f:
            return [(line.decode(), q) for line in _lines(f) if line.strip()]

    lines = one(listing, False) + (one(queries, True) if queries else [])
    rows = spark.createDataFrame([(i, x, q) for i, (x, q) in enumerate(lines)], "entity_id bigint, line string, is_query boolean")
    return rows.select("entity_id", F.explode(F.split(F.trim("line"), " +")).alias("path"), "is_query")


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(c[0].alias("lhs"), F.try_element_at(c, F.lit(2)).alias("rhs"))
