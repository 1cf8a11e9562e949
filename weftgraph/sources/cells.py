"""Delimited text as rows of cells: (file_no int, line_no bigint from 1, cells array<string>), header lines apart.

Text files are split by Spark and numbered without a sort, quoted ones too, whose records may hold line feeds; a quoted file that has no quote
is read as a plain one. Zip archives are read one partition per file by a Python data source.
"""

from __future__ import annotations

import io
import logging
import os
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.schema import HeaderField, parse_header
from weftgraph.session import MOST_BROADCAST, small_table

log = logging.getLogger(__name__)
CELLS = "file_no int, line_no bigint, cells array<string>"
MOST_CHARS = 1 << 28  # of a record that lies in several blocks: more are taken for a quote that was never closed, which is an error
_OPENERS = 16  # files that the driver opens at once, to see whether they can be read and what their header is


@dataclass(frozen=True)
class CellFile:
    """Files with one header and their data rows. ``kept``: rows before the first blank one by file number, where ``rows`` is cut there and line_no counts from 1 without gaps."""

    path: str
    fields: list[HeaderField]
    rows: DataFrame
    kept: dict[int, int] | None = None


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its path there: a URI's own, else the local one."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _is_file(path: str) -> bool:
    try:
        system, at = filesystem(path)
        if system.get_file_info(at).type != fs.FileType.File:
            return False
        system.open_input_stream(at).close()
        return True
    except (OSError, pa.ArrowException):
        return False


def usable_paths(listed: str | None) -> list[str]:
    """Files of a comma-separated list; entries that can't be read are skipped with a warning."""
    paths = [p for p in (p.strip() for p in (listed or "").split(",")) if p]
    with ThreadPoolExecutor(_OPENERS) as pool:
        usable = list(pool.map(_is_file, paths))
    for path in (p for p, good in zip(paths, usable, strict=True) if not good):
        log.warning("%s is no readable file: skipped", path)
    return [p for p, good in zip(paths, usable, strict=True) if good]


_INSIDE = re.compile(r'(?:[^"\\]|\\.|"")*+', re.DOTALL)
_ESCAPED = re.compile(r'\\(.)|""', re.DOTALL)


def ends_open(line: str, delim: str, is_open: bool) -> bool:
    """Whether a line that begins inside a quoted cell (``is_open``), or at the beginning of a record, ends inside a quoted cell."""
    if '"' not in line:
        return is_open
    at = 0
    while True:
        if is_open or line.startswith('"', at):
            end = _INSIDE.match(line, at if is_open else at + 1).end()
            if not line.startswith('"', end):
                return True  # at the end, or at a backslash that takes the line feed
            at, is_open = end + 1, False
        at = line.find(delim, at) + 1
        if not at:
            return False


def split_record(record: str, delim: str) -> list[str]:
    """Cells of one record. A quote opens a cell only at its beginning; inside, a backslash takes the next character as it is and a doubled quote is
    one quote; what follows the closing quote is added as it stands. One CR at the end is dropped. A quote left open closes at the end."""
    if '"' not in record:
        return record.removesuffix("\r").split(delim)
    cells, at, n = [], 0, len(record) - record.endswith("\r")
    while True:
        text = ""
        if record.startswith('"', at):
            end = _INSIDE.match(record, at + 1).end()
            text = _ESCAPED.sub(lambda m: m.group(1) or '"', record[at + 1 : end])
            if not record.startswith('"', end):
                return [*cells, text + record[end:]]
            at = end + 1
        stop = record.find(delim, at)
        if stop < 0:
            return [*cells, text + record[at : max(at, n)]]
        cells.append(text + record[at:stop])
        at = stop + 1


def records(text: io.TextIOBase, delim: str) -> Iterator[list[str]]:
    """Records of a quoted text that is read line by line; line feeds inside quotes belong to the record."""
    held: list[str] = []
    is_open = False
    for line in text:
        line = line.removesuffix("\n")
        held.append(line)
        is_open = ends_open(line, delim, is_open)
        if not is_open:
            yield split_record("\n".join(held), delim)
            held = []
    if held:
        yield split_record("\n".join(held), delim)


def open_text(path: str) -> io.TextIOBase:
    """A text file as characters, unpacked by its suffix: ``.gz``, or ``.zip`` (its entries one after the other)."""
    system, at = filesystem(path)
    if path.endswith(".zip"):
        return io.TextIOWrapper(io.BufferedReader(_Entries(zipfile.ZipFile(system.open_input_file(at)))), encoding="utf-8", newline="\n")
    stream = system.open_input_stream(at, compression="gzip" if path.endswith(".gz") else None)
    return io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", newline="\n")


class _Entries(io.RawIOBase):
    def __init__(self, archive: zipfile.ZipFile) -> None:
        self._rest = iter([archive.open(n) for n in archive.namelist() if not n.endswith("/")])
        self._now = next(self._rest, None)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self._now is not None:
            data = self._now.read(len(buffer))
            if data:
                buffer[: len(data)] = data
                return len(data)
            self._now = next(self._rest, None)
        return 0


class _OneFile(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        super().__init__(number)
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._delim = options["delim"]
        self._quotes = options.get("quotes", "true") == "true"
        self._paths = options["paths"].split("\n")
        self._numbers = [int(n) for n in options["numbers"].split(",")]

    def partitions(self) -> list[InputPartition]:
        return [_OneFile(n, p) for n, p in zip(self._numbers, self._paths, strict=True)]

    def read(self, partition: _OneFile) -> Iterator[pa.RecordBatch]:
        with open_text(partition.path) as text:
            rows = records(text, self._delim) if self._quotes else (line.rstrip("\n").removesuffix("\r").split(self._delim) for line in text)
            next(rows, None)
            batch: list[list[str]] = []
            first = 1
            for row in rows:
                batch.append(row)
                if len(batch) == 8192:
                    yield self._batch(partition.number, first, batch)
                    first, batch = first + len(batch), []
            if batch:
                yield self._batch(partition.number, first, batch)

    @staticmethod
    def _batch(number: int, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        numbers = pa.array([number] * len(rows), pa.int32())
        lines = pa.array(range(first, first + len(rows)), pa.int64())
        return pa.RecordBatch.from_arrays([numbers, lines, pa.array(rows, pa.list_(pa.string()))], names=["file_no", "line_no", "cells"])


class QuotedCells(DataSource):
    """Format ``quoted_cells``: zipped (or any) delimited files, one partition per file. Options: paths (one a line), numbers, delim, quotes."""

    @classmethod
    def name(cls) -> str:
        return "quoted_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _pin_splits(spark: SparkSession) -> None:
    """Set the least number of splits where the session doesn't: it would follow the number of executors, which may change between two passes over the same files."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def _raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _path_name(path: str) -> str:
    return os.path.normpath(unquote(re.sub(r"^file:/+", "/", path)))


@dataclass(frozen=True)
class Block:
    """A block of a file: the row ids and the characters of its lines."""

    file: str
    start: int
    file_no: int
    first: int
    n: int
    chars: int


@dataclass(frozen=True)
class Lines:
    """Numbered lines (file_no, line_no from 0, value) of some files; per file number of lines, first blank line (or None) and whether there are quotes; the blocks in order."""

    rows: DataFrame
    counts: dict[int, int]
    blank: dict[int, int | None]
    quoted: set[int]
    blocks: list[Block]


def number_lines(spark: SparkSession, paths: list[str], numbers: list[int], is_blank: Column | None = None) -> Lines:
    """Lines with their numbers, without sort or shuffle.

    The lines of a block lie together in one partition, so a line's place in its block is its row id less the block's smallest. One aggregate, with one row per
    block of a file, tells where each block begins and, on the way, where the first blank line is. Both passes must split the files alike: the number
    of splits is pinned, and a block that the first pass did not see fails the job.
    """
    _pin_splits(spark)
    value = F.col("value")
    lines = _raw_lines(spark, paths)
    blank = is_blank if is_blank is not None else F.lit(False)
    seen = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.count("*").alias("n"), F.min(F.when(blank, F.col("at"))).alias("blank_at"), F.max(value.contains('"')).alias("quoted"), F.sum(F.length(value)).alias("chars")
    ).collect()
    number = {_path_name(p): n for p, n in zip(paths, numbers, strict=True)}
    counts, first_blank, quoted, blocks, starts = dict.fromkeys(numbers, 0), dict.fromkeys(numbers), set(), [], []
    for r in sorted(seen, key=lambda r: (r.file, r.block)):
        n = number[_path_name(r.file)]
        blocks.append(Block(r.file, r.block, n, r.first, r.n, r.chars))
        starts.append((r.file, r.block, n, r.first - counts[n]))
        if r.blank_at is not None and first_blank[n] is None:
            first_blank[n] = counts[n] + r.blank_at - r.first
        counts[n] += r.n
        quoted |= {n} if r.quoted else set()
    placed = _placed(lines, small_table(spark, starts, "file string, block bigint, file_no int, lead bigint"), "lead")
    return Lines(placed.select("file_no", (F.col("at") - F.col("lead")).alias("line_no"), "value"), counts, first_blank, quoted, blocks)


def _placed(lines: DataFrame, blocks: DataFrame, known: str) -> DataFrame:
    """Lines with what is known of their block; a block of which nothing is known fails the job."""
    moved = F.raise_error(F.lit("the files were split in another way than when their lines were counted")).cast("bigint")
    return lines.join(blocks, ["file", "block"], "left").withColumn(known, F.coalesce(known, moved))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, value) of one text file."""
    return number_lines(spark, [path], [1]).rows.select("line_no", "value")


def split_plain(value: Column, delim: str) -> Column:
    """Cells of a plain line; one CR at the end of the line is dropped."""
    return F.split(F.regexp_replace(value, r"\r\z", ""), re.escape(delim), -1)


def _header_cells(path: str, delim: str, quotes: bool) -> list[str]:
    with open_text(path) as text:
        if quotes:
            return next(records(text, delim), [])
        return [c for c in text.readline().rstrip("\r\n").split(delim)]


_EFFECTS = "file string, block bigint, at0 bigint, at1 bigint, open0 boolean, open1 boolean, n0 bigint, n1 bigint, closes bigint, tail0 bigint, tail1 bigint, blank0 bigint, blank1 bigint"


def blank_form(delim: str, width: int) -> str:
    """The form of a line that is a record without a filled cell among the first ``width``."""
    more = rf'{re.escape(delim)}(?:"")?'
    return rf'\A(?:"")?(?:(?:{more}){{0,{width - 1}}}\r?\z|(?:{more}){{{width - 1}}}{re.escape(delim)})'


class _Effect:
    """What the lines of a block do, for either way it may begin (0: at a record, 1: inside quotes). Only lines that hold a quote or may be blank come here."""

    def __init__(self, file: str, block: int, at: int) -> None:
        self.file, self.block, self.at0, self.at1 = file, block, at, at - 1
        self.open, self.n, self.tail, self.blank = [False, True], [0, 0], [None, None], [None, None]
        self.closes = None

    def add(self, at: int, value: str, delim: str, is_blank: bool) -> None:
        for i in (0, 1):
            was = self.open[i]
            if not was:
                self.n[i] += at - self.at1 - 1  # lines between, which are records of their own
                self.tail[i] = at
            now = self.open[i] = ends_open(value, delim, was)
            if not was and not now and is_blank and self.blank[i] is None:
                self.blank[i] = self.n[i]
            self.n[i] += not was
            if i and was and not now and self.closes is None and self.tail[1] is None:
                self.closes = at
        self.at1 = at

    def row(self) -> tuple:
        tails = [t if o else None for t, o in zip(self.tail, self.open, strict=True)]
        return (self.file, self.block, self.at0, self.at1, *self.open, *self.n, self.closes, *tails, *self.blank)


def _effects(batches: Iterator[pa.RecordBatch], delim: str) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        for value, file, block, at, blank in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "at", "blank")), strict=True):
            if now is None or (now.file, now.block) != (file, block):
                out += [now.row()] if now else []
                now = _Effect(file, block, at)
            now.add(at, value, delim, blank)
    out += [now.row()] if now else []
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 7]
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in _EFFECTS.split(", ")])


def _whole_records(batches: Iterator[pa.RecordBatch], delim: str) -> Iterator[pa.RecordBatch]:
    """Records of lines that come block by block, each from the beginning of a record (``begun``) to the end of one."""
    kinds, names = [pa.int32(), pa.int64(), pa.list_(pa.string())], ["file_no", "line_no", "cells"]
    key, number, held, is_open, out = None, 0, [], False, []
    for batch in batches:
        for value, file_no, block, begun in zip(*(batch.column(c).to_pylist() for c in ("value", "file_no", "block", "begun")), strict=True):
            if key != (file_no, block):
                key, number, held, is_open = (file_no, block), begun, [], False
            if not is_open and '"' not in value:
                out.append((file_no, number, split_record(value, delim)))
                number += 1
                continue
            held.append(value)
            is_open = ends_open(value, delim, is_open)
            if not is_open:
                out.append((file_no, number, split_record("\n".join(held), delim)))
                number, held = number + 1, []
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        out = []


@dataclass(frozen=True)
class Records:
    """Records (file_no, line_no from 0, cells); per file their number, the first blank one after the header, and whether that can't be told without looking at the rows."""

    rows: DataFrame
    counts: dict[int, int]
    blank: dict[int, int | None]
    unsure: set[int]


def quoted_records(spark: SparkSession, paths: list[str], numbers: list[int], delim: str, width: int = 1, blocks: list[Block] | None = None, most: int = MOST_CHARS) -> Records:
    """Records of quoted text files, which may hold line feeds, in splittable scans.

    What a block does to the state "inside quotes" is a function of two values, and only lines with a quote say which; the functions are composed over a file's
    blocks, one row per block, which tells how each block begins, where its first whole record starts and where its last one ends. Then every block's whole records are
    parsed on their own, once; the lines of a record that crosses blocks are put together by a shuffle. A quote that is never closed would take the rest of
    the file into one record: one of more than ``most`` characters is an error. ``blocks``: those of ``number_lines`` for the same paths.
    """
    blocks = number_lines(spark, paths, numbers).blocks if blocks is None else blocks
    lines = _raw_lines(spark, paths)
    value = F.col("value")
    marked = lines.withColumn("blank", value.rlike(blank_form(delim, width))).where(F.col("blank") | value.contains('"'))
    effects = {(r.file, r.block): r for r in marked.mapInArrow(lambda b: _effects(b, delim), _EFFECTS).collect()}
    places, counts, blank, unsure, crossing = [], dict.fromkeys(numbers, 0), dict.fromkeys(numbers), set(), {}
    file_no, is_open, begun = None, False, 0
    for b in blocks:
        if b.file_no != file_no:
            file_no, is_open, begun = b.file_no, False, 0
        e, s, start, end = effects.get((b.file, b.start)), int(is_open), begun, b.first + b.n
        head, tail = (end - 1, end) if s else (b.first - 1, end)  # lines up to head and from tail on are pieces
        if e is None:
            begun += 0 if s else b.n
        else:
            before = 0 if s else e.at0 - b.first
            is_open = (e.open0, e.open1)[s]
            found = (e.blank0, e.blank1)[s]
            if found is not None and blank[file_no] is None:
                blank[file_no] = begun + before + found
                unsure |= {file_no} if blank[file_no] == 0 else set()
            begun += before + (e.n0, e.n1)[s] + (0 if is_open else end - 1 - e.at1)
            if s and e.closes is not None:
                head = e.closes
            if is_open and not (s and e.closes is None):
                tail = (e.tail0, e.tail1)[s]
        for n, pieces in ((start - 1, head >= b.first), (begun - 1, tail < end)):
            if pieces:
                crossing[file_no, n] = crossing.get((file_no, n), 0) + b.chars
        counts[file_no] = begun
        unsure = unsure | {file_no} if is_open else unsure - ({file_no} if blank[file_no] != 0 else set())
        places.append((b.file, b.start, file_no, start, begun, head, tail))
    at = small_table(spark, places, "file string, block bigint, file_no int, begun bigint, ended bigint, head bigint, tail bigint")
    placed = _placed(lines, at, "begun")
    inside = placed.where((F.col("at") > F.col("head")) & (F.col("at") < F.col("tail"))).select("value", "file_no", "block", "begun", "at")
    if len(places) > MOST_BROADCAST:  # joined by a shuffle: lines of a block together and in order again
        inside = inside.repartition("file_no", "block").sortWithinPartitions("file_no", "block", "at")
    whole = inside.mapInArrow(lambda b: _whole_records(b, delim), CELLS)
    if not crossing:
        return Records(whole, counts, blank, unsure)
    ends = F.when(F.col("at") <= F.col("head"), F.col("begun")).otherwise(F.col("ended")) - 1
    pieces = placed.where((F.col("at") <= F.col("head")) | (F.col("at") >= F.col("tail"))).select("file_no", ends.alias("line_no"), "block", "at", "value")
    if max(crossing.values()) > most:
        longest = pieces.groupBy("file_no", "line_no").agg(F.sum(F.length("value") + 1).alias("chars")).orderBy(F.desc("chars")).first()
        if longest.chars > most:
            path = dict(zip(numbers, paths, strict=True))[longest.file_no]
            raise ValueError(f"{path}: record {longest.line_no} has {longest.chars} characters; is a quote never closed?")
    joined = pieces.groupBy("file_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"]), "\n").alias("text"))
    return Records(whole.unionByName(joined.mapInArrow(lambda b: _joined(b, delim), CELLS)), counts, blank, unsure)


def _joined(batches: Iterator[pa.RecordBatch], delim: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = pa.array([split_record(t, delim) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("file_no"), batch.column("line_no"), cells], names=["file_no", "line_no", "cells"])


def _quoted_files(spark: SparkSession, group: list[tuple[int, str]], fields: list[HeaderField], delim: str, blocks: list[Block] | None) -> CellFile:
    """Quoted files of one header, cut at the first blank record of each."""
    records_of = quoted_records(spark, [p for _, p in group], [n for n, _ in group], delim, max(len(fields), 1), blocks)
    data = CellFile(",".join(p for _, p in group), fields, records_of.rows.where("line_no > 0"))
    if records_of.unsure:
        return settled(data)
    kept = {n: max(0, (c if records_of.blank[n] is None else records_of.blank[n]) - 1) for n, c in records_of.counts.items()}
    last = small_table(spark, list(kept.items()), "file_no int, last bigint")
    return CellFile(data.path, fields, data.rows.join(last, "file_no").where("line_no <= last").drop("last"), kept)


def _plain_files(spark: SparkSession, group: list[tuple[int, str]], fields: list[HeaderField], delim: str, quotes: bool) -> tuple[list[CellFile], list[tuple[int, str]], list[Block] | None]:
    """Files of one header in one scan, those that need the quoted reader, and the blocks of these if they are known."""
    value = F.col("value")
    empty = F.array_join(F.slice(split_plain(value, delim), 1, max(len(fields), 1)), "") == ""
    blank = F.when((value == "") | value.startswith(delim) | value.startswith("\r"), empty).otherwise(False)
    lines = number_lines(spark, [p for _, p in group], [n for n, _ in group], blank)
    left = [(n, p) for n, p in group if quotes and n in lines.quoted]
    plain = [n for n, p in group if (n, p) not in left]
    if not plain:
        return [], left, lines.blocks
    # the header is line 0 and never a stop; a blank first line is a header without names
    kept = {n: max(0, (lines.counts[n] if not lines.blank[n] else lines.blank[n]) - 1) for n in plain}
    last = small_table(spark, list(kept.items()), "file_no int, last bigint")
    rows = lines.rows.where(F.col("file_no").isin(plain)) if left else lines.rows
    inside = (F.col("line_no") > 0) & (F.col("line_no") <= F.col("last"))
    # The guard keeps conversions from other lines in whatever order Catalyst works. The row id in it is true of every row; it keeps Catalyst
    # from copying the split into each expression that reads a cell.
    cells = F.when(inside & (F.monotonically_increasing_id() >= 0), split_plain(value, delim)).alias("cells")
    cut = rows.join(last, "file_no").where(inside).select("file_no", "line_no", cells)
    return [CellFile(",".join(p for n, p in group if n in kept), fields, cut, kept)], left, None


def read_cells(spark: SparkSession, paths: list[str], delim: str = "\t", quotes: bool = True, first_number: int = 1) -> list[CellFile]:
    """Files as cells, numbered in list order; plain files with the same header come as one CellFile, rows after a file's first blank one are cut off there.

    Empty header cells keep their place in both modes. An empty file has no fields and no rows.
    """
    spark.dataSource.register(QuotedCells)
    groups: dict[tuple[str, ...], list[tuple[int, str]]] = {}
    with ThreadPoolExecutor(_OPENERS) as pool:
        headers = list(pool.map(lambda p: tuple(_header_cells(p, delim, quotes)), paths))
    for (number, path), header in zip(enumerate(paths, first_number), headers, strict=True):
        groups.setdefault(header, []).append((number, path))
    out = []
    for header, group in groups.items():
        fields = parse_header(list(header))
        zips = [(n, p) for n, p in group if p.endswith(".zip")]
        text = [(n, p) for n, p in group if not p.endswith(".zip")]
        plain, left, blocks = _plain_files(spark, text, fields, delim, quotes) if text else ([], [], None)
        out += plain
        if left:
            out.append(_quoted_files(spark, left, fields, delim, blocks))
        if zips:
            options = {"paths": "\n".join(p for _, p in zips), "numbers": ",".join(str(n) for n, _ in zips), "delim": delim, "quotes": str(quotes).lower()}
            out.append(settled(CellFile(",".join(p for _, p in zips), fields, spark.read.format("quoted_cells").options(**options).load())))
    return out


def settled(file: CellFile) -> CellFile:
    """A file whose line numbers have no gaps, cut at its first blank row: one aggregate with one row per file."""
    blank = F.array_join(F.slice("cells", 1, max(len(file.fields), 1)), "") == ""
    seen = file.rows.groupBy("file_no").agg(F.max("line_no").alias("n"), F.min(F.when(blank, F.col("line_no"))).alias("stop")).collect()
    kept = {r.file_no: r.n if r.stop is None else r.stop - 1 for r in seen}
    last = small_table(file.rows.sparkSession, list(kept.items()), "file_no int, last bigint")
    return CellFile(file.path, file.fields, file.rows.join(last, "file_no").where("line_no <= last").drop("last"), kept)


def cells_from_table(table: DataFrame, columns: list[str | Column], order: str, file_no: int = 1) -> DataFrame:
    """A table's columns rendered as cells; ``order`` gives line_no, which must tell the rows' order but need not be dense."""
    cells = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return table.select(F.lit(file_no).cast("int").alias("file_no"), F.col(order).cast("bigint").alias("line_no"), F.array(*cells).alias("cells"))
