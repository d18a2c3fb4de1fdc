"""LAS and LAZ files: headers, chunk tables, chunk points and ranges of points.

``read_header`` and its like work on byte ranges that a callable fetches, so a header costs 4 KB, a chunk table its own size and a chunk point one
record, whatever the file's size. The ``las`` data source deals files, and ranges of large ones, out to tasks.
Compressed chunks beyond their first record need a codec that isn't here; asking for them raises an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from geolode.sources.arithmetic import decode_sizes, encode_sizes

Fetch = Callable[[int, int], bytes]
#: Bytes read at first; id of the compressor's record; bytes of a variable record's head; colours by point format (fixed values).
FIRST, LASZIP, VLR_HEAD = 4096, 22204, 54
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
CHUNK = 50_000
RAW = np.iinfo(np.int32)
#: Points that a task reads at once; what opening a file costs a task, in bytes; rows of small results that leave it at once.
READ, OPEN, GIVEN = 100_000, 1 << 20, 10_000


@dataclass(frozen=True)
class Header:
    version: int
    point_format: int
    compressed: bool
    record_length: int
    data_offset: int
    n_points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    chunk_size: int

    @property
    def n_chunks(self) -> int:
        return -(-self.n_points // self.chunk_size) if self.chunk_size else 0


def read_header(fetch: Fetch, size: int) -> Header:
    b = fetch(0, min(FIRST, size))
    if len(b) < 227 or b[:4] != b"LASF":
        raise ValueError("not a LAS file")
    version, header_size, data_offset, n_vlrs = b[25], *struct.unpack_from("<HII", b, 94)
    kind, record_length = b[104], struct.unpack_from("<H", b, 105)[0]
    n_points = struct.unpack_from("<Q", b, 247)[0] if version >= 4 else struct.unpack_from("<I", b, 107)[0]
    extent = struct.unpack_from("<6d", b, 179)
    chunk, at = CHUNK, header_size
    for _ in range(n_vlrs):
        head = fetch(at, VLR_HEAD + 16) if at + VLR_HEAD + 16 > len(b) else b[at : at + VLR_HEAD + 16]
        record, length = struct.unpack_from("<HH", head, 18)
        if record == LASZIP:
            chunk = struct.unpack_from("<I", head, VLR_HEAD + 12)[0]
            break
        at += VLR_HEAD + length
    return Header(version, kind % 128, kind >= 128, record_length, data_offset, n_points, struct.unpack_from("<3d", b, 131), struct.unpack_from("<3d", b, 155), extent[1::2], extent[0::2], chunk)


def read_chunk_sizes(fetch: Fetch, size: int, header: Header) -> list[int]:
    """Byte sizes of a compressed file's chunks, from its chunk table."""
    start = struct.unpack("<q", fetch(header.data_offset, 8))[0]
    table = fetch(start, size - start)
    _, n = struct.unpack_from("<II", table)
    return decode_sizes(table[8:], n)


def record_type(header: Header) -> np.dtype:
    fields, at = ["x", "y", "z"], [0, 4, 8]
    kinds = ["<i4"] * 3
    if (colour := COLOUR_AT.get(header.point_format)) is not None:
        fields, at, kinds = [*fields, "r", "g", "b"], [*at, colour, colour + 2, colour + 4], [*kinds, *["<u2"] * 3]
    return np.dtype({"names": fields, "formats": kinds, "offsets": at, "itemsize": header.record_length})


def decode_points(raw: bytes, header: Header, index: np.ndarray) -> dict[str, np.ndarray]:
    """Columns point_idx, xi to zi, x to z, r, g, b and a of whole records; files without colours are white."""
    records = np.frombuffer(raw, record_type(header))
    out = {"point_idx": index.astype(np.int64)} | {f"{a}i": records[a].astype(np.int32) for a in "xyz"}
    out |= {a: records[a] * header.scale[k] + header.offset[k] for k, a in enumerate("xyz")}
    for c in "rgb":
        v = records[c].astype(np.int32) if c in records.dtype.names else np.full(len(records), 255, np.int32)
        out[c] = np.where(v > 255, v // 256, v)
    return out | {"a": np.full(len(records), 255, np.int32)}


def read_chunk_points(fetch: Fetch, size: int, header: Header) -> dict[str, np.ndarray]:
    """The first point of each chunk; compressed files keep it as a plain record."""
    n, width = header.n_chunks, header.record_length
    if header.compressed:
        sizes = read_chunk_sizes(fetch, size, header)
        n = min(n, len(sizes))
        starts = header.data_offset + 8 + np.concatenate([[0], np.cumsum(sizes)])[:n]
    else:
        starts = header.data_offset + np.arange(n) * header.chunk_size * width
    return decode_points(b"".join(fetch(int(s), width) for s in starts), header, np.arange(n) * header.chunk_size)


def read_points(fetch: Fetch, header: Header, first: int, n: int) -> dict[str, np.ndarray]:
    """Points first to first + n of an uncompressed file."""
    if header.compressed:
        raise NotImplementedError("points inside compressed chunks need an LAZ codec; chunk points can be read")
    n = max(0, min(n, header.n_points - first))
    return decode_points(fetch(header.data_offset + first * header.record_length, n * header.record_length), header, first + np.arange(n))


def write_las(points: pd.DataFrame, scale: float = 0.01, version: int = 2, point_format: int = 2, chunk: int = CHUNK, compressed: bool = False, sizes: list[int] | None = None) -> bytes:
    """A file of points (xi, yi, zi, r16, g16, b16). A compressed one has a chunk table and each chunk's first record; the rest of a chunk is left blank.

    Records hold 32 bits an axis; where integers go beyond, they are kept from the file's least one on, which becomes the header's offset.
    """
    colour = COLOUR_AT.get(point_format)
    length = {0: 20, 2: 26, 3: 34, 5: 63, 7: 36, 8: 38, 10: 67}[point_format]
    header_size, n = (375 if version >= 4 else 227), len(points)
    vlr = struct.pack("<H16sHH32s", 0, b"laszip encoded", LASZIP, 46, b"") + struct.pack("<HHBBHII", 2, 0, 2, 2, 0, 0, chunk) + bytes(30) if compressed else b""
    data = header_size + len(vlr)
    h = bytearray(header_size)
    h[:4], h[24], h[25] = b"LASF", 1, version
    struct.pack_into("<HII", h, 94, header_size, data, 1 if compressed else 0)
    struct.pack_into("<BH", h, 104, point_format + 128 * compressed, length)
    struct.pack_into("<I", h, 107, 0 if version >= 4 else n)
    if version >= 4:
        struct.pack_into("<Q", h, 247, n)
    raw = np.ascontiguousarray(points[["xi", "yi", "zi"]].to_numpy())
    base = np.where((raw.max(0) > RAW.max) | (raw.min(0) < RAW.min), raw.min(0), 0) if n else np.zeros(3, int)
    struct.pack_into("<6d", h, 131, *[scale] * 3, *[float(v) * scale for v in base])
    struct.pack_into("<6d", h, 179, *[float(v) * scale for k in range(3) for v in ((raw[:, k].max(), raw[:, k].min()) if n else (0, 0))])
    records = np.zeros((n, length), np.uint8)
    if n and ((raw - base).max(0) > RAW.max).any():
        raise ValueError("a file's points lie further apart than 32 bits of its scale")
    records[:, :12] = np.ascontiguousarray((raw - base).astype("<i4")).view(np.uint8).reshape(n, 12)
    if colour is not None:
        records[:, colour : colour + 6] = np.ascontiguousarray(points[["r16", "g16", "b16"]].to_numpy().astype("<u2")).view(np.uint8).reshape(n, 6)
    if not compressed:
        return bytes(h) + records.tobytes()
    firsts = records[::chunk]
    sizes = sizes or [length + 7 * (k % 5) for k in range(len(firsts))]
    body = b"".join(f.tobytes().ljust(s, b"\0") for f, s in zip(firsts, sizes, strict=True))
    return bytes(h) + vlr + struct.pack("<q", data + 8 + len(body)) + body + struct.pack("<II", 0, len(sizes)) + encode_sizes(sizes)


HEADERS = "path string, version int, point_format int, compressed boolean, record_length int, data_offset bigint, n_points bigint, scale_x double, scale_y double, scale_z double, offset_x double, offset_y double, offset_z double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, chunk_size bigint, n_chunks bigint, file_size bigint"
TABLE = "path string, chunk_idx bigint, byte_size bigint"
POINTS = "path string, point_idx bigint, xi int, yi int, zi int, x double, y double, z double, r int, g int, b int, a int"


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])


def header_row(path: str, size: int, h: Header) -> tuple:
    return (path, h.version, h.point_format, h.compressed, h.record_length, h.data_offset, h.n_points, *h.scale, *h.offset, *h.low, *h.high, h.chunk_size, h.n_chunks, size)


def _from_bytes(content: bytes | memoryview) -> Fetch:
    return lambda at, n: bytes(content[at : at + n])


def _each(files: DataFrame, make: Callable[[str, memoryview], dict[str, object]], schema: str) -> DataFrame:
    """Rows of each file (path, content), whose bytes stay where Arrow has them; make gives columns, path aside."""
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths, contents = batch.columns
                for path, content in zip(paths, contents, strict=True):
                    yield as_batch(path.as_py(), make(path.as_py(), memoryview(content.as_buffer())), kinds)

        return together(each(), GIVEN)

    return files.select("path", "content").mapInArrow(run, schema)


def as_batch(path: str, columns: dict[str, object], kinds: pa.Schema) -> pa.RecordBatch:
    """Columns of equal length, by name, and the path beside them."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, np.int64))) if f.name == "path" else pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small batches as fewer of at least so many rows, but the last."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.concat_batches(kept)
            kept, n = [], 0
    if n:
        yield pa.concat_batches(kept)


def headers_of(files: DataFrame) -> DataFrame:
    """Headers of files (path, content), as the binaryFile source reads small ones."""
    return _each(files, lambda p, b: _header_columns(p, len(b), read_header(_from_bytes(b), len(b))), HEADERS)


def _header_columns(path: str, size: int, header: Header) -> dict[str, object]:
    return {c.split()[0]: [v] for c, v in zip(HEADERS.split(", "), header_row(path, size, header), strict=True)}


def chunk_tables_of(files: DataFrame) -> DataFrame:
    def one(path: str, b: memoryview) -> dict[str, object]:
        sizes = read_chunk_sizes(_from_bytes(b), len(b), read_header(_from_bytes(b), len(b)))
        return {"chunk_idx": np.arange(len(sizes)), "byte_size": sizes}

    return _each(files, one, TABLE)


def chunk_points_of(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The first point of every chunk; files that aren't compressed have no chunks of their own and get some of this size."""

    def one(path: str, b: memoryview) -> dict[str, object]:
        header = read_header(_from_bytes(b), len(b))
        header = header if header.compressed else replace(header, chunk_size=chunk)
        return read_chunk_points(_from_bytes(b), len(b), header)

    return _each(files, one, POINTS)


def points_of(files: DataFrame, first: int = 0, n: int = 1 << 62) -> DataFrame:
    return _each(files, lambda p, b: read_points(_from_bytes(b), read_header(_from_bytes(b), len(b)), first, n), POINTS)


def chunk_offsets(sizes: DataFrame, key: list[str], data_offset: Column) -> DataFrame:
    """byte_offset of each chunk (key, chunk_idx, byte_size): the data's offset, 8 bytes and the chunks before."""
    before = Window.partitionBy(*key).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("byte_offset", (data_offset + 8 + F.coalesce(F.sum("byte_size").over(before), F.lit(0))).cast("long"))


def even_chunks(headers: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of uncompressed files (n_points, data_offset, record_length): first point and byte_offset."""
    firsts = F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1, F.lit(chunk).cast("long"))
    return headers.filter("n_points > 0").withColumn("first", F.explode(firsts)).withColumn("byte_offset", F.col("data_offset") + F.col("first") * F.col("record_length"))


def encode_tiles(points: DataFrame, key: str = "tile_id", **options) -> DataFrame:
    """A file (path, content) for each tile of points."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point_idx")
        return pd.DataFrame([(f"tile_{part[key].iloc[0]}.las", write_las(part, **options))], columns=["path", "content"])

    return points.select(key, "point_idx", "xi", "yi", "zi", "r16", "g16", "b16").groupBy(key).applyInPandas(one, "path string, content binary")


def is_point_file(path: Column) -> Column:
    return F.lower(path).rlike("[.](las|laz)$")


def list_files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """path and length of files; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there; Hadoop's client serves the schemes that Arrow has none for."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    try:
        return pa.fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid:
        top, rest = re.match("([^:]+://[^/]*)(.*)", path).groups()
        return pa.fs.HadoopFileSystem(top), rest or "/"


def opened(path: str) -> tuple[pa.NativeFile, Fetch, int]:
    """A file for reading by ranges: the file, what fetches a range, and its size."""
    system, at = file_system(path)
    file = system.open_input_file(at)
    return file, (lambda start, n: file.read_at(n, start)), file.size()


def byte_ranges(ranges: DataFrame) -> DataFrame:
    """path, start, n and the bytes of ranges (path, start, n) of files; a task opens a file once for its ranges that follow each other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for part in parts:
            found = []
            for path, start, n in zip(part["path"], part["start"], part["n"], strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    name, (file, fetch, _) = path, opened(path)
                found.append(fetch(start, n))
            yield part[["path", "start", "n"]].assign(bytes=found)
        if file is not None:
            file.close()

    return ranges.select("path", "start", "n").mapInPandas(run, "path string, start bigint, n bigint, bytes binary")


def schema_of(what: str) -> str:
    return {"headers": HEADERS, "chunks": TABLE}.get(what, POINTS)


def read_file(path: str, what: str, chunk: int = 0, share: int = 0, of: int = 1, box: list[float] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a file (or the share-th part of its points), READ points at a time; chunk is the size of chunks of a file that isn't compressed, box what points must lie in."""
    file, fetch, size = opened(path)
    schema = arrow_schema(schema_of(what))
    with file:
        header = read_header(fetch, size)
        if chunk and not header.compressed:
            header = replace(header, chunk_size=chunk)
        for rows in _rows(path, what, fetch, size, header, share, of, box):
            if box and "x" in rows:
                inside = (rows["x"] >= box[0]) & (rows["x"] <= box[2]) & (rows["y"] >= box[1]) & (rows["y"] <= box[3])
                rows = {n: v[inside] for n, v in rows.items()}
            whole = as_batch(path, rows, schema)
            yield from (whole.slice(k, READ) for k in range(0, whole.num_rows, READ))


def _rows(path: str, what: str, fetch: Fetch, size: int, header: Header, share: int, of: int, box: list[float] | None) -> Iterator[dict[str, object]]:
    if what == "headers":
        yield _header_columns(path, size, header)
    elif what == "chunks":
        sizes = read_chunk_sizes(fetch, size, header) if header.compressed else [min(header.chunk_size, header.n_points - k) * header.record_length for k in range(0, header.n_points, header.chunk_size)]
        yield {"chunk_idx": np.arange(len(sizes)), "byte_size": np.array(sizes, np.int64)}
    elif box and not all(header.low[k] <= box[k + 2] and header.high[k] >= box[k] for k in range(2)):
        return
    elif what == "chunk_points":
        yield read_chunk_points(fetch, size, header)
    else:
        end = header.n_points * (share + 1) // of
        for first in range(header.n_points * share // of, end, READ):
            yield read_points(fetch, header, first, min(READ, end - first))


def point_files(path: str, recursive: bool = True) -> list[tuple[str, int]]:
    """Path and size of the LAS and LAZ files of a folder, or of one file; hidden ones, which may not be whole yet, are left out."""
    system, at = file_system(path)
    found = system.get_file_info(at)
    if found.type == pa.fs.FileType.Directory:
        infos = system.get_file_info(pa.fs.FileSelector(at, recursive=recursive))
    else:
        infos = [found]
    top = "" if system.type_name == "local" else path[: len(path) - len(at)] if path.endswith(at) else ""
    whole = [(top + i.path, i.size) for i in infos if i.type == pa.fs.FileType.File and i.base_name.lower().endswith((".las", ".laz")) and i.base_name[0] not in "._"]
    return sorted(whole)


@dataclass
class Part(InputPartition):
    """Whole files, or a share of one large file's points."""

    paths: list[str]
    share: int = 0
    of: int = 1


class LasReader(DataSourceReader):
    """what: headers, chunks, chunk_points or points; points of files of more than bytes_per_task bytes are read by several tasks.

    The driver lists the folder and opens no file. chunk is the number of points of a chunk of uncompressed files. box (x0,y0,x1,y1) leaves out points
    outside; a file whose header lies outside costs its task that header. Over many files, ``catalogue`` leaves such files out before any task.
    """

    def __init__(self, options: dict[str, str]):
        self.what = options.get("what", "points")
        self.step = int(options.get("bytes_per_task", 128 << 20))
        self.chunk = int(options.get("chunk", 0))
        self.box = [float(v) for v in options["box"].split(",")] if "box" in options else None
        self.path, self.recursive = options["path"], options.get("recursive", "true") == "true"

    def parts(self, files: list[tuple[str, int]]) -> list[Part]:
        """Small files go together, up to bytes_per_task of them and of what opening them costs, as tasks cost more than files."""
        found, some, held = [], [], 0
        for path, size in files:
            read = size if self.what == "points" else 0
            if read > self.step:
                of = -(-size // self.step)
                found += [Part([path], k, of) for k in range(of)]
                continue
            if some and held + read + OPEN > self.step:
                found.append(Part(some))
                some, held = [], 0
            some.append(path)
            held += read + OPEN
        return found + ([Part(some)] if some else [])

    def partitions(self) -> list[Part]:
        return self.parts(point_files(self.path, self.recursive))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return together((b for path in part.paths for b in read_file(path, self.what, self.chunk, part.share, part.of, self.box)), GIVEN)


class LasStreamReader(LasReader, DataSourceStreamReader):
    """A stream over a growing folder: every batch admits up to files_per_batch new files, in order of their names, and an offset is a number of batches.

    Which files a batch admitted is written to the option log, a folder of the stream's own, before the batch is handed out; so batches are the same after a
    restart, and every file comes once. A file must appear whole, by a rename from a hidden name or another folder. A file that is replaced under its name does not come again.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if "log" not in options:
            raise ValueError("a stream of files needs the option log, a folder of its own")
        self.most = int(options.get("files_per_batch", 1000))
        self.system, self.log = file_system(options["log"])
        self.system.create_dir(self.log, recursive=True)
        self.admitted: list[list[tuple[str, int]]] = []
        self.known: set[str] = set()

    def _entry(self, number: int) -> str:
        return f"{self.log}/{number:012d}.json"

    def _load(self) -> None:
        while self.system.get_file_info(self._entry(len(self.admitted))).type == pa.fs.FileType.File:
            with self.system.open_input_stream(self._entry(len(self.admitted))) as f:
                files = [tuple(x) for x in json.loads(f.read())]
            self.admitted.append(files)
            self.known.update(p for p, _ in files)

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        self._load()
        new = [f for f in point_files(self.path, self.recursive) if f[0] not in self.known][: self.most]
        if new:
            waiting = f"{self.log}/.{uuid.uuid4()}"
            with self.system.open_output_stream(waiting) as f:
                f.write(json.dumps(new).encode())
            self.system.move(waiting, self._entry(len(self.admitted)))
            self._load()
        return {"batches": len(self.admitted)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self._load()
        return self.parts([f for files in self.admitted[start["batches"] : end["batches"]] for f in files])

    def commit(self, end: dict) -> None:
        """Nothing to forget: the log says what has come."""


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class FilesWriter(DataSourceWriter):
    """Writes rows of path and content as files below the option path."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, rows) -> Written:
        done, made = [], set()
        system, top = file_system(self.folder)
        for row in rows:
            target = os.path.join(top, row.path)
            above = os.path.dirname(target)
            if above not in made:
                system.create_dir(above, recursive=True)
                made.add(above)
            with system.open_output_stream(f"{target}.part") as f:  # a task that runs twice replaces its file as a whole
                f.write(row.content)
            system.move(f"{target}.part", target)
            done.append(target)
        return Written(done)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        system = file_system(self.folder)[0]
        for path in (p for m in messages if m is not None for p in m.paths):
            if system.get_file_info(path).type == pa.fs.FileType.File:
                system.delete_file(path)


class LasSource(DataSource):
    """``spark.read.format("las").option("what", ...).load(path)``: LAS and LAZ files of a folder; ``readStream`` follows a growing one."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return schema_of(self.options.get("what", "points"))

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)

    def streamReader(self, schema) -> LasStreamReader:
        return LasStreamReader(self.options)


class FilesSink(DataSource):
    """``df.write.format("files").option("path", folder)``: rows of path and content become files."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite) -> FilesWriter:
        return FilesWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (LasSource, FilesSink):
        spark.dataSource.register(source)


def read_chunk_point_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk points of all files below a folder."""
    register(spark)
    return spark.read.format("las").option("what", "chunk_points").load(folder)


def with_bounds(chunk_points: DataFrame) -> DataFrame:
    """Chunk points with the number of points, the bounds and the mean colour that they give their file."""
    bounds = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    means = [F.floor(F.sum(k) / F.count("*")).cast("int").alias(f"mean_{k}") for k in "rgb"]
    return chunk_points.join(chunk_points.groupBy("path").agg(*bounds, *means), "path")
