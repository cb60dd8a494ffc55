"""Token ids of documents in binary files, with Elias-Fano coded document boundaries.

A file holds, one after another: eight bytes that name the format; the ids of its documents as little-endian
unsigned numbers of 2 or 4 bytes; the ends of the documents, counted in ids, and the doc_ids less the first
one, both Elias-Fano coded; a footer that says where each part begins; its length and the format's name
again. Documents stand in ascending order of doc_id, those without one first. `_files.json` lists the files
in order and how many ids are before each.

`token_files` is a data source of Spark in both directions. Each writing task streams into files of its own and
hands in their names; only the files that the commit lists count, so a lost or repeated task leaves nothing
behind that a reader sees. Reading tasks get slices of files, which `select` on the boundaries finds.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from scholiast.llm.elias_fano import U64, EliasFano, encode

MAGIC = b"TOKENEF1"
LISTING = "_files.json"
#: Ids after which a task begins another file, and ids of one reading task.
FILE_IDS, SLICE_IDS = 1 << 28, 1 << 23
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
#: id bytes, documents, documents without doc_id, ids, first doc_id, place of the boundaries, place of the doc_ids
_FOOT = struct.Struct("<QQQQqQQ")


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    """(file, documents, ids) of each file of a task, in order."""

    task: int
    files: list[tuple[str, int, int]]


class _File:
    """A file being written: ids go out as they come, boundaries and doc_ids are held, 16 bytes a document."""

    def __init__(self, folder: str, name: str, id_bytes: int):
        system, at = place(folder)
        self.name, self.id_bytes, self.n_ids = name, id_bytes, 0
        self.out = system.open_output_stream(f"{at}/{name}")
        self.out.write(MAGIC)
        self.sizes: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls = 0

    def add(self, doc_ids: np.ndarray, nulls: int, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.id_bytes == 2:
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError(f"id {ids.max()} doesn't fit in 2 bytes")
            ids = ids.astype("<u2")
        self.out.write(pa.py_buffer(ids.tobytes()))
        self.sizes.append(sizes)
        self.doc_ids.append(doc_ids)
        self.nulls += nulls
        self.n_ids += len(ids)

    def close(self) -> tuple[str, int, int]:
        sizes, doc_ids = np.concatenate(self.sizes), np.concatenate(self.doc_ids)
        if np.any(doc_ids[1:] < doc_ids[:-1]):
            raise ValueError("documents must come in ascending order of doc_id, those without one first")
        ends = encode(np.cumsum(sizes).astype(U64))
        first = int(doc_ids[0]) if len(doc_ids) else 0
        known = encode(doc_ids.view(U64) - np.int64(first).view(U64))
        at = len(MAGIC) + self.n_ids * self.id_bytes
        foot = _FOOT.pack(self.id_bytes, len(sizes), self.nulls, self.n_ids, first, at, at + len(ends))
        self.out.write(b"".join([ends, known, foot, struct.pack("<Q", len(foot)), MAGIC]))
        self.out.close()
        return self.name, len(sizes), self.n_ids


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, id_bytes: int, file_ids: int, overwrite: bool):
        self.folder, self.id_bytes, self.file_ids, self.overwrite = folder, id_bytes, file_ids, overwrite
        system, at = place(folder)
        if not overwrite and system.get_file_info(f"{at}/{LISTING}").type != fs.FileType.NotFound:
            raise ValueError(f"{folder} holds token files already")
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, files, now = TaskContext.get().partitionId(), [], None
        for batch in iterator:
            doc_ids, column = batch.column("doc_id"), batch.column("ids").cast(pa.large_binary())
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(data, "<u4", (at[-1] - at[0]) // 4, at[0]) if data is not None else np.zeros(0, "<u4")
            sizes, nulls = np.diff(at) // 4, doc_ids.null_count
            keys = doc_ids.slice(nulls).to_numpy(zero_copy_only=False)
            if now is None:
                now = _File(self.folder, f"{task:06d}-{len(files):04d}-{uuid.uuid4().hex}.ids", self.id_bytes)
            now.add(keys.astype(np.int64), nulls, sizes, ids)
            if now.n_ids >= self.file_ids:
                files.append(now.close())
                now = None
        if now is not None:
            files.append(now.close())
        return Written(task, files)

    def commit(self, messages: list[Written]) -> None:
        files, before = [], 0
        for name, docs, ids in (f for m in sorted(messages, key=lambda m: m.task) for f in m.files):
            files.append({"name": name, "docs": docs, "ids": ids, "before": before})
            before += ids
        system, at = place(self.folder)
        known = {f["name"] for f in files} | {LISTING}
        with system.open_output_stream(f"{at}/{LISTING}") as out:
            out.write(json.dumps({"files": files}).encode())
        for left in system.get_file_info(fs.FileSelector(at)):  # of lost attempts, or of what is overwritten
            if left.type == fs.FileType.File and left.base_name not in known:
                system.delete_file(left.path)

    def abort(self, messages: list[Written]) -> None:
        system, at = place(self.folder)
        for m in messages:
            for name, _, _ in m.files if m else ():
                system.delete_file(f"{at}/{name}")


class TokenFile:
    """One file, read in place: `ids(i)` is the array of document i, `start(i)` where it begins, `holding(k)` the document that id number k belongs to."""

    def __init__(self, path: str):
        system, at = place(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        tail = 16 + _FOOT.size
        self.file.seek(size - tail)
        foot = self.file.read(tail)
        if foot[-8:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.id_bytes, self.n_docs, self.nulls, self.n_ids, self.first, ends, known = _FOOT.unpack_from(foot)
        self.file.seek(ends)
        parts = self.file.read(size - tail - ends)
        self.ends, self.known = EliasFano(parts[: known - ends]), EliasFano(parts[known - ends :])

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def holding(self, k: int) -> int:
        if not 0 <= k < self.n_ids:
            raise IndexError(k)
        return self.ends.rank(k)

    def span(self, first: int, end: int) -> np.ndarray:
        """Ids first..end - 1 of the file."""
        self.file.seek(len(MAGIC) + first * self.id_bytes)
        return np.frombuffer(self.file.read((end - first) * self.id_bytes), f"<u{self.id_bytes}")

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.start(i), self.ends[i])

    def doc_ids(self, first: int, end: int) -> pa.Array:
        nulls = max(0, min(end, self.nulls) - first)
        keys = self.known.slice(max(first, self.nulls) - self.nulls, max(end, self.nulls) - self.nulls)
        keys = (keys + np.int64(self.first).view(U64)).view(np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(keys, pa.int64())])


@dataclass
class Slice(InputPartition):
    file: str
    before: int
    first_id: int
    end_id: int


class Reader(DataSourceReader):
    def __init__(self, folder: str, slice_ids: int):
        self.folder, self.slice_ids = folder, slice_ids

    def partitions(self) -> list[Slice]:
        system, at = place(self.folder)
        with system.open_input_stream(f"{at}/{LISTING}") as listing:
            files = json.loads(listing.read())["files"]
        slices = [Slice(f["name"], f["before"], i, i + self.slice_ids) for f in files for i in range(0, max(1, f["ids"]), self.slice_ids)]
        return slices or [Slice("", 0, 0, 0)]  # Spark asks for one at least

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """The documents that end after the slice's first id and not after its last; those without ids go with the one before them."""
        if not partition.file:
            return
        file = TokenFile(f"{self.folder}/{partition.file}")
        first = file.ends.rank(partition.first_id) if partition.first_id else 0
        last = file.ends.rank(partition.end_id) if partition.end_id < file.n_ids else file.n_docs
        while first < last:
            begin = file.start(first)
            end = min(last, max(first + 1, file.ends.rank(begin + (1 << 20))))
            ends = file.ends.slice(first, end).astype(np.int64)
            ids = file.span(begin, int(ends[-1])).astype("<u4")
            starts = np.concatenate([[begin], ends[:-1]])
            offsets = pa.py_buffer(((np.concatenate([starts, ends[-1:]]) - begin) * 4).astype(np.int32).tobytes())
            data = pa.Array.from_buffers(pa.binary(), end - first, [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([file.doc_ids(first, end), pa.array(starts + partition.before), pa.array(ends - starts), data], ["doc_id", "start", "n_tokens", "ids"])
            first = end


class TokenFiles(DataSource):
    """format("token_files"): takes (doc_id long, ids binary: little-endian unsigned 32-bit) in order of doc_id, gives (doc_id, start, n_tokens, ids). Options: path, id_bytes (2 or 4), file_ids, slice_ids."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("id_bytes", "4")), int(self.options.get("file_ids", FILE_IDS)), overwrite)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("slice_ids", SLICE_IDS)))


def write_ids(tokens: DataFrame, path: str, id_bytes: int = 4, overwrite: bool = False, **options: int) -> None:
    """Writes rows (doc_id, ids) that are in order over partitions and within them."""
    tokens.sparkSession.dataSource.register(TokenFiles)
    out = tokens.select("doc_id", "ids").write.format("token_files").options(id_bytes=id_bytes, **options)
    out.mode("overwrite" if overwrite else "append").save(path)


def read_ids(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of written files; `start` counts the ids of all documents before it."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(**options).load(path)
