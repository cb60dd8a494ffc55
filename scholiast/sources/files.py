"""Texts as files of given names, whole or not at all (SRC-16, SRC-17, SRC-18)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a write leaves beside the files: their names and sizes.
LISTING = "_files.json"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def safe_name(name: str) -> str:
    """A name without folders and characters that file systems mind."""
    return re.sub(r"[^\w.() -]", "_", name).lstrip(".") or "_"


@dataclass
class Written(WriterCommitMessage):
    """(name, name until the commit, bytes) of a task's files."""

    files: list[tuple[str, str, int]]


class Writer(DataSourceArrowWriter):
    """Tasks write under names of their own; the commit gives the files their names and lists them, an abort deletes them."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        system, at = place(folder)
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = place(self.folder)
        task, files = TaskContext.get().taskAttemptId(), []
        try:
            for batch in iterator:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if not name:
                        raise ValueError("a file needs a name")
                    own, data = f"_{self.job}-{task}-{len(files)}", (text or "").encode()
                    files.append((safe_name(name), own, len(data)))
                    with system.open_output_stream(f"{at}/{own}") as out:
                        out.write(data)
        except BaseException:
            self._delete(files)
            raise
        return Written(files)

    def _delete(self, files: list[tuple[str, str, int]]) -> None:
        system, at = place(self.folder)
        for _, own, _ in files:
            if system.get_file_info(f"{at}/{own}").type == fs.FileType.File:
                system.delete_file(f"{at}/{own}")

    def commit(self, messages: list[Written]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        names = [f[0] for f in files]
        system, at = place(self.folder)
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(at)) if not f.base_name.startswith("_")}
        if twice := sorted({a for a, b in zip(names, names[1:], strict=False) if a == b} | (there & set(names) if not self.overwrite else set())):
            self._delete(files)
            raise ValueError(f"names that are there already: {', '.join(twice[:5])}")
        for name, own, _ in files:
            system.move(f"{at}/{own}", f"{at}/{name}")
        if self.overwrite:
            for old in there - set(names):
                system.delete_file(f"{at}/{old}")
        with system.open_output_stream(f"{at}/{LISTING}") as out:
            out.write(json.dumps([{"name": n, "bytes": b} for n, _, b in files]).encode())

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            self._delete(m.files if m else [])


class NamedFiles(DataSource):
    """format("named_files"): takes (name string, text string), one row a file."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes rows (name, text) as UTF-8 files of a folder. Either all of them are there under their names afterwards or none.

    A null text is an empty file, a null or empty name an error; so are two rows of one name, and, unless `overwrite` is set, a file that is
    there. With it, files of other names go.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "text").write.format("named_files").mode("overwrite" if overwrite else "append").save(path)
