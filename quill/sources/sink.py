"""A sink of one file per row that appears whole or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{os.path.abspath(folder)}"


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFiles(DataSource):
    """Rows (name, text) as <path>/<name><suffix> in UTF-8, through the file system of the path's URI.

    Tasks write into a folder beside the target. Once all have ended, it takes
    the target's name in one move; until then, or if a task fails for good, the
    target is as it was. `overwrite` puts the set in place of what stood there.
    `append` to a folder that holds files already moves file by file, which is
    not one step. A repeated task writes the same names again. Two rows of one
    name are an error. The file system must be able to rename.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(uri(self.options["path"]), self.options.get("suffix", ".svg"), overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, target: str, suffix: str, overwrite: bool):
        self.target, self.suffix, self.overwrite = target.rstrip("/"), suffix, overwrite
        self.staged = f"{self.target}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.staged)
        files.create_dir(root, recursive=True)
        n = 0
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # A dot in front: left-overs of a broken attempt are no files of the set.
                part = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write((text or "").encode())
                files.move(part, f"{root}/{name}{self.suffix}")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.staged)
        target = fs.FileSystem.from_uri(self.target)[1]
        files.create_dir(root, recursive=True)
        found = files.get_file_info(fs.FileSelector(root))
        whole = 0
        for f in found:
            if f.base_name.startswith("."):
                files.delete_file(f.path)
            else:
                whole += 1
        if whole != sum(m.files for m in messages if m):
            raise ValueError(f"rows of one name: {sum(m.files for m in messages if m)} rows make {whole} files")
        there = files.get_file_info(target).type == fs.FileType.Directory
        if there and self.overwrite:
            old = f"{root}.old"
            files.move(target, old)
            files.move(root, target)
            files.delete_dir(old)
        elif there and files.get_file_info(fs.FileSelector(target)):
            for f in found:
                if not f.base_name.startswith("."):
                    files.move(f.path, f"{target}/{f.base_name}")
            files.delete_dir(root)
        else:
            if there:
                files.delete_dir(target)
            files.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.staged)
        if files.get_file_info(root).type == fs.FileType.Directory:
            files.delete_dir(root)
