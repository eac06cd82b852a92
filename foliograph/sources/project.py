"""Projects as folders: a source that reads their files whole, and a sink that leaves pages under their own names.

Both are Python data sources. Folders may be in any store that pyarrow opens; executors read and write the
files themselves, and the driver sees names only.

    register(spark)
    spark.read.format("foliograph").load("books")                        # (path, file, text)
    pages.select("folder", "file", "text").write.format("foliograph").mode("append").save("site")
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

#: Files of about so many bytes are read by one task.
PARTITION_BYTES = 64 << 20
STAGED = "_staged"
MANIFEST = "_manifest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def decoded(data: bytes) -> str:
    """Text of a file: UTF-8, or Latin-1 where it is not valid; ends of line as one, tabs as blanks."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")


@dataclass
class Files(InputPartition):
    names: list[str]


class ProjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.raw = options["path"], options.get("raw", "false").lower() == "true"
        self.endings = tuple(x for x in options.get("endings", "").split(",") if x)

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        parts, size = [Files([])], 0
        for info in sorted(found, key=lambda x: x.path):
            hidden = any(x[:1] in "_." for x in info.path[len(root) :].strip("/").split("/") if x)
            if info.type != fs.FileType.File or hidden or self.endings and not info.path.endswith(self.endings):
                continue
            if size > PARTITION_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(info.path)
            size += info.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        for name in partition.names:
            with store.open_input_stream(name) as f:
                data = f.read()
            text = data.decode("utf-8") if self.raw else decoded(data)
            yield pa.RecordBatch.from_pydict({"path": [name], "file": [name[len(root) :].strip("/") or posixpath.basename(name)], "text": [text]}, pa.schema([(k, pa.string()) for k in ("path", "file", "text")]))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class PageWriter(DataSourceWriter):
    """Each task writes its pages to a folder of its own; the driver moves that of each finished task into place by name."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def _staged(self, root: str) -> str:
        return posixpath.join(root, f"{STAGED}-{self.job}")

    def write(self, rows: Iterator) -> Written:
        store, root = opened(self.path)
        folder = posixpath.join(self._staged(root), uuid.uuid4().hex)
        files: list[str] = []
        for row in rows:
            name = posixpath.normpath(posixpath.join(str(row["folder"] if row["folder"] is not None else "."), row["file"]))
            if name.startswith(("..", "/")):
                raise ValueError(f"a page outside its folder: {name}")
            at = posixpath.join(folder, name)
            store.create_dir(posixpath.dirname(at), recursive=True)
            with store.open_output_stream(at, compression=None) as f:
                f.write((row["text"] or "").encode())
            files.append(name)
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        names = [name for m in messages if m for name in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two pages have one name")
        for message in messages:
            for name in message.files if message else ():
                to = posixpath.join(root, name)
                store.create_dir(posixpath.dirname(to), recursive=True)
                store.move(posixpath.join(message.folder, name), to)
        with store.open_output_stream(posixpath.join(root, f"{MANIFEST}-{self.job}"), compression=None) as f:
            f.write(json.dumps({"pages": len(names)}).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks have left, finished or not, is under one folder."""
        store, root = opened(self.path)
        if store.get_file_info(self._staged(root)).type == fs.FileType.Directory:
            store.delete_dir(self._staged(root))


class Project(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliograph"

    def schema(self) -> str:
        return "path string, file string, text string"

    def reader(self, schema: StructType) -> ProjectReader:
        return ProjectReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        if overwrite:
            raise ValueError("pages are added under their names; choose append, or a new folder")
        return PageWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Project)


def read_project(spark: SparkSession, path: str, endings: str = "", raw: bool = False) -> "DataFrame":  # noqa: F821, UP037
    """(path, file, text) of the files below a folder, or of one file; files and folders that begin with _ or a dot are none.

    Text is UTF-8, or Latin-1 where it is not valid; ``raw`` gives valid UTF-8 as it stands.
    """
    register(spark)
    return spark.read.format("foliograph").option("endings", endings).option("raw", str(raw)).load(path)


def write_project(pages: "DataFrame", path: str) -> None:  # noqa: F821, UP037
    """Pages (folder, file, text) as files ``path/folder/file``; a failed or repeated task leaves no page behind.

    What a task that outlives its failed job still writes stays in that job's hidden folder, which readers pass over. Two pages of one name are an error. A file that is there is replaced.
    """
    register(pages.sparkSession)
    pages.select("folder", "file", "text").write.format("foliograph").mode("append").save(path)
