"""A registered data source: folders of Word files as tables, and rows of names and bytes as files.

    word.register(spark)
    spark.read.format("word").load("…/folder")                          # a row for each file, with its paragraphs and blocks
    frame.select("name", "content").write.format("word").mode("append").save("…/folder")

Reading plans tasks of at most partitionBytes (32 MB) or one file; to open a file counts as 256 KB, so that small files spread too. Files with equal content give a row each. A file that can't be
read gives its error, and no paragraphs. Options: pattern ("*.docx"), partitionBytes, recursive ("true": folders below too)
and runs ("false": those of paragraphs are null, and their formats are not worked out).

Writing puts each task's files into a folder of its own below the target; when all tasks are done the driver moves them to their
names, and when one fails for good, or two rows share a name, it removes them: until then nothing is seen. A task that runs again
writes elsewhere, and what it left is removed. Append keeps other files and replaces those of the same name; overwrite leaves
only what was written. No rows write no files.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from galley.errors import DocumentError
from galley.sources import ooxml
from galley.sources.files import store

PARTITION_BYTES = 32 << 20
OPEN_BYTES = 256 << 10
#: Files that the driver moves at once.
MOVES = 16
_STAGED = ".staged-"


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and the names of the files in it."""

    folder: str
    names: list[str]


def split(sized: list[tuple[str, int]], limit: int) -> list[list[str]]:
    """Paths with their sizes, in order, as groups of at most so many bytes; a larger one stands alone."""
    groups: list[list[str]] = []
    room = 0
    for path, size in sized:
        if not groups or size > room:
            groups.append([])
            room = limit
        groups[-1].append(path)
        room -= size
    return groups


class WordReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.schema = to_arrow_schema(schema)
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*.docx")
        self.limit = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.runs = str(options.get("runs", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = store(self.folder)
        found = files.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        hidden = lambda f: any(p.startswith((".", "_")) for p in f.path.removeprefix(root).split("/"))
        own = sorted((f.path, f.size + OPEN_BYTES) for f in found if f.type == fs.FileType.File and fnmatchcase(f.base_name, self.pattern) and not hidden(f))
        return [Files(paths) for paths in split(own, self.limit)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without such files
            return
        files, _ = store(self.folder)

        def content(path: str) -> bytes:
            with files.open_input_stream(path) as stream:
                return stream.read()

        yield from ooxml.batches_of(((path, content(path)) for path in partition.paths), self.schema, self.runs)


class WordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if not {"name", "content"} <= set(schema.names):
            raise DocumentError("files need the columns name and content")
        self.folder, self.overwrite = options["path"], overwrite
        self.staged = f"{_STAGED}{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.folder)
        own = f"{root}/{self.staged}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        names = []
        for name, content in ((n.as_py(), c.as_py()) for b in batches for n, c in zip(b.column("name"), b.column("content"), strict=True)):
            if not name or "/" in name or name.startswith("."):
                raise DocumentError(f"not a name of a file: {name!r}")
            with files.open_output_stream(f"{own}/{len(names)}") as out:
                out.write(content if content is not None else b"")
            names.append(name)
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = store(self.folder)
        done = [m for m in messages if m is not None]
        counted = Counter(n for m in done for n in m.names)
        if twice := sorted(n for n, k in counted.items() if k > 1):
            self.abort(messages)
            raise DocumentError(f"files of one name: {', '.join(twice[:5])}")
        files.create_dir(root, recursive=True)
        moves = ((f"{m.folder}/{k}", f"{root}/{name}") for m in done for k, name in enumerate(m.names))
        with ThreadPoolExecutor(MOVES) as pool:
            while some := list(islice(moves, 1000)):
                list(pool.map(lambda move: files.move(*move), some))  # raises what a move raised
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and f.base_name not in counted:
                    files.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what tasks have written and not moved, that of lost attempts too."""
        from pyarrow import fs

        files, root = store(self.folder)
        if files.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staged}")


class WordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        return ooxml.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WordReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WordWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WordSource)
