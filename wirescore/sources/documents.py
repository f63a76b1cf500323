"""Result documents as a data source: one JSON file whose `items` are the rows of a frame.

Each task writes its rows as a shard beside the target, and the commit, on the driver, joins the bytes of the shards in the
order of the partitions between the head and the end of the document, and renames the whole into place. No row passes through
the driver as an object, a failed job leaves no document, and a repeated task's shard counts once.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .shared import discard, filesystem


@dataclass
class Shard(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def _indented(value: object, depth: int) -> str:
    # A JSON text has line feeds between its parts only: those within strings are escaped.
    return json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * depth)


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, order: str):
        self.path, self.head, self.order = path, head, order
        self.shards = f"{path}.{uuid.uuid4().hex}.shards"

    def write(self, rows: Iterator[Row]) -> Shard:
        fs, folder = filesystem(self.shards)
        fs.create_dir(folder)
        task = TaskContext.get()
        name, n = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                item = row.asDict(recursive=True)
                item.pop(self.order, None)
                out.write(((",\n    " if n else "    ") + _indented(item, 4)).encode("utf-8", "surrogatepass"))
                n += 1
        return Shard(task.partitionId(), name, n)

    def commit(self, messages: list[Shard | None]) -> None:
        fs, folder = filesystem(self.shards)
        _, target = filesystem(self.path)
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            fs.create_dir(os.path.dirname(target))
            with fs.open_output_stream(part) as out:
                head = json.loads(self.head)
                filled = [m for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.rows]
                text = json.dumps(head | {"items": []}, indent=2, ensure_ascii=False)
                out.write(text.removesuffix("]\n}").encode("utf-8"))
                for i, shard in enumerate(filled):
                    out.write(b",\n" if i else b"\n")
                    with fs.open_input_stream(f"{folder}/{shard.path}") as part_of:
                        shutil.copyfileobj(part_of, out, 1 << 20)
                out.write(b"\n  ]\n}\n" if filled else b"]\n}\n")
            if isinstance(fs, pafs.LocalFileSystem):
                with open(part, "rb") as whole:
                    os.fsync(whole.fileno())
            fs.move(part, target)
        except BaseException:
            if fs.get_file_info(part).type != pafs.FileType.NotFound:
                fs.delete_file(part)
            raise
        finally:
            self._clear(fs, folder)

    def abort(self, messages: list[Shard | None]) -> None:
        self._clear(*filesystem(self.shards))

    def _clear(self, fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class ResultDocument(DataSource):
    """Options: path, head (the other fields, as JSON), order (the column that the frame is sorted by, which is left out)."""

    @classmethod
    def name(cls) -> str:
        return "result_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["head"], self.options["order"])


@dataclass
class Document:
    """A result: its fields but the items, and the items as a frame with the column `order`."""

    head: dict
    items: DataFrame
    order: str
    tables: list[DataFrame] = field(default_factory=list)

    def write(self, path: str) -> None:
        spark = self.items.sparkSession
        spark.dataSource.register(ResultDocument)
        path = path if "://" in path else os.path.abspath(os.path.expanduser(path))
        out = self.items.orderBy(self.order).write.format("result_document").mode("append")
        out.option("head", json.dumps(self.head, ensure_ascii=False)).option("order", self.order).option("path", path).save()

    def read(self) -> dict:
        """The document as it would be written, through the driver: for small ones."""
        return self.head | {"items": [r.asDict(recursive=True) for r in self.items.orderBy(self.order).drop(self.order).collect()]}

    def close(self) -> None:
        for table in self.tables:
            discard(table)
        self.tables = []

    def __enter__(self) -> Document:
        return self

    def __exit__(self, *_) -> None:
        self.close()
