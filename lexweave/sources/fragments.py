"""Text files whose lines are made of rows: a data source that writes, for lines too long to be one value."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lexweave.sources import store


@dataclass
class _File(WriterCommitMessage):
    beside: str
    name: str


class _Writer(DataSourceWriter):
    """Each task writes a file beside; the files take their names, over those of an earlier write, when all tasks are done."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _File:
        from pyarrow import fs

        held, root = fs.FileSystem.from_uri(self.folder)
        held.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.txt"
        with held.open_output_stream(own := f"{root}/.{name}.{uuid.uuid4().hex}", buffer_size=1 << 20) as out:
            before = False
            for row in iterator:
                out.write((("," if before and row["item"] else "") + row["text"]).encode())
                before = row["item"]
        return _File(own, name)

    def commit(self, messages: list[_File | None]) -> None:
        from pyarrow import fs

        held, root = fs.FileSystem.from_uri(self.folder)
        held.create_dir(root, recursive=True)
        old = [f.path for f in held.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(".")]
        for m in messages:
            if m is not None:
                held.move(m.beside, f"{root}/{m.name}")
        for path in old if self.overwrite else []:
            held.delete_file(path)

    def abort(self, messages: list[_File | None]) -> None:
        from pyarrow import fs

        held, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None:
                held.delete_file(m.beside)


class Fragments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexweave_fragments"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_fragments(rows: DataFrame, path: str, whole: tuple[str, ...], order: tuple[str, ...]) -> None:
    """rows (item, text) as the texts of part files whose names follow the order of whole, then order. Rows that agree in whole go to
    one file, text behind text, with a comma between two items."""
    spark = rows.sparkSession
    spark.dataSource.register(Fragments)
    ranged = rows.repartitionByRange(*whole).sortWithinPartitions(*whole, *order).select("item", "text")
    ranged.write.format(Fragments.name()).mode("overwrite").option("path", store.qualified(spark, path)).save()
