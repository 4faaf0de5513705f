"""ZIP archives that no row, task or driver holds whole: tasks pack members, the store joins them, tasks check them."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lexweave.sources import store, writers

#: From here on a size or a place needs the wide form of the format.
WIDE = 0xFFFFFFFF
#: Bytes that a task holds of a member.
BLOCK = 1 << 20


def _local(name: bytes, crc: int, packed: int, size: int) -> bytes:
    wide = max(packed, size) >= WIDE
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if wide else b""
    return struct.pack("<4s5H3I2H", b"PK\x03\x04", 45 if wide else 20, 0x800, 8, 0, 33, crc, *((0xFFFFFFFF, 0xFFFFFFFF) if wide else (packed, size)), len(name), len(extra)) + name + extra


def _directory(rows: list) -> bytes:
    """The directory of members in the order of rows, and the end of the archive."""
    out, at = bytearray(), 0
    for r in rows:
        name = r["name"].encode()
        wide = max(r["packed"], r["size"], at) >= WIDE
        extra = struct.pack("<HHQQQ", 1, 24, r["size"], r["packed"], at) if wide else b""
        sizes, place = ((0xFFFFFFFF, 0xFFFFFFFF), 0xFFFFFFFF) if wide else ((r["packed"], r["size"]), at)
        out += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 8, 0, 33, r["crc"], *sizes, len(name), len(extra), 0, 0, 0, 0, place) + name + extra
        at += len(_local(name, r["crc"], r["packed"], r["size"])) + r["packed"]
    size, n = len(out), len(rows)
    if n >= 0xFFFF or at + size >= WIDE:
        out += struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, at + size, 1)
    return bytes(out + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))


def packed_members(files: DataFrame, folder: str) -> DataFrame:
    """name, crc, packed, size, head, data: files (path, name) packed each into two files of a folder, block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        held, root = fs.FileSystem.from_uri(folder)
        held.create_dir(root, recursive=True)
        for batch in batches:
            for path, name in zip(batch["path"], batch["name"], strict=True):
                own, pack, crc, size, packed = uuid.uuid4().hex, zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, 0
                with store.opened(path) as source, held.open_output_stream(f"{root}/{own}.data") as out:
                    while block := source.read(BLOCK):
                        crc, size = zlib.crc32(block, crc), size + len(block)
                        made = pack.compress(block)
                        packed += len(made)
                        out.write(made)
                    made = pack.flush()
                    packed += len(made)
                    out.write(made)
                with held.open_output_stream(f"{root}/{own}.head") as out:
                    out.write(_local(name.encode(), crc, packed, size))
                yield pd.DataFrame({"name": [name], "crc": [crc], "packed": [packed], "size": [size], "head": [f"{folder}/{own}.head"], "data": [f"{folder}/{own}.data"]})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "name").repartition(n, "path").mapInPandas(run, "name string, crc long, packed long, size long, head string, data string")


def write_archive(files: DataFrame, target: str) -> int:
    """One ZIP file of files (path, name), members by name; gives their number. The driver holds a line for each member, which the
    directory of the format is; contents go from store to store."""
    spark = files.sparkSession
    folder = store.shared_folder(spark, "members")
    rows = store.stored(packed_members(files, folder), "packed").orderBy("name").collect()
    writers.write_file(spark, f"{folder}/directory", _directory(rows))
    writers.write_file(spark, target, [p for r in rows for p in (r["head"], r["data"])] + [f"{folder}/directory"])
    store.removed(spark, folder)
    return len(rows)


def _sha256(source) -> str:
    held = hashlib.sha256()
    while block := source.read(BLOCK):
        held.update(block)
    return held.hexdigest()


def file_digests(files: DataFrame) -> DataFrame:
    """name, digest of files (path, name), read block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name in zip(batch["path"], batch["name"], strict=True):
                with store.opened(path) as source:
                    yield pd.DataFrame({"name": [name], "digest": [_sha256(source)]})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "name").repartition(n, "path").mapInPandas(run, "name string, digest string")


def member_digests(archives: DataFrame) -> DataFrame:
    """name, digest of the members of archives (path): a first pass reads directories, a second one the members, each by itself."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with store.opened(path) as file, zipfile.ZipFile(file) as z:
                    found = z.namelist()
                yield pd.DataFrame({"path": [path] * len(found), "name": found})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, some in batch.groupby("path"):
                with store.opened(path) as file, zipfile.ZipFile(file) as z:
                    for name in some["name"]:
                        with z.open(name) as member:
                            yield pd.DataFrame({"name": [name], "digest": [_sha256(member)]})

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").mapInPandas(names, "path string, name string").repartition(n, "path", "name").mapInPandas(run, "name string, digest string")
