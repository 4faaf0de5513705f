"""A sink for audit records that are posted to a service: a PySpark data source for batches and streams.

A record's key goes to a ledger twice: before it is posted (claimed) and after (what the service answered). A task that is repeated, a job
that is run again, and a stream's batch after a restart find the ledger and post no claimed record again. A record whose task died
between the two is uncertain: it may have been taken, so it is left alone unless `known` can ask the service.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: What a ledger tells of a record: its key, the payload that counted, the answer's status and how the record stands.
LEDGER_SCHEMA = "key string, payload string, status long, state string"


class Ledger:
    """A folder with a file or two for each record, in any store that pyarrow knows, by the hash of the record's key."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs = fs
        self.store, self.root = fs.FileSystem.from_uri(folder)

    def _at(self, key: str, what: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.{what}"

    def has(self, key: str, what: str) -> bool:
        return self.store.get_file_info(self._at(key, what)).type.name == "File"

    def write(self, key: str, what: str, payload: str | None, status: int | None) -> None:
        at = self._at(key, what)
        self.store.create_dir(at.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(beside := f"{at}.{uuid.uuid4().hex}.tmp") as out:
            out.write(json.dumps({"key": key, "payload": payload, "status": status, "state": what}).encode())
        self.store.move(beside, at)


@dataclass
class Told(WriterCommitMessage):
    """What a task did: records posted and taken, refused, found in the ledger, and uncertain ones."""

    taken: int = 0
    refused: int = 0
    found: int = 0
    uncertain: int = 0


class _Posting:
    """Posts the rows of a task. A row has key and the columns of payloads, which are tried in turn."""

    def __init__(self, post: Callable[[str], int], ledger: str, payloads: tuple[str, ...], least: int, known: Callable[[str], int | None] | None):
        self.post, self.ledger, self.payloads, self.least, self.known = post, ledger, payloads, least, known

    def write(self, rows: Iterator[Row]) -> Told:
        ledger, told = Ledger(self.ledger), Told()
        for row in rows:
            key = str(row["key"])
            if ledger.has(key, "taken") or ledger.has(key, "refused"):
                told.found += 1
                continue
            if ledger.has(key, "claimed"):
                status = self.known(key) if self.known is not None else None
                if status is None:
                    told.uncertain += 1
                    continue
                self._end(ledger, told, key, None, status)
                continue
            ledger.write(key, "claimed", None, None)
            name, status = None, 0
            for name in self.payloads:
                status = int(self.post(row[name]))
                if status < self.least:
                    break
            self._end(ledger, told, key, name, status)
        return told

    def _end(self, ledger: Ledger, told: Told, key: str, name: str | None, status: int) -> None:
        good = status < self.least
        ledger.write(key, "taken" if good else "refused", name if good else None, status)
        told.taken += good
        told.refused += not good

    def told(self, messages: list[Told | None], job: str) -> None:
        """The sums of a finished write, beside the records."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.ledger)
        sums = {k: sum(getattr(m, k) for m in messages if m is not None) for k in ("taken", "refused", "found", "uncertain")}
        store.create_dir(f"{root}/writes", recursive=True)
        with store.open_output_stream(f"{root}/writes/{job}.json") as out:
            out.write(json.dumps(sums).encode())


class _Batch(_Posting, DataSourceWriter):
    def commit(self, messages: list[Told | None]) -> None:
        self.told(messages, f"batch-{uuid.uuid4().hex}")

    def abort(self, messages: list[Told | None]) -> None:
        """What was posted stays in the ledger; the next write goes on from there."""


class _Stream(_Posting, DataSourceStreamWriter):
    def commit(self, messages: list[Told | None], batchId: int) -> None:  # noqa: N803
        self.told(messages, f"stream-{batchId:012d}")

    def abort(self, messages: list[Told | None], batchId: int) -> None:  # noqa: N803
        """As of a batch."""


def register_sink(spark: SparkSession, name: str, post: Callable[[str], int], ledger: str, payloads: tuple[str, ...] = ("payload",), least: int = 300, known: Callable[[str], int | None] | None = None) -> None:
    """Makes `df.write.format(name)` and `df.writeStream.format(name)` post records: rows with `key`, which names a record for good, and
    the columns of payloads, of which the first one answered below least counts. Rows of one key in one write are one record where one
    task has them; give each record one row. known answers with the status of a record that the service has, None for one it has not
    told. ledger is a folder all executors share. Speculative tasks would post beside each other, so they are refused."""
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("records are posted by one task each: switch spark.speculation off")

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
            return _Batch(post, ledger, payloads, least, known)

        def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
            return _Stream(post, ledger, payloads, least, known)

    spark.dataSource.register(Sink)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """key, payload (the column that counted), status and state (taken, refused or uncertain) of each record of a ledger."""
    from pyspark.sql import functions as F

    files = spark.read.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{claimed,taken,refused}").option("wholetext", "true").text(ledger)
    rows = files.select(F.from_json("value", LEDGER_SCHEMA).alias("r")).select("r.*")
    last = F.max_by(F.struct("payload", "status", "state"), F.col("state") != "claimed")
    of = rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")
    return of.withColumn("state", F.when(F.col("state") == "claimed", "uncertain").otherwise(F.col("state")))
