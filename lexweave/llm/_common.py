"""Shared plumbing of the training-data operators: shared storage, Arrow text slices, distributed running totals."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handled in slices of about this many bytes, so that a task's memory does not follow the Arrow batch.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode without one a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.sparkContext.setCheckpointDir(found)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step and no result reads any more."""
    for df in tables:
        discard_folder(df.sparkSession, df.stored_at)


def discard_folder(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put_in_place(store, own: str, name: str) -> None:
    """Renames a finished file; where a repeated task finds its file there and the store does not replace it, the old one, which
    is equal, goes first."""
    try:
        store.move(own, name)
    except OSError:
        if store.get_file_info(name).type.name != "File":
            raise
        store.delete_file(name)
        store.move(own, name)


def kept_columns(df: DataFrame, made: list[str], keep: list[str] | None) -> list[str]:
    """Input columns that go along; a column the operator makes takes the place of an input column of that name."""
    return [c for c in (df.columns if keep is None else keep) if c not in made]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, texts) for runs of rows of about limit bytes; null is the empty text, and one long text is never cut."""
    array = pc.fill_null(array.cast(pa.string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = text_buffers(array)[1]
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, array.slice(at, to - at)
        at = to


def text_buffers(array: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the rows, from 0."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunk_array(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """The texts data[starts[i]:starts[i + 1]], without copying them."""
    bounds = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))


def joined_back(lists: list[list[int]], index: np.ndarray, dtype: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The lists named by index, one after another, and where each begins (with the end)."""
    kind = np.int32 if len(index) < 1 << 24 else np.int64
    sizes = np.fromiter(map(len, lists), kind, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), dtype, int(sizes.sum(dtype=np.int64)))
    begin = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(kind)
    sizes = np.take(sizes, index)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    if ends[-1] >= 1 << 31:
        begin = begin.astype(np.int64)
    places = np.repeat(np.take(begin, index) - ends[:-1].astype(begin.dtype), sizes)
    places += np.arange(len(places), dtype=places.dtype)
    return np.take(flat, places), ends


def release_memory() -> None:
    """Gives what a finished task has freed back to the system, as the Python worker stays and others share its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has and needs it
    if trim is not None:
        trim(0)


#: What a Python worker keeps between tasks, by the module that keeps it, and how that is dropped.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says that the tasks of a module keep something in their worker from one task to the next."""
    _KEPT[owner] = drop


def take_worker(owner: str) -> None:
    """At the start of a task: what other modules have kept in this worker goes, as a worker outlives the stages it works for."""
    others = [x for x in _KEPT if x != owner]
    for x in others:
        _KEPT.pop(x)()
    if others:
        release_memory()


def map_texts(df: DataFrame, text_col: str, made: T.StructType | str, work: Callable[[], Callable[[pa.StringArray], list[pa.Array]]], keep: list[str] | None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Adds the columns made to df. work() is called once a task and gives a function from a slice of texts to those columns."""
    made = T.StructType.fromDDL(made) if isinstance(made, str) else made
    names = [f.name for f in made]
    kept = kept_columns(df, names, keep)
    columns = [quoted(c).alias(f"k{i}") for i, c in enumerate(kept)]
    if text_col in kept and df.schema[text_col].dataType == T.StringType():
        at_text = kept.index(text_col)  # the texts travel once
    else:
        at_text = len(kept)
        columns.append(quoted(text_col).cast("string").alias("text_in"))
    schema = T.StructType([*(T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)), *(T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made))])
    n_kept, labels = len(kept), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(work.__module__)
        each = work()
        for batch in batches:
            for at, texts in text_slices(batch.column(at_text), slice_bytes):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(n_kept)), *each(texts)], names=labels)
        release_memory()

    source = df.select(*columns)
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"m{i}").alias(n) for i, n in enumerate(names)])


def bins_for(rows: int, per_bin: int = 20_000) -> int:
    """A power of two of bins, so that a bin holds about per_bin rows however many there are."""
    return 1 << max(3, (max(1, rows) // per_bin).bit_length())


def running_in_bins(df: DataFrame, group: list[str], bin_col: str, order: list[Column], values: dict[str, Column], inside: str = "in_bin") -> DataFrame:
    """Distributed prefix sums: for each name in values, `<name>` is the sum of the values of the rows of the same group
    before this one, in the order of (bin_col, order). Each (group, bin) is summed alone and then raised by the totals of the
    earlier bins of its group, so no task sees a whole group; only the bins' totals, a row each, meet by group."""
    named = df.withColumns({f"v_{k}": v for k, v in values.items()})
    in_bin = Window.partitionBy(*group, bin_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = named.groupBy(*group, bin_col).agg(*[F.sum(f"v_{k}").alias(f"t_{k}") for k in values])
    before = Window.partitionBy(*group).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    raised = totals.select(*group, bin_col, *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"b_{k}") for k in values])
    held = named.withColumns({f"w_{k}": F.coalesce(F.sum(f"v_{k}").over(in_bin), F.lit(0)) for k in values})
    on = [held[c].eqNullSafe(raised[c]) for c in [*group, bin_col]]
    out = held.join(raised, on, "inner")
    return out.select(*[held[c] for c in df.columns if c not in values], *[(F.col(f"w_{k}") + F.col(f"b_{k}")).alias(k) for k in values])


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in the order of (id, hash), null ids first: nulls ranges of rows without an id, then those between splits,
    where (id, hash) is the last row of its range."""

    nulls: int
    splits: list[tuple[int, int]]

    @property
    def count(self) -> int:
        return self.nulls + len(self.splits) + 1

    def of(self, id_: Column, hash_: Column) -> Column:
        """The number of the range of a row, from 0. Many splits are searched in two steps."""
        null = F.least(F.lit(self.nulls - 1), F.floor((hash_.cast("double") + 2.0**63) / 2.0**64 * self.nulls)).cast("int")
        at = F.struct(id_.cast("long").alias("id"), hash_.cast("long").alias("hash"))

        def made(splits: list[tuple[int, int]]) -> Column:
            return F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("hash")) for i, h in splits])

        def below(of: Column) -> Column:
            return F.size(F.filter(of, lambda s: s < at))

        splits = self.splits
        if not splits:
            found = F.lit(0)
        elif len(splits) <= 64:
            found = below(made(splits))
        else:
            step = int(len(splits) ** 0.5)
            blocks = [splits[i : i + step] for i in range(0, len(splits), step)]
            block = below(made([b[-1] for b in blocks]))
            inside = F.array(*[made(b) for b in blocks])
            found = F.when(block >= len(blocks), F.lit(len(splits))).otherwise(block * step + below(F.get(inside, block)))
        return F.when(id_.isNull(), null).otherwise(found + self.nulls)


def id_ranges(df: DataFrame, col: str, parts: int | None = None) -> Ranges:
    """About parts ranges of near equal row counts by a long column, by default as many as the session's shuffle partitions. An
    id that fills several ranges, as a null id may, is parted by the hash of its rows. Only the splits reach the driver."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = [i / parts for i in range(1, parts)]
    quantiles = F.percentile_approx(col, wanted, 100 * parts) if wanted else F.lit(None).cast("array<bigint>")
    r = df.agg(quantiles.alias("q"), F.count("*").alias("n"), F.count_if(F.col(col).isNull()).alias("null")).first()
    splits: list[tuple[int, int]] = []
    for value, times in sorted(Counter(r["q"] or []).items()):
        splits += [(value, -(1 << 63) + (k << 64) // times) for k in range(1, times)]
        splits.append((value, (1 << 63) - 1))
    return Ranges(max(1, round(r["null"] * parts / max(1, r["n"]))), splits)


def floored(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double; null for a vector that is null or holds null or non-finite values."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def evened(df: DataFrame, col: str, multiple: int = 1, fill: int = 0) -> tuple[DataFrame, int]:
    """df with the integer vectors of a column filled up to the length of the longest, and that to a multiple; and this length."""
    r = df.agg(F.min(F.size(col)).alias("least"), F.max(F.size(col)).alias("most")).first()
    dims = -(-(r["most"] or 0) // multiple) * multiple
    if r["least"] in (None, dims):
        return df, dims
    return df.withColumn(col, F.concat(col, F.array_repeat(F.lit(fill).cast("long"), F.lit(dims) - F.size(col)))), dims


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The rows of a column of equally long lists of whole numbers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), dims)
