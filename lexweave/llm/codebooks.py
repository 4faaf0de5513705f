"""Compression of vectors to codes: a codebook for each part of a vector, fitted in rounds of nearest entries and means.

A round sends a kd-tree of each codebook to the tasks. A task looks its vectors up in the trees by branch and bound and adds up the
parts of each entry in whole numbers, so that a row for each entry and task is all that moves, and no order of adding changes a
sum. A branch whose bound equals the best distance so far is visited too, as an entry of a smaller index may lie in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import discard, evened, floored, matrix, quoted, release_memory, stored

#: Entries of a leaf of the trees.
LEAF = 2
#: Vectors that are looked up at a time.
BLOCK = 8192


class KdTree:
    """Entries (a row of whole numbers each) in nested boxes, split at the median of the widest dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.below, self.members = [], [], [], []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        node, held = len(self.low), self.entries[members]
        self.low.append(held.min(0))
        self.high.append(held.max(0))
        self.below.append(None)
        self.members.append(members)
        width = self.high[node] - self.low[node]
        if len(members) > LEAF and width.any():
            order = members[np.argsort(held[:, width.argmax()], kind="stable")]
            half = len(order) // 2
            self.below[node] = (self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])))
        return node

    def bound(self, node: int, points: np.ndarray) -> np.ndarray:
        """The squared distance from each point to a node's box."""
        gap = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each point; of entries equally near the one of the smallest index. All points go down
        the tree side by side, each into its nearer branch first."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            at = at[self.bound(node, points[at]) <= best[at]]
            if not len(at):
                continue
            if self.below[node] is None:
                for k in self.members[node].tolist():
                    gap = points[at] - self.entries[k]
                    found = np.einsum("ij,ij->i", gap, gap)
                    better = (found < best[at]) | ((found == best[at]) & (k < index[at]))
                    best[at[better]], index[at[better]] = found[better], k
                continue
            left, right = self.below[node]
            nearer = self.bound(left, points[at]) <= self.bound(right, points[at])
            todo += [(right, at[nearer]), (left, at[~nearer]), (left, at[nearer]), (right, at[~nearer])]
        return index, best


@dataclass
class Codebooks:
    """entries[p] has a row of whole numbers for each entry of the codebook of part p."""

    entries: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1] if self.entries else 0

    def sha256(self) -> str:
        """Over all components by part, entry and position, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def look_up(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part of each vector, and the squared distances."""
        index, gap = np.zeros((len(vectors), len(self.entries)), np.int64), np.zeros((len(vectors), len(self.entries)), np.int64)
        for p, entries in enumerate(self.entries):
            tree, at = KdTree(entries), slice(p * self.width, (p + 1) * self.width)
            for k in range(0, len(vectors), BLOCK):
                index[k : k + BLOCK, p], gap[k : k + BLOCK, p] = tree.nearest(np.ascontiguousarray(vectors[k : k + BLOCK, at]))
        return index, gap

    def decoded(self, coded: DataFrame, code_col: str = "code", scale: int = 4096, made: str = "decoded") -> DataFrame:
        """coded with the vectors that the codes stand for."""
        flat = F.array(*[F.array(*[F.array(*[F.lit(x / scale) for x in row]) for row in part.tolist()]) for part in self.entries])
        of = F.transform(F.sequence(F.lit(0), F.lit(len(self.entries) - 1)), lambda p: F.get(F.get(flat, p), F.conv(F.substring(F.col(code_col), p * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return coded.withColumn(made, F.flatten(of))


def _means(rows: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """The codebooks of the next round: each entry the mean of its parts, rounded down; an entry without any stays."""
    width = books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(e), width), np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            vectors = matrix(batch.column(0), dims)
            index, _ = books.look_up(vectors)
            for p in range(len(sums)):
                np.add.at(sums[p], index[:, p], vectors[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(index[:, p], minlength=len(counts[p]))
        told = [(p, k, int(n), sums[p][k]) for p in range(len(sums)) for k, n in enumerate(counts[p]) if n]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.int32()), pa.array([x[1] for x in told], pa.int32()), pa.array([x[2] for x in told], pa.int64()), pa.array([x[3].tolist() for x in told], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
        release_memory()

    added = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    entries = [e.copy() for e in books.entries]
    for r in total.collect():  # a row for each entry
        entries[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(entries)


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (an entry of two hex digits for each part), error (squared distances summed over the parts) and
    label_error (error summed over equal labels, nulls together) of each vector of df, and the codebooks.

    Components count as floor(scale * x). A codebook starts as the parts of the vectors of the smallest ids, as many as it has
    entries (fewer if there are not so many ids; of an id with several vectors the smallest one). Rows whose vector is null or holds
    a null or non-finite value are left out; a row without an id is coded but starts no entry; vectors that are shorter than others,
    or whose length is no multiple of parts, count as filled up by zeros. Repeated rows are coded alike and count each. An empty df
    gives an empty result and no codebooks. Distances are whole while they fit 63 bits; larger components are an error.

    The rounds read the whole numbers from a stored table; a row for each entry reaches the driver in each. A round that changes no
    entry is the last."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits tells at most 256 entries")
    whole = df.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).alias("label"), floored(quoted(vector_col), scale).alias("v")).filter("v IS NOT NULL")
    rows = stored(whole, "codebook-vectors")
    even, dims = evened(rows, "v", parts)
    largest = even.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0
    if dims * 4 * int(largest) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {largest} parts of 1/{scale} is too large for distances of 63 bits")
    smallest = [r["id"] for r in even.select("id").filter("id IS NOT NULL").distinct().orderBy("id").limit(entries).collect()]
    start = even.filter(F.col("id").isin(smallest)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    first = np.array([r["v"] for r in start], np.int64).reshape(len(start), dims)
    width = dims // parts
    books = Codebooks([first[:, p * width : (p + 1) * width] for p in range(parts)] if dims and len(start) else [])
    for _ in range(rounds if books.entries else 0):
        after = _means(even, books, dims)
        if all(np.array_equal(a, b) for a, b in zip(books.entries, after.entries, strict=True)):
            break
        books = after
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, gap = books.look_up(matrix(batch.column(2), dims))
            codes = ["".join(f"{k:02x}" for k in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(gap.sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])
        release_memory()

    coded = stored(even.select("id", "label", "v").mapInArrow(run, schema), "codebook-codes")
    discard(rows)
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
