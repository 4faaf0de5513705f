"""Exact top-k inner products over an impact-ordered index, score at a time.

Each block of vectors is indexed once, by posting segments: for every dimension and every quantised value the rows that have it.
The index of a block is a file in the shared folder, and queries come to it. A query takes the segments in descending quantised
impact, adds them to accumulators, and stops only on proof: once rescoring the rows whose upper bound still reaches the k-th best
exact score is far less work than reading on. Those possible members are rescored exactly, ties included. What a query has found
in one block is its bar in the next.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm._common import discard, discard_folder, floored, new_folder, put_in_place, quoted, release_memory, stored

#: Rows of an index block, and queries of a group that go through blocks together.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4_096
#: Blocks of a tile: a task never does more than RANGE_BLOCKS * BLOCK_QUERIES searches of a block, at any number of rows.
RANGE_BLOCKS = 16
#: Tiles of one job; more of them are done by several jobs, whose results are merged as they come.
WAVE_TILES = 20_000
#: Levels into which a dimension's values are quantised within a block.
LEVELS = 64
#: Shares of all postings after which the bounds are looked at.
LOOKS = (0.25, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1)
#: A search stops when reading on is so many times the work of rescoring what is left.
RESCORE = 4


class ImpactIndex:
    """Posting segments of one block of integer vectors (a row each), with ids in ascending order. Segment s holds the rows
    rows[bounds[s]:bounds[s + 1]], whose values in dimension dim[s] reach from least[s] to greatest[s]."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, dims = vectors.shape
        low, high = self.vectors.min(0), self.vectors.max(0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = ((self.vectors - low) // step).astype(np.uint8)
        by = np.argsort(level, axis=0, kind="stable")
        flat = np.take_along_axis(level, by, 0).T.astype(np.int64) + 256 * np.arange(dims)[:, None]
        first = np.flatnonzero(np.diff(flat.ravel(), prepend=-1))
        values = np.take_along_axis(self.vectors, by, 0).T.ravel()
        self.rows = by.T.ravel().astype(np.uint16 if n <= 1 << 16 else np.uint32)
        self.bounds = np.append(first, n * dims)
        self.dim = first // n
        self.least, self.greatest = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)

    PARTS = ("ids", "vectors", "rows", "bounds", "dim", "least", "greatest")

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        span = max(-int(self.vectors.min(initial=0)), int(self.vectors.max(initial=0)))
        kind = np.int16 if span < 1 << 15 else np.int32 if span < 1 << 31 else np.int64
        np.savez(held, **{p: getattr(self, p).astype(kind) if p == "vectors" else getattr(self, p) for p in self.PARTS})
        return held.getvalue()

    @classmethod
    def of_bytes(cls, data: bytes) -> ImpactIndex:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for p in cls.PARTS:
                setattr(self, p, parts[p])
        self.vectors = self.vectors.astype(np.int64)
        return self

    def search(self, query: np.ndarray, k: int, own: int | None, bar: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows but the query's own id, by descending score and ascending id; exact. With a bar, rows
        of a lower score need not be found. read tells the share of postings that was added up."""
        n, dims = self.vectors.shape
        query = np.pad(query[:dims], (0, max(0, dims - len(query))))  # a shorter vector counts as filled up by zeros
        weight = query[self.dim]
        impact = np.maximum(weight * self.least, weight * self.greatest)  # what a row of the segment adds at most
        floor = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dim, impact)
        above = impact - floor[self.dim]  # so that a dimension adds at least nothing above its floor
        order = np.argsort(-above, kind="stable")
        sizes = np.diff(self.bounds)
        ends = np.cumsum(sizes[order])
        # the most that each dimension can still add, once the segments before are done
        base, bound, seen, done = int(floor.sum()), np.zeros(n), np.zeros(n, np.int64), 0
        scores = np.full(n, np.iinfo(np.int64).min)
        barred = np.zeros(n, bool) if own is None else self.ids == own
        for share in LOOKS:
            to = len(order) if share == 1 else int(np.searchsorted(ends, share * ends[-1])) + 1
            if to > done:
                part = order[done:to]
                at = self.rows[np.repeat(self.bounds[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(int(sizes[part].sum()))]
                bound += np.bincount(at, np.repeat(above[part], sizes[part]).astype(float), n)
                seen += np.bincount(at, minlength=n)
                done = to
            left = np.zeros(dims, np.int64)
            np.maximum.at(left, self.dim[order[done:]], above[order[done:]])
            # a row that was not yet met in so many dimensions gets at most the largest of what is left
            coming = np.concatenate(([0], np.cumsum(np.sort(left)[::-1])))
            upper = base + bound + coming[dims - seen]
            upper[barred] = -np.inf
            best = np.argpartition(-upper, min(n - 1, 4 * k))[: 4 * k + 1]
            best = best[~barred[best] & (scores[best] == np.iinfo(np.int64).min)]
            scores[best] = self.vectors[best] @ query
            exact = np.sort(scores[scores > np.iinfo(np.int64).min])
            kth = max(exact[-k] if len(exact) >= k else -np.inf, -np.inf if bar is None else bar)
            possible = np.flatnonzero((upper >= kth) & ~barred)
            self.read = float(ends[done - 1] / ends[-1]) if done else 0.0
            if done == len(order) or RESCORE * len(possible) * dims <= ends[-1] - ends[done - 1]:
                found = self.vectors[possible] @ query
                top = np.lexsort((self.ids[possible], -found))[:k]
                return found[top], self.ids[possible][top]
        raise AssertionError("the last look is at all postings")


def _matrix(lists: pd.Series) -> np.ndarray:
    out = np.zeros((len(lists), max(1, lists.map(len).max())), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _build(rows: DataFrame, folder: str, blocks: int, ranges: int) -> DataFrame:
    """Writes the index of every block into its range's folder: range, blocks, rows of each range (stored)."""
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        data = ImpactIndex(part["id"].to_numpy(), _matrix(part["v"])).to_bytes()
        at = f"{root}/{key[0] % ranges}"
        store.create_dir(at, recursive=True)
        with store.open_output_stream(own := f"{at}/.{key[0]}.{uuid.uuid4().hex}") as out:
            out.write(data)
        put_in_place(store, own, f"{at}/block-{key[0]:09d}")
        release_memory()
        return pd.DataFrame({"range": [key[0] % ranges], "rows": [len(part)]})

    made = rows.select("id", "v", block.alias("block")).groupBy("block").applyInPandas(build, "range int, rows long")
    return stored(made.groupBy("range").agg(F.count("*").alias("blocks"), F.sum("rows").alias("rows")), "topk-manifest")


def _write_groups(queries: DataFrame, folder: str, groups: int) -> DataFrame:
    """Writes the queries of each group as a file: group, rows (stored)."""
    group = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(groups)).cast("int")

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/groups", recursive=True)
        with store.open_output_stream(own := f"{root}/groups/.{key[0]}.{uuid.uuid4().hex}") as out, io.BytesIO() as held:
            np.savez(held, ids=part["id"].to_numpy(), vectors=_matrix(part["v"]))
            out.write(held.getvalue())
        put_in_place(store, own, f"{root}/groups/{key[0]:09d}")
        return pd.DataFrame({"group": [key[0]], "rows": [len(part)]})

    return stored(queries.select("id", "v", group.alias("group")).groupBy("group").applyInPandas(write, "group int, rows long"), "topk-groups")


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of df that is_query picks, the k other rows of the highest integer
    inner product, ties to the smaller id; all of them if there are fewer.

    Vectors that are null or hold a null or non-finite value take no part, nor do rows without an id; a shorter vector counts as
    filled up by zeros. A repeated row counts once; an id with several vectors has a row for each, none of which answers a query of
    that id. Scores are whole while components stay below 2^26. An empty df gives an empty result.

    A tile is a group of queries and a range of blocks, both in files; it goes through the blocks one by one, keeps the k best of each
    query, and is a task of its own, so a lost executor costs single tiles. Only the best rows meet by query. Vectors move once, into
    the index files, and queries once, into the files of their groups."""
    schema = "query_id long, vec_id long, score long"
    rows = stored(df.select(quoted(id_col).cast("long").alias("id"), is_query.alias("q"), floored(quoted(vector_col), scale).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id", "v"]), "topk-rows")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, groups = max(1, -(-counts["n"] // BLOCK_ROWS)), max(1, -(-counts["q"] // BLOCK_QUERIES))
    # few groups share the blocks among several tasks; many need not, but a tile stays within its bound
    ranges = min(blocks, max(-(-blocks // RANGE_BLOCKS), 4 * rows.sparkSession.sparkContext.defaultParallelism // groups, 1))
    folder = new_folder(rows.sparkSession, "topk-index")
    manifest = _build(rows, folder, blocks, ranges)
    sizes = {r["range"]: r["rows"] for r in manifest.collect()}  # a row for each range
    grouped = _write_groups(rows.filter("q"), folder, groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"].tolist():
                yield tile(number % groups, number // groups)

    def tile(group: int, at: int) -> pd.DataFrame:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/groups/{group:09d}"
        if store.get_file_info(name).type.name != "File":  # a group that no query's hash fell into
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        with store.open_input_stream(name) as data, np.load(io.BytesIO(data.read())) as held:
            ids, vectors = held["ids"], held["vectors"]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        met = 0
        found = store.get_file_info(fs.FileSelector(f"{root}/{at}", allow_not_found=True))
        for name in sorted(f.path for f in found if f.base_name.startswith("block-")):
            with store.open_input_stream(name) as data:
                index = ImpactIndex.of_bytes(data.read())
            met += len(index.ids)
            for i, own in enumerate(ids.tolist()):
                scores, near = best[i]
                more = index.search(vectors[i], k, own, int(scores[-1]) if len(scores) == k else None)
                scores, near = np.concatenate((scores, more[0])), np.concatenate((near, more[1]))
                top = np.lexsort((near, -scores))[:k]
                best[i] = scores[top], near[top]
        if met != sizes.get(at, 0):
            raise OSError(f"range {at} of the index has {met} rows instead of {sizes.get(at, 0)}")
        release_memory()
        each = [len(s) for s, _ in best]
        return pd.DataFrame({"query_id": np.repeat(ids, each), "vec_id": np.concatenate([x for _, x in best]), "score": np.concatenate([s for s, _ in best])})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out, tiles = None, groups * ranges
    for first in range(0, tiles, WAVE_TILES):
        last = min(tiles, first + WAVE_TILES)
        found = rows.sparkSession.range(first, last, 1, last - first).mapInPandas(run, schema)
        both = found if out is None else found.unionByName(out.select("query_id", "vec_id", "score"))
        before, out = out, stored(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk-result")
        if before is not None:
            discard(before)
    discard(rows, manifest, grouped)
    discard_folder(rows.sparkSession, folder)
    return out
