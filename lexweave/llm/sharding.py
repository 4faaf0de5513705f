"""Sharding by a K-d tree, with DataFrame functions only.

The documents are split again and again at the weighted median along the widest metadata dimension until a leaf holds the
target bytes. Medians are found by histograms that are refined in rounds over a small stored table; only a row for each node
reaches the driver. Every dimension is a measure of the text or, for a column, the least value among the rows of equal text, so
equal texts have one place in the order (dimension, text hash, id) and a cut goes round them.

Near equal sizes and whole groups of equal texts exclude each other where a group is heavy: where going round the group at the
median would cost more than the tolerance, the next widest dimension is tried, and only if there is none left the group is cut
by id. The tree tells these cuts, and every row of such a group says so (`group_cut`).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm._common import bins_for, discard, quoted, running_in_bins, stored

#: Bins of a histogram round, shared by the nodes of a level; a node has at least LEAST_BINS.
BINS, LEAST_BINS = 1 << 16, 256
#: A cut moves aside for equal texts by at most this share of a shard's target.
TOLERANCE = 0.04
#: A small table of more rows is written and read instead of being part of a plan.
PLANNED_ROWS = 1000
LOWEST = -(1 << 63)
MEASURES = ("bytes", "chars")


@dataclass(frozen=True)
class Cut:
    """At one node: rows beyond (value, key, id) along dimension dim go right, to the shards from lo + left on. With id None
    the equal texts at the cut go right or left as a whole."""

    lo: int
    left: int
    dim: int
    value: int
    key: int
    id: int | None
    group_right: bool


@dataclass(frozen=True)
class Tree:
    """levels: the cuts of each level. groups: for dimensions that are columns, the coordinates of each text hash (stored)."""

    shards: int
    dims: tuple[str, ...]
    levels: tuple[tuple[Cut, ...], ...]
    groups: DataFrame | None = None

    def cut_groups(self) -> list[Cut]:
        """The cuts that go through equal texts."""
        return [c for cuts in self.levels for c in cuts if c.id is not None]


def facts(id_col: str, text_col: str, dims: tuple[str, ...]) -> dict[str, Column]:
    """What the tree knows of a row without its neighbours."""
    text = quoted(text_col).cast("string")
    own = {"bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    return {
        "__size": own["bytes"] + 1,
        "__key": F.xxhash64(text),
        "__id": F.coalesce(quoted(id_col).cast("long"), F.lit(LOWEST)),
        **{f"__d{i}": own[d] for i, d in enumerate(dims) if d in MEASURES},
    }


def _groups(df: DataFrame, dims: tuple[str, ...], text_col: str) -> DataFrame | None:
    """__key and the coordinates of the dimensions that are columns: for each text hash the least value that its rows have. Whole
    numbers and times are their own coordinate; values of any other type count by their place among all values."""
    columns = [(i, d) for i, d in enumerate(dims) if d not in MEASURES]
    if not columns:
        return None
    least = df.select(F.xxhash64(quoted(text_col).cast("string")).alias("__key"), *[quoted(d).alias(f"__v{i}") for i, d in columns]).groupBy("__key").agg(*[F.min(f"__v{i}").alias(f"__v{i}") for i, _ in columns])
    table = stored(least, "shard-groups")
    raw = table
    for i, d in columns:
        kind, value = dict(df.dtypes)[d], F.col(f"__v{i}")
        if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
            table = table.withColumn(f"__d{i}", value.cast("long"))
        elif kind in ("timestamp", "timestamp_ntz"):
            table = table.withColumn(f"__d{i}", F.unix_micros(value.cast("timestamp")))
        elif kind == "date":
            table = table.withColumn(f"__d{i}", F.unix_date(value).cast("long"))
        else:
            # ranges of the sorted values, stored so that a range keeps its number, and a running count over the ranges
            values = raw.select(value.alias(f"__r{i}")).filter(F.col(f"__r{i}").isNotNull()).distinct().repartitionByRange(F.col(f"__r{i}"))
            ranges = stored(values.withColumn("bin", F.spark_partition_id()), "shard-values")
            places = running_in_bins(ranges, [], "bin", [F.col(f"__r{i}")], {f"__d{i}": F.lit(1)}).select(f"__r{i}", F.col(f"__d{i}").cast("long").alias(f"__d{i}"))
            table = table.join(places, value == F.col(f"__r{i}"), "left").drop(f"__r{i}")
    # null comes before every value
    out = stored(table.select("__key", *[F.coalesce(F.col(f"__d{i}"), F.lit(LOWEST + 1)).alias(f"__d{i}") for i, _ in columns]), "shard-coordinates")
    discard(raw)
    return out


def _small(spark: SparkSession, rows: list[dict], kinds: dict[str, str]) -> DataFrame:
    """A table of a row for each node: a literal of the plan, or where there are many nodes a stored table."""
    schema = "array<struct<" + ",".join(f"{n}:{k}" for n, k in kinds.items()) + ">>"
    parts = [spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows[at : at + PLANNED_ROWS])), schema))) for at in range(0, max(1, len(rows)), PLANNED_ROWS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out if len(parts) == 1 else stored(out, "shard-nodes")


CUT = {"c_lo": "bigint", "c_left": "bigint", "c_dim": "int", "c_value": "bigint", "c_key": "bigint", "c_id": "bigint", "c_right": "boolean"}


def _along(dim: str, n_dims: int) -> Column:
    return F.get(F.array(*[F.col(f"__d{i}") for i in range(n_dims)]), F.col(dim))


def _descend(rows: DataFrame, cuts: tuple[Cut, ...], n_dims: int) -> DataFrame:
    """rows with `__lo` moved to the child of each row's node, and `__cut` set where the cut goes through the row's group."""
    spark = rows.sparkSession
    table = _small(spark, [dict(zip(CUT, (c.lo, c.left, c.dim, c.value, c.key, c.id, c.group_right), strict=True)) for c in cuts], CUT)
    held = rows.join(table, F.col("__lo") == F.col("c_lo"), "left")
    along = _along("c_dim", n_dims)
    at_cut = (along == F.col("c_value")) & (F.col("__key") == F.col("c_key"))
    in_group = F.when(F.col("c_id").isNull(), F.col("c_right")).otherwise(F.col("__id") > F.col("c_id"))
    right = (along > F.col("c_value")) | ((along == F.col("c_value")) & (F.col("__key") > F.col("c_key"))) | (at_cut & in_group)
    return held.withColumns({
        "__lo": F.col("__lo") + F.when(right, F.col("c_left")).otherwise(F.lit(0)),
        "__cut": F.col("__cut") | F.coalesce(at_cut & F.col("c_id").isNotNull(), F.lit(False)),
    }).drop(*CUT)


def _placed(df: DataFrame, dims: tuple[str, ...], groups: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """df with what the tree looks at; texts that groups does not know come first along its dimensions."""
    rows = df.withColumns({**facts(id_col, text_col, dims), "__lo": F.lit(0).cast("long"), "__cut": F.lit(False)})
    if groups is not None:
        rows = rows.join(groups, "__key", "left").withColumns({c: F.coalesce(F.col(c), F.lit(LOWEST + 1)) for c in groups.columns if c != "__key"})
    return rows


def with_shard(df: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """df with the shard of each row, found by going down the tree. Without dimensions that are columns nothing moves."""
    rows = _placed(df, tree.dims, tree.groups, id_col, text_col)
    for cuts in tree.levels:
        rows = _descend(rows, cuts, len(tree.dims))
    return rows.select(*[quoted(c) for c in df.columns if c != name], F.col("__lo").cast("int").alias(name))


def fit_tree(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("bytes", "chars"), id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> Tree:
    """The tree over df with the given number of shards, or as many as keep a leaf at target_bytes. A document counts its UTF-8
    bytes and one. Null dimensions come first, a null id before all others; an empty df gives a tree without cuts."""
    groups = _groups(df, dims, text_col)
    names = ["__size", "__key", "__id", *(f"__d{i}" for i in range(len(dims))), "__lo", "__cut"]
    table = stored(_placed(df, dims, groups, id_col, text_col).select(*names), "shard-facts")
    tree = _fit(table, shards, target_bytes, dims, tolerance, groups)[0]
    discard(table)
    return tree


def _fit(table: DataFrame, shards: int | None, target_bytes: int | None, dims: tuple[str, ...], tolerance: float, groups: DataFrame | None) -> tuple[Tree, DataFrame]:
    """The tree, and table gone down it."""
    n = len(dims)
    spans = [x for i in range(n) for x in (F.min(f"__d{i}").alias(f"lo{i}"), F.max(f"__d{i}").alias(f"hi{i}"))]
    found = table.groupBy("__lo").agg(F.sum("__size").alias("w"), *spans).collect()
    whole = found[0] if found else None
    shards = shards or max(1, -(-(whole["w"] if whole else 0) // (target_bytes or 1)))
    if whole is None:
        return Tree(shards, dims, (), groups), table
    rows, nodes, levels, room = table, {0: shards}, [], tolerance * whole["w"] / shards
    while any(k > 1 for k in nodes.values()):
        # the widest dimension of each node, measured by the whole table
        goals = {}
        for r in found:
            if nodes[r["__lo"]] > 1:
                width = {i: (r[f"hi{i}"] - r[f"lo{i}"]) / max(1, whole[f"hi{i}"] - whole[f"lo{i}"]) for i in range(n)}
                by_width = sorted((i for i in range(n) if width[i] or i == 0), key=lambda i, w=width: (-w[i], i))
                goals[r["__lo"]] = {"goal": r["w"] * (nodes[r["__lo"]] // 2) / nodes[r["__lo"]], "dims": [(i, r[f"lo{i}"], r[f"hi{i}"]) for i in by_width]}
        levels.append(tuple(_medians(rows, goals, nodes, n, room)))
        rows = _descend(rows, levels[-1], n)
        if len(levels) % 4 == 0:
            rows = stored(rows, "shard-level")
        nodes = {at: k for lo, k0 in nodes.items() for at, k in ([(lo, k0 // 2), (lo + k0 // 2, k0 - k0 // 2)] if k0 > 1 else [(lo, 1)])}
        if any(k > 1 for k in nodes.values()):
            found = rows.groupBy("__lo").agg(F.sum("__size").alias("w"), *spans).collect()  # a row for each node
    return Tree(shards, dims, tuple(levels), groups), rows


def _medians(rows: DataFrame, goals: dict[int, dict], nodes: dict[int, int], n_dims: int, room: float) -> list[Cut]:
    """A cut for each node: along its widest dimension, or where many equal texts stand at that median, along the next one at
    whose median they do not; if they stand at all of them, through them by id."""
    along = _along("g_dim", n_dims)
    same = along == F.col("g_value")
    whole = {"lo": LOWEST, "hi": (1 << 63) - 1}
    cuts, heavy, open_nodes = [], {}, dict(goals)
    for turn in range(n_dims):
        state = {at: {"goal": g["goal"], "below": 0} | dict(zip(("dim", "lo", "hi"), g["dims"][turn], strict=True)) for at, g in open_nodes.items() if turn < len(g["dims"])}
        if not state:
            break
        _narrow(rows, state, along, F.lit(True), ("dim",))
        state = {at: s | {"value": s["lo"]} | whole for at, s in state.items()}
        _narrow(rows, state, F.col("__key"), same, ("dim", "value"))
        for at, s in state.items():
            s["key"] = s["lo"]
            before, after = abs(s["goal"] - s["below"]), abs(s["below"] + s["here"] - s["goal"])
            if min(before, after) <= room:
                cuts.append(Cut(at, nodes[at] // 2, s["dim"], s["value"], s["key"], None, before < after))
                del open_nodes[at]
                heavy.pop(at, None)
            else:
                heavy.setdefault(at, s)
    if heavy:
        heavy = {at: s | whole for at, s in heavy.items()}
        _narrow(rows, heavy, F.col("__id"), same & (F.col("__key") == F.col("g_key")), ("dim", "value", "key"))
        for at, s in heavy.items():
            before, after = abs(s["goal"] - s["below"]), abs(s["below"] + s["here"] - s["goal"])
            # rows of equal ids and texts stay together; the nearer side takes them
            cuts.append(Cut(at, nodes[at] // 2, s["dim"], s["value"], s["key"], s["lo"] - 1 if before < after and s["lo"] > LOWEST else s["lo"], False))
    return cuts


def _narrow(rows: DataFrame, state: dict[int, dict], key: Column, where: Column, known: tuple[str, ...]) -> None:
    """Finds for each node of state the value of key at which the summed sizes reach the goal: lo becomes that value, below the
    sizes before it, here its own. Each round is one pass with a histogram for each node."""
    open_nodes = dict(state)
    while open_nodes:
        fields = ["lo", "hi", *known]
        kinds = {"g_node": "bigint", "g_rest": "double", **{f"g_{f}": "int" if f == "dim" else "bigint" for f in fields}}
        table = _small(rows.sparkSession, [{"g_node": n, "g_rest": float(s["goal"] - s["below"])} | {f"g_{f}": s[f] for f in fields} for n, s in open_nodes.items()], kinds)
        step = F.ceil((F.col("g_hi").cast("double") - F.col("g_lo").cast("double") + 1) / max(LEAST_BINS, BINS // len(open_nodes)))
        # in doubles, as the whole range of 64 bits has no length in 64 bits; rounding keeps the order of bins
        bin_ = F.floor((key.cast("double") - F.col("g_lo").cast("double")) / step)
        held = rows.join(table, F.col("__lo") == F.col("g_node")).filter(where & key.between(F.col("g_lo"), F.col("g_hi")))
        bins = held.groupBy("g_node", bin_.alias("bin")).agg(F.sum("__size").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.first("g_rest").alias("rest"))
        run = Window.partitionBy("g_node").orderBy("bin")
        summed = bins.withColumn("upto", F.sum("w").over(run)).withColumn("next", F.lead("bin").over(run))
        first = summed.filter((F.col("upto") >= F.col("rest")) | F.col("next").isNull()).groupBy("g_node").agg(F.min_by(F.struct("lo", "hi", "w", "upto"), "bin").alias("b"))
        for r in first.collect():  # a row for each node
            s, b = open_nodes[r["g_node"]], r["b"]
            s |= {"lo": b["lo"], "hi": b["hi"], "below": s["below"] + b["upto"] - b["w"], "here": b["w"]}
            if s["lo"] == s["hi"]:
                del open_nodes[r["g_node"]]


def shard_documents(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("bytes", "chars"), id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, shard, slot and group_cut of each document: shards of near equal bytes,
    each with its slots from 0 without gaps. group_cut is true for the rows of equal texts that stand in several shards, as no
    other cut was near enough to equal sizes.

    A null text has size 1 and the checksum of the empty text. Repeated rows are kept and get slots of their own. An empty df
    gives an empty result, and further columns are not used unless dims names them."""
    text = quoted(text_col).cast("string")
    groups = _groups(df, dims, text_col)
    names = ["__size", "__key", "__id", *(f"__d{i}" for i in range(len(dims))), "__lo", "__cut"]
    own = df.withColumns({"__doc": quoted(id_col), "__crc": F.coalesce(F.crc32(text), F.lit(0)).cast("long")})
    table = stored(_placed(own, dims, groups, id_col, text_col).select("__doc", "__crc", *names), "shard-facts")
    tree, rows = _fit(table, shards, target_bytes, dims, tolerance, groups)
    bins = bins_for(table.count() // tree.shards)
    placed = rows.select(F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__lo").cast("int").alias("shard"), F.col("__cut").alias("group_cut"), F.pmod(F.xxhash64("__id", "__key"), F.lit(bins)).alias("bin"))
    out = running_in_bins(placed, ["shard"], "bin", [F.col("doc_id"), F.col("text_crc32")], {"slot": F.lit(1)})
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "group_cut")
