"""MinHash near-duplicate detection with circulant permutations.

Two permutations make the whole signature: the first scatters the shingles over a fixed universe, the second, shifted circularly
by one place for each coordinate, ranks them. Bands of coordinates make candidate pairs, every link is confirmed on the full
shingle sets, and linked documents form components.

A band's bucket may hold any number of documents, so its pairs are never listed. First every member of a bucket is compared
with one pivot of it, the member that shares most buckets, and linked documents merge. What is left in a bucket of several
components is narrowed by an exact prefix filter: under any order of the shingles, two linked sets share one among the first few
of the smaller set (few, as the partner is no smaller) and the first of the larger one (more, as the partner may be smaller).
Here the shingles that the pivot lacks come first, so sets that are each too far from the pivot begin with what is theirs alone:
where texts of one template are just too unlike, the template does not reach into the short prefixes, and hardly a pair is left to
compare; none that could be linked is lost.

Shingles are compared by their 64-bit hashes, so two unlike ones count as equal with a probability of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import discard, quoted, release_memory, stored, take_worker, text_slices

#: Documents are linked from this similarity on where nothing else is asked for.
SIMILARITY = (80, 100)
WORDS = 5
BANDS, BAND_ROWS = 30, 5
#: Bytes of texts whose shingles are held at a time.
SLICE = 2 << 20
#: Places of the universe over which the shingles are scattered.
UNIVERSE = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.StringArray, width: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of width words, A-Z as a-z; a text of fewer words has one
    shingle of them all, a text without words none."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    table = split.flatten().dictionary_encode()
    index, ends = table.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ends - ends[0]
    words = table.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    if "" in words:  # white space at an edge splits off an empty word
        full = index != words.index("")
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
        index = index[full]
    h = hashes[index]
    with np.errstate(over="ignore"):
        rolled = h[: max(0, len(h) - width + 1)].copy()
        for k in range(1, width):
            rolled = rolled * _B + h[k : len(h) - width + 1 + k]
        rolled = _mixed(rolled)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                value = np.uint64(b - a)
                for x in h[a:b]:
                    value = value * _B + x
                out.append(_mixed(np.array([value ^ np.uint64(0xA5A5A5A5A5A5A5A5)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class CirculantMinHash:
    """Signatures of coordinates = bands * rows values; coordinate k ranks a shingle at place p by second[(p + k) mod universe]."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS, universe: int = UNIVERSE, seed: int = 7):
        random = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, self.bits = bands, rows, universe.bit_length() - 1
        self.first = random.permutation(universe).astype(np.uint32)
        second = random.permutation(universe).astype(np.uint32)
        k = bands * rows
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[: k - 1])), k)
        self.salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _B)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.first[shingles >> np.uint64(64 - self.bits)]
        out = self.shifted[places[:2048]].min(0)
        for at in range(2048, len(places), 2048):
            np.minimum(out, self.shifted[places[at : at + 2048]].min(0), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each signature."""
        parts = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(self.salt, parts.shape[:2])
            for r in range(self.rows):
                key = _mixed(key * _B + parts[:, :, r])
        return key


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (size of the shingle set), k1 and k2 (a hash of the whole set), bands (a key for each band) of each row."""
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        take_worker(__name__)
        minhash = CirculantMinHash()
        none = np.zeros(minhash.bands * minhash.rows, np.uint32)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE):
                sets = shingle_sets(texts, width)
                keys = minhash.band_keys(np.array([minhash.signature(s) if len(s) else none for s in sets])).view(np.int64)
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * minhash.bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), bands], names=["id", "n", "k1", "k2", "bands"])
        release_memory()

    return stored(rows.mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>"), "minhash-sketches")


def _compared(pairs: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int], prefixes: bool) -> DataFrame:
    """For pairs (pivot, id): those that are linked, or with prefixes the first shingles of each id in its pivot's order, as
    (pivot, id, n, token, place).

    A pivot's partners are dealt over as many tasks as they need, each with a copy of the pivot's text."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / 400).cast("int").alias("parts"))
    members = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"), "id")
    pivots = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("pivot").alias("id"))
    sent = members.unionByName(pivots).join(texts.select(F.col("id").alias("of"), "text"), F.col("id") == F.col("of"))
    dealt = sent.select("pivot", "part", "member", "id", "text").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member", "id")
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(__name__)
        pivot, of_pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(4)]
            for at, texts in text_slices(batch.column(4), SLICE):
                out = []
                for k, s in enumerate(shingle_sets(texts, width), at):
                    if not ids[2][k]:
                        pivot, of_pivot = ids[0][k], s
                        continue
                    if pivot != ids[0][k]:
                        raise ValueError("a pivot's text is missing")
                    if prefixes:
                        inside = np.isin(s, of_pivot, assume_unique=True)
                        order = np.concatenate((s[~inside], s[inside]))[: len(s) - -(-len(s) * num // den) + 1]
                        out.append((pivot, ids[3][k], len(s), order.view(np.int64)))
                    elif linked(s, of_pivot, similarity):
                        out.append((pivot, ids[3][k]))
                if prefixes:
                    sizes = [len(x[3]) for x in out]
                    head = [pa.array(np.repeat(np.array([x[i] for x in out], np.int64), sizes)) for i in range(3)]
                    tokens = np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.int64)
                    places = np.concatenate([np.arange(n) for n in sizes]) if out else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([*head, pa.array(tokens), pa.array(places.astype(np.int64))], names=["pivot", "id", "n", "token", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["pivot", "id"])
        release_memory()

    return dealt.mapInArrow(run, "pivot long, id long, n long, token long, place long" if prefixes else "pivot long, id long")


def linked(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets are at least as similar as asked for."""
    num, den = similarity
    if den * min(len(a), len(b)) < num * max(len(a), len(b)) or not len(a):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges (a, b). Alternating large and small stars: each round
    hangs every node's larger, then smaller neighbours on its smallest one. Only a count and a checksum reach the driver."""

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.min("b").alias("m"))

    now = stored(edges.filter("a <> b").select("a", "b").distinct(), "star")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both).select("a", F.least("a", "m").alias("m")), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.join(least(down), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least(down).select("a", F.col("m").alias("b")))
        before, now = now, stored(small.filter("a <> b").distinct(), "star")
        discard(before)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == last:
            return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = sign


#: Rows of one (pivot, token) from which on they are dealt by set size and over several tasks.
HOT_TOKEN = 2000


def _close_pairs(tokens: DataFrame, similarity: tuple[int, int], hot: int = HOT_TOKEN) -> DataFrame:
    """Pairs (pivot, id) of documents of different components that may be linked, the smaller id first, out of prefixes (pivot,
    id, n, token, place, comp).

    The smaller set of a pair (by size, then id) meets the larger one at a token of its short prefix. From what remains behind
    the token on, each side knows the largest partner it could be linked with; under a token that many documents share, sizes are
    part of the join, so only partners of a possible size meet, and they do so in several tasks. Members of the largest
    component under a token are never matched among themselves."""
    num, den = similarity
    rest = F.col("n") - F.col("place")
    # a partner of m shingles needs a common part of (n + m) * num / (num + den), which the rest must hold
    most = F.least(F.floor(rest * (num + den) / num) - F.col("n"), F.floor(F.col("n") * den / num))
    sized = tokens.withColumn("most", most.cast("long")).filter(F.col("most") * den >= F.col("n") * num)
    sized = sized.withColumn("short", F.col("most") >= F.col("n"))
    by_comp = sized.groupBy("pivot", "token", "comp").agg(F.count("*").alias("c"), F.count_if("short").alias("s"))
    shared = by_comp.groupBy("pivot", "token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    shared = shared.filter("comps > 1 AND s > 0").select("pivot", "token", "main", F.when(F.col("c") > hot, F.ceil(F.col("c") / hot)).otherwise(F.lit(1)).cast("int").alias("parts"))
    held = sized.join(shared, ["pivot", "token"])

    def size_class(n: Column) -> Column:
        """Sizes of a hundredth more or less; one class where a token is not hot."""
        return F.when(F.col("parts") > 1, F.floor(F.log(n) * 100)).otherwise(F.lit(0)).cast("long")

    classes = F.sequence(size_class(F.col("n")), size_class(F.col("most")))
    small = held.filter("short").withColumn("class", F.explode(classes)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = held.withColumn("class", size_class(F.col("n"))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = (a("pivot") == b("pivot")) & (a("token") == b("token")) & (a("class") == b("class")) & (a("part") == b("part"))
    could = (a("comp") != b("comp")) & (F.struct(a("n"), a("id")) < F.struct(b("n"), b("id"))) & (b("n") <= a("most")) & (a("n") <= b("most"))

    def met(few: DataFrame, many: DataFrame) -> DataFrame:
        return few.alias("a").join(many.alias("b"), same & could).select(F.least(a("id"), b("id")).alias("pivot"), F.greatest(a("id"), b("id")).alias("id"))

    return met(small.filter("comp <> main"), large).unionByName(met(small.filter("comp = main"), large.filter("comp <> main"))).distinct()


def _fits(n: Column, m: Column, similarity: tuple[int, int]) -> Column:
    num, den = similarity
    return F.least(n, m) * den >= F.greatest(n, m) * num


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept (it is that id) of each row of df.
    Two documents are linked if their sets' intersection is at least similarity (a fraction) of their union.

    A text without words (or null) has no shingles and no links. An id is taken to name one text: rows that share an id are
    each judged by their own text, and the id links these texts only where it is the smallest of both texts' copies. A row
    without an id links nothing, has no component and is kept. Repeated rows get equal answers, an empty df an empty result;
    other columns are not used."""
    docs = sketches(df, id_col, text_col, width)
    # texts with equal sets are one class from here on, and stand for it by their smallest id
    classes = docs.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keyed = classes.select("id", "n", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = stored(keyed.join(crowded, "key").select("key", "id", "n", "c"), "minhash-members")
    shared = members.groupBy("id").agg(F.sum("c").alias("score"))
    pivots = members.join(shared, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("score", -F.col("id"))).alias("p"))
    with_pivot = stored(members.join(pivots, "key").select("key", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")), "minhash-pivots")
    texts = stored(df.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).join(members.select("id").distinct(), "id", "left_semi"), "minhash-texts")
    first = with_pivot.filter("id <> pivot").filter(_fits(F.col("n"), F.col("pivot_n"), similarity)).select("pivot", "id").distinct()
    links = _compared(first, texts, width, similarity, False).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    merged = stored(components(links), "minhash-components")

    # buckets that still hold several components
    placed = with_pivot.join(merged, F.col("id") == F.col("node"), "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    left = placed.join(several, "key", "left_semi").filter("id <> pivot").select("pivot", "id", "comp").distinct()
    left = stored(left, "minhash-open")
    tokens = _compared(left.select("pivot", "id"), texts, width, similarity, True).join(left, ["pivot", "id"])
    tokens = stored(tokens, "minhash-prefixes")
    pairs = _close_pairs(tokens, similarity)
    late = _compared(pairs, texts, width, similarity, False).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    final = stored(components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)), "minhash-components")
    discard(members, with_pivot, texts, merged, left, tokens)

    named = classes.select("k1", "k2", F.col("id").alias("rep")).join(final, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("of_class"))
    out = docs.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("of_class"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
