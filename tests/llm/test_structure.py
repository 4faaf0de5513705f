"""Sharding, mixing, near duplicates, fingerprints, search and the pipeline."""

import base64
import hashlib
import io
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import merkle, minhash, mixing, queries, secret_scan, sharding, sql, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


def check_shards(rows, texts, shards, tolerance):
    total, slots, sizes = 0, defaultdict(list), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        total += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(sizes[i] - total / shards) for i in range(shards)) <= tolerance
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_shards_of_all_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op1_sharding(spark, sf_dir).collect()
    check_shards(rows, list(texts.values()), 8, 2 * max(len(t.encode()) for t in texts.values()))
    assert all(len(p) == 1 for p in places_of(rows, texts).values())  # equal texts stand together
    again = queries.op1_sharding(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def places_of(rows, texts):
    out = defaultdict(set)
    for r in rows:
        out[texts[r["doc_id"]]].add(r["shard"])
    return out


def test_equal_texts_of_unlike_metadata_stand_together(spark):
    """Two languages, sources and sizes for each text, most of which share their first bytes."""
    rnd = random.Random(9)
    rows = []
    for i in range(300):
        text = f"text number {i} " + "é" * rnd.randrange(60)
        rows += [(2 * i, text, rnd.choice(["fr", None]), "a common beginning " + str(i % 7), 1.0001), (2 * i + 1, text, "en", "a common beginning " + str(i % 5), 1.0002)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    texts = {r[0]: r[1] for r in rows}
    for dims in (("bytes", "chars", "lang"), ("source", "lang"), ("score", "chars")):
        out = sharding.shard_documents(df, shards=8, dims=dims).collect()
        check_shards(out, list(texts.values()), 8, 400)
        assert all(len(p) == 1 for p in places_of(out, texts).values()) and not any(r["group_cut"] for r in out)


def test_shards_of_a_hot_text(spark):
    texts = ["copy of one text"] * 900 + [f"text {i} " + "x" * (i % 50) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shards in (8, 5):
        rows = sharding.shard_documents(df, shards=shards).collect()
        check_shards(rows, texts, shards, 120)
        # a group that fills several shards is cut, and its rows say so; no other is
        assert {texts[r["doc_id"]] for r in rows if r["group_cut"]} == {"copy of one text"} == {t for t, p in places_of(rows, dict(enumerate(texts))).items() if len(p) > 1}
    assert sharding.fit_tree(df, shards=8).cut_groups()
    small = sharding.shard_documents(df, target_bytes=4000)
    assert small.groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 4200


def test_cuts_are_weighted_medians(spark):
    """Every cut against the sorted sizes of its node, along the dimension that is widest there."""
    rnd = random.Random(10)
    rows = [(i, "".join(rnd.choice("aé") for _ in range(rnd.randrange(1, 4000)))) for i in range(500)]
    tree = sharding.fit_tree(spark.createDataFrame(rows, "doc_id long, text string"), shards=8)
    facts = {i: (len(t.encode()), len(t)) for i, t in rows}
    whole = [max(f[d] for f in facts.values()) - min(f[d] for f in facts.values()) for d in (0, 1)]
    nodes = {0: (list(facts), 8)}
    for cuts in tree.levels:
        goals = {}
        for c in cuts:
            members, k = nodes[c.lo]
            width = [(max(facts[i][d] for i in members) - min(facts[i][d] for i in members)) / whole[d] for d in (0, 1)]
            assert c.dim == (0 if width[0] >= width[1] else 1) and c.left == k // 2
            by = sorted(members, key=lambda i: facts[i][c.dim])
            goal = sum(facts[i][0] + 1 for i in members) * (k // 2) / k
            total, median = 0, None
            for i in by:
                total += facts[i][0] + 1
                if total >= goal:
                    median = facts[i][c.dim]
                    break
            assert c.value == median
            goals[c.lo] = goal
        placed = sharding.with_shard(spark.createDataFrame(rows, "doc_id long, text string"), sharding.Tree(8, tree.dims, tree.levels[: tree.levels.index(cuts) + 1]))
        nodes = {}
        for r in placed.collect():
            nodes.setdefault(r["shard"], ([], 8 >> (tree.levels.index(cuts) + 1)))[0].append(r["doc_id"])
        for lo, goal in goals.items():
            assert abs(sum(facts[i][0] + 1 for i in nodes[lo][0]) - goal) <= max(f[0] for f in facts.values())
    assert len(nodes) == 8


def test_many_nodes_are_a_table(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PLANNED_ROWS", 3)
    texts = [f"text {i} " + "x" * (i * 7 % 90) for i in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_shards(sharding.shard_documents(df, shards=32).collect(), texts, 32, 150)


def test_shards_of_odd_texts(odd, empty):
    texts = [r["text"] for r in odd.select("text").collect()]
    check_shards(sharding.shard_documents(odd, shards=3, dims=("chars", "lang", "source", "n_chars")).collect(), texts, 3, 160_000)
    tree = sharding.fit_tree(odd, shards=3, dims=("bytes", "lang"))
    placed = sharding.with_shard(odd, tree)
    assert placed.count() == odd.count() and set(placed.columns) == {*odd.columns, "shard"}
    assert sharding.shard_documents(empty, shards=8, dims=("bytes", "lang")).count() == 0
    same = odd.sparkSession.createDataFrame([(1, "a", "x")] * 40, "doc_id long, text string, lang string")
    assert sharding.shard_documents(same, shards=4).count() == 40


def plain_mix(rows, weights, share, most):
    """rows: (doc_id, source, size). The targets by source, by capping again and again."""
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, target = set(order), share * sum(size.values()), {}
    while left:
        spread = (total - sum(target.values())) / sum(weight[s] for s in left)
        above = [s for s in left if spread * weight[s] >= most * size[s]]
        if not above:
            return size, target | {s: spread * weight[s] for s in left}
        target |= {s: most * size[s] for s in above}
        left -= set(above)
    return size, target


def check_mix(docs, rows, weights=(3, 1, 2), share=1.5, most=2.0):
    size, target = plain_mix([(r["doc_id"], r["source"], words(r["text"])) for r in docs], weights, share, most)
    source = {r["doc_id"]: r["source"] for r in docs}
    taken = Counter()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r["doc_id"]), words(r["text"])) for r in docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= most * r["size"]
        taken[s] += r["taken"]
    return {s: (taken[s], target[s]) for s in target}


def test_mix_of_all_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    rows = queries.op6_mixing(spark, sf_dir).collect()
    assert all(t == int(goal) for t, goal in check_mix(docs, rows).values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op6_mixing(spark, sf_dir).collect()))


def test_mix_of_odd_documents(odd, empty):
    plan = mixing.plan_mix(odd.filter("doc_id IS NOT NULL AND doc_id <> 500"))
    docs = odd.filter("doc_id IS NOT NULL AND doc_id <> 500").collect()
    for taken, goal in check_mix(docs, plan.taken().collect()).values():
        assert abs(taken - goal) <= 61  # repeated rows share the cut
    mixed = mixing.plan_mix(odd).documents(odd)
    assert mixed.columns == odd.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2 * 3
    assert mixing.plan_mix(empty).taken().count() == 0 and mixing.plan_mix(empty).documents(empty).count() == 0
    lone = odd.sparkSession.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.plan_mix(lone).taken().collect()] == [0, 0]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows, num, den):
    sets, parent = defaultdict(list), {}
    for i, text in rows:
        sets[i].append(shingles(text))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i in sets for s in sets[i]}


def found_components(df, similarity):
    return {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, similarity=similarity).collect()}


def test_near_duplicates_of_all_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = queries.op3_near_duplicates(spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], 85, 100)
    assert len(rows) == docs.count()


def near_copies(n, seed):
    rnd = random.Random(seed)
    base, out = [f"w{rnd.randrange(3000)}" for _ in range(120)], []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 2, 3, 4])):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(3000)}"
        out.append((3 * i + 1, " ".join(w)))
    return out


@pytest.mark.parametrize("similarity", [(85, 100), (80, 100)])
def test_near_duplicates_lose_no_link_of_a_crowded_bucket(spark, similarity):
    rows = near_copies(250, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(df, similarity) == plain_components(rows, *similarity)


def form_letters(n, template, own, seed):
    """Texts of one template with as many words of their own as own() says, in one place."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(template)]
    return [(i, " ".join(base[: template // 2] + [f"w{rnd.randrange(10**9)}" for _ in range(own(rnd))] + base[template // 2 :])) for i in range(n)]


@pytest.mark.parametrize("own", [lambda r: 24, lambda r: r.choice([20, 21, 24, 26, 28, 40]), lambda r: r.choice([19, 26, 26, 26, 26])])
def test_near_duplicates_of_form_letters(spark, monkeypatch, own):
    """Families whose pairs are just below the threshold, some of them linked through shorter letters, with hot tokens dealt."""
    monkeypatch.setattr(minhash._close_pairs, "__defaults__", (8,))
    rows = form_letters(160, 300, own, 11)
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string"), (85, 100)) == plain_components(rows, 85, 100)


def test_many_form_letters_make_few_candidates(spark, monkeypatch):
    """20,000 letters of similarity 0.84: no pair of them is compared beside those with their pivots."""
    counted = []

    def close_pairs(tokens, similarity, hot=minhash.HOT_TOKEN, plain=minhash._close_pairs):
        out = plain(tokens, similarity, hot)
        counted.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_close_pairs", close_pairs)
    rows = form_letters(20_000, 300, lambda r: 24, 12)
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.83 < len(a & b) / len(a | b) < 0.85
    began = time.time()
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), similarity=(85, 100))
    assert out.filter("kept").count() == 20_000
    assert counted[0] <= 100 and time.time() - began < 300  # a random word may stand in two letters


def test_near_duplicates_of_odd_texts(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    found = found_components(odd, (85, 100))
    assert {f for f in found if f[0] is not None} == plain_components([r for r in rows if r[0] is not None], 85, 100)
    assert {f[2:] for f in found if f[0] is None} == {(None, True)}
    assert minhash.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(4)
    c = minhash.CirculantMinHash()
    both, a, b = (rnd.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    same = (c.signature(np.concatenate((both, a))) == c.signature(np.concatenate((both, b)))).mean()
    assert abs(same - 0.8) < 0.12
    assert c.shifted.shape == (minhash.UNIVERSE, minhash.BANDS * minhash.BAND_ROWS)
    assert c.shifted[5, 3] == c.shifted[8, 0] and c.shifted[minhash.UNIVERSE - 1, 1] == c.shifted[0, 0]


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 70)] + [(200, 100), (300, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, 100: 100, 200: 100, 300: 100}


def plain_leaves(paragraph):
    """Sentences, character by character; those of over 100 characters cut behind chosen words."""
    out, at, n = [], 0, len(paragraph)
    while at < n:
        end = at
        while end < n and paragraph[end] not in ".!?":
            end += 1
        while end < n and paragraph[end] in ".!?":
            end += 1
        while at < end < n and paragraph[end].isspace():
            end += 1
        out.append(paragraph[at:end])
        at = end
    for leaf in out:
        if len(leaf) <= 100 or not leaf.strip():
            yield leaf
            continue
        ends = [i for i in range(1, len(leaf) + 1) if i == len(leaf) or (leaf[i - 1].isspace() and not leaf[i].isspace() and leaf[:i].strip())]
        begin, words = 0, 0
        for a, b in zip([0, *ends], ends, strict=False):
            words += 1
            if words == 16 or b == len(leaf) or zlib.crc32(leaf[a:b].encode()) % 8 == 0:
                yield leaf[begin:b]
                begin, words = b, 0


def plain_print(text):
    """The fingerprint out of a tree of nested lists: sections of paragraphs of sentences."""
    def digest(data, level=b""):
        return hashlib.blake2b(data, digest_size=16, person=level).digest()

    sections, fresh = [], True
    for paragraph in text.split("\n") if text else []:
        leaves = [digest(x.encode()) for x in plain_leaves(paragraph)]
        whole = digest(b"".join(leaves), b"paragraph")
        if fresh or paragraph.startswith("#"):
            sections.append([])
        sections[-1].append((whole, leaves))
        fresh = not paragraph.strip() or whole[0] % 8 == 0
    tops = [digest(b"".join(whole for whole, _ in s), b"section") for s in sections]

    def told(data):
        return base64.b64encode(data).decode().replace("/", "_")

    return "/".join([digest(b"".join(tops), b"root").hex(), *(told(top[:3]) + ":" + ",".join("".join(told(x[:3]) for x in leaves) for _, leaves in s) for top, s in zip(tops, sections, strict=True))])


def plain_likeness(a, b):
    """Twice the sentences in common over all sentences."""
    if a.split("/")[0] == b.split("/")[0]:
        return 1.0
    left, right = (sorted(x[i : i + 4] for s in p.split("/")[1:] for x in s.split(":")[1].split(",") for i in range(0, len(x), 4)) for p in (a, b))
    rest, both = list(right), 0
    total = len(left) + len(right)
    counts = Counter(rest)
    for x in left:
        if counts[x]:
            counts[x] -= 1
            both += 1
    return min(2 * both / total, 1 - 1 / (total + 1)) if total else 0.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a. ", "b!", "?? ", "word ", "\n", "\n\n", "# head", " ", "é", "x" * 30 + " ", "many words in a row without an end ", "\u3000", "/"]), max_size=30).map("".join))
def test_fingerprints_equal_a_plain_tree(text):
    assert merkle.fingerprint(text) == plain_print(text)


def check_edits(df):
    told = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).collect()
    docs = [(r["doc_id"], r["text"]) for r in sorted(told, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["hash"]))]
    rows = merkle.edit_study(df).collect()
    want = Counter()
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_print, (text, new, following))
        want[i, len(text), new, a, b, plain_likeness(a, b), plain_likeness(a, c)] += 1
    assert Counter(map(tuple, rows)) == want
    return rows


def test_fingerprints_of_all_documents(spark, sf_dir):
    rows = check_edits(queries.table(spark, sf_dir, "documents"))
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.3 > 0.1 > sum(r["near_next"] for r in rows) / len(rows)
    digests = {r["doc_id"]: r["edited_sha256"] for r in queries.op4_fingerprints(spark, sf_dir).collect()}
    assert digests == {r["doc_id"]: hashlib.sha256(r["edited"].encode()).hexdigest() for r in rows}


def test_fingerprints_of_odd_texts(odd, empty):
    check_edits(odd)
    check_edits(odd.limit(1))
    assert merkle.edit_study(empty).count() == 0 and merkle.fingerprints(empty).count() == 0
    assert merkle.fingerprints(odd).filter("text IS NULL").first()["fingerprint"] == merkle.fingerprint("")


def test_fingerprints_locate_edits():
    lines = [f"Paragraph {i} begins. It has two sentences." for i in range(30)]
    before = "\n".join(lines)
    lines[17] = "Paragraph 17 begins. It was changed."
    a, b = merkle.fingerprint(before), merkle.fingerprint("\n".join(lines))
    assert a[:32] != b[:32] and len(merkle.locate_edits(a, b)) == 1 and merkle.locate_edits(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1 == merkle.likeness(a, a)
    assert merkle.fingerprint("a. b.") != merkle.fingerprint("b. a.") and merkle.likeness(*map(merkle.fingerprint, ("a. b. ", "b. a. "))) < 1


def plain_top(rows, k):
    vectors = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, v in vectors.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors.items() if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_top_k_of_all_vectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    assert {tuple(r) for r in queries.op8_top_k(spark, sf_dir).collect()} == plain_top(rows, 5)


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (7, 2)])
def test_top_k_of_odd_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
    rnd = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rnd.choice([-1.5, -0.25, 0.0, 0.5, 3.0], 6)]) for i in range(120)]
    rows += [(150, None), (200, [1.0, None, 2.0]), (250, [float("nan")] * 6), (300, [float("inf")] * 6), (350, []), (400, [1.0, 2.0]), (None, [1.0] * 6), (3, None)]
    rows += [rows[7], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == plain_top(rows, 5)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()} == plain_top(rows[:3], 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_top_k_sql_agrees_on_repeated_rows(spark, tmp_path):
    import duckdb

    rows = [(i % 60, [float(i % 7), -float(i % 5), 0.5]) for i in range(150)] + [(None, [1.0, 1.0, 1.0]), (70, None), (100, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    held = duckdb.connect()
    held.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = held.sql(sql.OP8_TOP_K).fetchall()
    assert sorted(tuple(r) for r in queries.op8_top_k(spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["normal", "uniform", "clustered", "ties"])
def test_the_search_stops_on_proof_and_is_exact(kind):
    rnd = np.random.default_rng(13)
    n, dims = 4000, 32
    vectors = {"normal": rnd.normal(0, 60, (n, dims)), "uniform": rnd.uniform(-200, 200, (n, dims)), "clustered": rnd.normal(0, 200, (20, dims))[rnd.integers(0, 20, n)] + rnd.normal(0, 20, (n, dims)), "ties": rnd.integers(-2, 3, (n, dims))}[kind].astype(np.int64)
    index = topk.ImpactIndex.of_bytes(topk.ImpactIndex(np.arange(n)[::-1], vectors[::-1]).to_bytes())
    read = []
    for q in range(0, n, 200):
        scores, ids = index.search(vectors[q], 5, q)
        read.append(index.read)
        exact = vectors @ vectors[q]
        exact[q] = -(1 << 62)
        want = np.lexsort((np.arange(n), -exact))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
        # with the bar of another block only what reaches it has to be found
        bar = int(exact[want[2]])
        scores, ids = index.search(vectors[q], 5, q, bar)
        assert ids.tolist()[: int((exact >= bar).sum())] == want.tolist()[: int((exact >= bar).sum())]
    print(kind, sum(read) / len(read))
    assert kind != "clustered" or sum(read) / len(read) < 0.7


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    told = corpus_pipeline.language(spark, docs, sf_dir)
    assert told.columns == docs.columns and told.count() >= 0.99 * len(before)
    one = corpus_pipeline.near_duplicates(spark, told, sf_dir)
    kept = {i for i, _, c, k in plain_components([(r["doc_id"], r["text"]) for r in told.collect()], 80, 100) if k}
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(kept)
    clean = corpus_pipeline.secrets(spark, one, sf_dir)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes and clean.count() == one.count()
    assert secret_scan.find_secrets(clean).filter("size(secrets) > 0").count() == 0
    mixed = corpus_pipeline.mixture(spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    size, target = plain_mix([(r["doc_id"], r["source"], words(r["text"])) for r in clean.collect()], (3, 1, 2), 1.5, 2.0)
    got = Counter()
    longest = max(words(r["text"]) for r in clean.collect())
    for r in mixed.collect():
        got[r["source"]] += words(r["text"])
    assert all(target[s] - 1 <= got[s] <= target[s] + longest for s in size)
    last = corpus_pipeline.tokens(spark, mixed, sf_dir)
    assert last.count() == mixed.count() and last.filter("NOT round_trip").count() == 0


def test_pipeline_of_odd_documents(odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark = odd.sparkSession
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    rows = docs.collect()
    assert rows and all(r["n_tokens"] >= 3 for r in rows)
    once = corpus_pipeline.near_duplicates(spark, odd, sf_dir)
    assert once.columns == odd.columns
    assert once.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert once.filter("doc_id IS NULL").count() == 2


def test_pipeline_run(spark, sf_dir):
    """All rows of the whole run against the stages one by one, near duplicates by brute force, and the library's ids."""
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = corpus_pipeline.language(spark, docs, sf_dir)
    kept = {i for i, _, _, k in plain_components([(r["doc_id"], r["text"]) for r in told.collect()], 80, 100) if k}
    clean = corpus_pipeline.secrets(spark, told.filter(F.col("doc_id").isin(*kept)), sf_dir)
    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    want = Counter()
    for r in corpus_pipeline.mixture(spark, clean, sf_dir).collect():
        want[r["doc_id"], r["source"], np.array(model.encode(r["text"], add_bos=True, add_eos=True), "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["source"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_tiles_stay_within_their_bound_and_are_merged(spark, monkeypatch):
    rnd = random.Random(21)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(7, [0.5] * 6), (7, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    for name, value in (("BLOCK_ROWS", 10), ("BLOCK_QUERIES", 8), ("RANGE_BLOCKS", 3), ("WAVE_TILES", 7)):
        monkeypatch.setattr(topk, name, value)
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()} == want
    scores = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows[:300]}
    for q, rank, i, score in want:
        if q not in (7,) and i not in (7,):
            assert score == sum(a * b for a, b in zip(scores[q], scores[i], strict=True))


def test_files_of_a_tile_can_be_written_again(spark, tmp_path):
    rnd = random.Random(22)
    rows = spark.createDataFrame([(i, [rnd.randrange(-200, 200) for _ in range(4)]) for i in range(200)], "id long, v array<bigint>")
    folder = f"file://{tmp_path}/index"

    def files():
        return {str(p.relative_to(tmp_path)): p.read_bytes() for p in (tmp_path / "index").rglob("*") if p.is_file() and not p.name.endswith(".crc")}

    topk._build(rows, folder, 3, 2)
    topk._write_groups(rows.filter("id % 10 = 0"), folder, 2)
    once = files()
    assert len(once) == 5
    topk._build(rows, folder, 3, 2)  # as repeated tasks do
    topk._write_groups(rows.filter("id % 10 = 0"), folder, 2)
    assert files().keys() == once.keys()
    for name, data in files().items():
        with np.load(io.BytesIO(data)) as a, np.load(io.BytesIO(once[name])) as b:
            assert all((np.sort(a[p].ravel()) == np.sort(b[p].ravel())).all() for p in a.files)
