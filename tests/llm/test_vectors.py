"""Codebooks and whitening against plain versions."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lexweave.llm import codebooks, queries, sql, whitening


def kept(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The same rounds by hand: (vec_id, label, code, error) of each row and all final entries."""
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in kept(rows)]
    dims = -(-max((len(v) for _, _, v in rows), default=0) // parts) * parts
    rows = [(i, label, v + [0] * (dims - len(v))) for i, label, v in rows]
    of = {}
    for i, _, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2])):
        of.setdefault(i, v)
    width = dims // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(of[i])[p] for i in sorted(of)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in rows:
                own[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            for k, x in own.items():
                books[p][k] = [sum(c) // len(x) for c in zip(*x, strict=True)]
    told = [(i, label, [near(x, books[p]) for p, x in enumerate(cut(v))]) for i, label, v in rows]
    return [(i, label, "".join(f"{k:02x}" for _, k in near_), sum(d for d, _ in near_)) for i, label, near_ in told], books


def odd_vectors(seed=1, n=120, dims=16):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 1)]) for _ in range(dims)], rnd.choice([1, 2, None])) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, same, 1) for i in range(n // 2)] + [rows[3], rows[3], (None, rows[4][1], None), (2, rows[9][1], 2)]
    return rows + [(2000, None, 1), (2001, [None] + same[1:], 1), (2002, [float("nan")] + same[1:], None), (2003, [float("-inf")] + same[1:], 2)]


SCHEMA = "vec_id long, embedding array<double>, label int, error string, v string, n string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "e", "v", "n", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize("ragged", [False, True])
def test_codes_equal_the_plain_rounds(spark, ragged):
    rows = odd_vectors()
    if ragged:
        rows += [(3000, [0.1] * 5, 1), (-5, [], None), (3001, [0.2] * 17, 2)]
    found, books = codebooks.compress(frame(spark, rows).repartition(7))
    want, entries = plain_codes(rows)
    got = found.collect()
    assert sorted(map(repr, ((r["vec_id"], r["label"], r["code"], r["error"]) for r in got))) == sorted(map(repr, want))
    by_label = defaultdict(int)
    for _, label, _, error in want:
        by_label[label] += error
    assert {(r["label"], r["label_error"]) for r in got} == set(by_label.items())
    assert books.sha256() == hashlib.sha256(",".join(str(x) for book in entries for e in book for x in e).encode()).hexdigest()


def test_codes_of_few_and_no_rows(spark):
    for rows in ([], [(5, None, 1)], [(4, [0.5] * 8, 1)], [(4, [0.5] * 8, 1), (2, [-0.5] * 8, 1), (2, [-0.5] * 8, 1)]):
        found, _ = codebooks.compress(frame(spark, rows))
        assert found.columns == ["vec_id", "label", "code", "error", "label_error"]
        assert sorted(r["vec_id"] for r in found.collect()) == sorted(r[0] for r in kept(rows))
    with pytest.raises(ValueError):
        codebooks.compress(frame(spark, [(1, [1e12] * 8, 1)]))


def test_nearest_entries_with_many_ties():
    rnd = np.random.default_rng(4)
    for n, dims, span in ((1, 3, 2), (16, 8, 2), (40, 2, 3), (200, 4, 4), (256, 1, 9)):
        entries, points = rnd.integers(0, span, (n, dims)), rnd.integers(-1, span + 1, (500, dims))
        gaps = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        index, best = codebooks.KdTree(entries).nearest(points)
        assert (index == gaps.argmin(1)).all() and (best == gaps.min(1)).all()


def test_a_bound_prunes_most_entries():
    rnd = np.random.default_rng(5)
    entries = rnd.integers(-1000, 1000, (256, 2))
    tree, seen = codebooks.KdTree(entries), 0
    whole = tree.bound

    def counted(node, points):
        nonlocal seen
        seen += len(points) if tree.below[node] is None else 0
        return whole(node, points)

    tree.bound = counted
    tree.nearest(rnd.integers(-1000, 1000, (300, 2)))
    assert seen < 0.5 * 300 * 256 / codebooks.LEAF


def test_decoded_vectors_are_the_entries(spark):
    found, books = codebooks.compress(frame(spark, odd_vectors()))
    for r in books.decoded(found).limit(20).collect():
        want = [x / 4096 for p in range(8) for x in books.entries[p][int(r["code"][2 * p : 2 * p + 2], 16)].tolist()]
        assert r["decoded"] == want


def test_codes_by_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = connection.sql(sql.OP11_VECTOR_CODES)
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in found.columns) for r in queries.op11_vector_codes(spark, sf_dir).collect())


def plain_fit(rows, scale=64, offset=1_000_000):
    """The exact covariance of the distinct vectors, by fractions."""
    rows = kept(rows)
    dims = max((len(r[1]) for r in rows), default=0)
    xs = [[math.floor(scale * c) + offset for c in v] + [offset] * (dims - len(v)) for _, v, *_ in rows]
    fit = [list(x) for x in {tuple(x) for x in xs}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(dims)] for i in range(dims)]
    return [r[0] for r in rows], xs, n, sums, mean, np.array(cov), fit


@pytest.mark.parametrize("ragged", [False, True])
def test_whitening_equals_the_plain_covariance(spark, ragged):
    rows = [(i, v, label) for i, v, label in odd_vectors(2, dims=6)]
    if ragged:
        rows += [(3000, [0.1] * 3, 1), (-5, [], None), (3001, [0.2] * 7, 2)]
    found, model = whitening.whiten(frame(spark, rows).repartition(5), components=4)
    ids, xs, n, sums, mean, cov, fit = plain_fit(rows)
    got = found.collect()
    assert len(got) == 4 * len(ids) and {r["n"] for r in got} == {n}
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    plain = np.array([[float(a - m) for a, m in zip(x, mean, strict=True)] for x in xs])
    for k in range(4):
        u = model.components[k]
        assert abs(np.linalg.norm(u) - 1) < 1e-12 and np.abs(cov @ u - values[k] * u).max() < 1e-8 * values[0]
        want = plain @ u / math.sqrt(values[k])
        assert np.allclose(sorted(want), sorted(r["whitened"] for r in got if r["component"] == k + 1), rtol=1e-8, atol=1e-8)
        assert math.isclose(values[k] / np.trace(cov), next(r["explained"] for r in got if r["component"] == k + 1), rel_tol=1e-9)
    assert {r["identity_error"] for r in got} == {model.identity_error} and model.identity_error < 1e-8
    deviations = sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs)
    assert deviations == sorted(int(r["deviation"]) for r in got if r["component"] == 1)
    white = np.array([(np.array(x, float) - np.array(list(map(float, mean)))) @ model.components.T / np.sqrt(values[:4]) for x in fit])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-6


def test_whitening_without_variance(spark):
    for rows, components in (([], 0), ([(1, None, 1)], 0), ([(1, [], 1)], 0), ([(1, [0.5, 1.5], 1), (2, [0.5, 1.5], 1)], 2)):
        got = whitening.whiten(frame(spark, rows))[0].collect()
        assert len(got) == components * len(kept(rows)) and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 for r in got)
    got = whitening.whiten(frame(spark, [(i, [float(i % 5), 2.0, float(i % 3)], 1) for i in range(30)]))[0].collect()
    assert {r["component"] for r in got if r["whitened"] is None} == {3} and all(r["identity_error"] < 1e-8 for r in got)


@pytest.mark.parametrize("span", [1, 1000, 1 << 19, 1 << 20, 1 << 31, 1 << 45, 1 << 62])
def test_products_of_limbs_are_exact(span):
    rnd = random.Random(span)
    values = [[rnd.randrange(-span, span + 1) for _ in range(3)] for _ in range(50)] + [[span, -span, span]] * 40
    want = [[sum(r[i] * r[j] for r in values) for j in range(3)] for i in range(3)]
    got = whitening.exact_products(np.array(values, np.int64), span)
    assert got.tolist() == want
    flat = [x for row in want for x in row]
    digits = whitening.digits_of(flat, 5)
    assert [sum(int(d) << whitening.DIGIT * k for k, d in enumerate(column)) for column in digits.T] == flat


def test_large_components_stay_exact(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([-1e9, 3.5, 2e8]) * rnd.random() for _ in range(3)], 1) for i in range(40)]
    got = whitening.whiten(frame(spark, rows))[0].filter("component = 1").collect()
    ids, xs, n, sums, *_ = plain_fit(rows)
    assert sorted(int(r["deviation"]) for r in got) == sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs)


def test_whitening_of_the_whole_table(spark, sf_dir):
    got = queries.op12_whitening(spark, sf_dir).collect()
    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, xs, n, sums, mean, cov, _ = plain_fit(rows[:]) if len(rows) <= 600 else pytest.skip("large table")
    values, vectors = np.linalg.eigh(cov)
    offsets = np.array([[float(a - m) for a, m in zip(x, mean, strict=True)] for x in xs])
    place = {i: k for k, i in enumerate(ids)}
    assert len(got) == 16 * len(ids)
    for component in range(1, 17):
        want = offsets @ vectors[:, -component] / math.sqrt(values[-component])
        mine = np.zeros(len(ids))
        for r in got:
            if r["component"] == component:
                mine[place[r["vec_id"]]] = r["whitened"]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
