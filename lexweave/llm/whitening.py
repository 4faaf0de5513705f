"""Whitening of vectors by an exact covariance.

The covariance is made of whole numbers. Each task splits its centred integers into limbs of a few bits, multiplies the limbs' blocks
by float64 matrix products, which stay exact as no sum in them reaches 2^53, and puts the limbs together again as big integers. These
are merged over all tasks, so the covariance does not depend on how rows were dealt, and it is rounded once, before the eigenvectors
are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import discard, evened, floored, matrix, quoted, release_memory, stored

#: Bits of a limb, and rows of a block: 2 * LIMB + log2(ROWS) is at most 53.
LIMB, ROWS = 20, 1 << 13
#: Bits of the digits in which big integers travel; so many tasks' digits add up without leaving 63 bits.
DIGIT = 40
#: A component of less than this share of the variance, for each dimension, has none.
NO_SHARE = 2.0**-50


def limbs_of(values: np.ndarray, count: int) -> list[np.ndarray]:
    """Whole numbers as count limbs, the smallest first: all but the last are LIMB bits, the last holds the sign."""
    out = []
    for _ in range(count - 1):
        out.append((values & ((1 << LIMB) - 1)).astype(np.float64))
        values = values >> LIMB
    return [*out, values.astype(np.float64)]


def limb_count(largest: int) -> int:
    """Limbs that hold whole numbers of at most this size; the last is one bit short, for the sign."""
    return max(1, -(-(int(largest).bit_length() + 1) // LIMB))


def exact_products(values: np.ndarray, largest: int) -> np.ndarray:
    """values' transpose times values, as Python integers."""
    count = limb_count(largest)
    dims = values.shape[1]
    out = np.zeros((dims, dims), object)
    for at in range(0, len(values), ROWS):
        limbs = limbs_of(values[at : at + ROWS], count)
        for i in range(count):
            for j in range(i, count):
                product = (limbs[i].T @ limbs[j]).astype(np.int64).astype(object) << LIMB * (i + j)
                out += product if i == j else product + product.T
    return out


def digits_of(values: list[int], count: int) -> np.ndarray:
    """A row for each digit of DIGIT bits, the smallest first; the last holds the sign."""
    out = np.zeros((count, len(values)), np.int64)
    for k, x in enumerate(values):
        for d in range(count - 1):
            out[d, k] = x & ((1 << DIGIT) - 1)
            x >>= DIGIT
        out[count - 1, k] = x
    return out


@dataclass
class Whitening:
    """n vectors of the fit list with the sums of their components; components has a unit row for each eigenvector, by falling
    eigenvalue; explained are the eigenvalues' shares of the whole variance."""

    n: int
    sums: list[int]
    centre: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    largest: int
    identity_error: float = 0.0

    @property
    def some(self) -> np.ndarray:
        """Which components have any variance."""
        return self.explained > NO_SHARE * max(1, len(self.sums))

    def project(self, offsets: np.ndarray) -> np.ndarray:
        """Whitened values of vectors, given as whole numbers from the centre; nan for a component without variance."""
        mean = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre, strict=True)])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (offsets - mean) @ self.components.T / np.sqrt(np.maximum(self.eigenvalues, 0))
        out[:, ~self.some] = np.nan
        return out

    def deviations(self, offsets: np.ndarray) -> list[int]:
        """The sum over the dimensions of (n * x - sum)^2 of each vector."""
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]
        if len(rest) * (self.n * self.largest + max(map(abs, rest), default=0)) ** 2 < 1 << 63:
            gaps = self.n * offsets - np.array(rest, np.int64)
            return np.einsum("ij,ij->i", gaps, gaps).tolist()
        gaps = self.n * offsets.astype(object) - np.array(rest, object)
        return (gaps * gaps).sum(1).tolist() if len(rest) else [0] * len(offsets)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int], list[int]]:
    """n, and the sum, the least and the greatest value of each dimension. A row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        least, most = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0), dims)
                n += len(x)
                high = x >> 32
                total += (x & 0xFFFFFFFF).sum(0).astype(object) + (high.sum(0).astype(object) << 32)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            told = digits_of(total.tolist(), 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([n] * dims, pa.int64()), *map(pa.array, told), pa.array(least), pa.array(most)], names=["d", "n", "s0", "s1", "s2", "least", "most"])

    added = fit.select("v").mapInArrow(run, "d int, n long, s0 long, s1 long, s2 long, least long, most long")
    got = added.groupBy("d").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)], F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()
    return got[0]["n"] if got else 0, [sum(r[f"s{k}"] << DIGIT * k for k in range(3)) for r in got], [r["least"] for r in got], [r["most"] for r in got]


def _offsets(batch: pa.Array, dims: int, centre: list[int]) -> np.ndarray:
    return matrix(batch, dims) - np.array(centre, np.int64)


def _products(fit: DataFrame, dims: int, centre: list[int], largest: int, n: int) -> np.ndarray:
    """The sum over the fit list of each vector's offsets from the centre times themselves. A row for each pair of dimensions reaches
    the driver, which needs all of them for the eigenvectors anyway."""
    upper = np.triu_indices(dims)
    count = max(2, -(-((int(largest) ** 2 * max(1, n)).bit_length() + 2) // DIGIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, dims), object)
        for batch in batches:
            out += exact_products(_offsets(batch.column(0), dims, centre), largest)
        told = digits_of(out[upper].tolist(), count)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in upper), *map(pa.array, told)], names=["i", "j", *(f"d{k}" for k in range(count))])
        release_memory()

    added = fit.select("v").mapInArrow(run, "i int, j int, " + ", ".join(f"d{k} long" for k in range(count)))
    out = np.zeros((dims, dims), object)
    for r in added.groupBy("i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(count)]).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = sum(r[f"d{k}"] << DIGIT * k for k in range(count))
    return out


def _identity_error(fit: DataFrame, dims: int, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, measured on its values."""
    some = np.flatnonzero(model.some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(len(some)), np.zeros((len(some), len(some)))
        for batch in batches:
            w = model.project(_offsets(batch.column(0), dims, model.centre))[:, some]
            sums += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(some), dtype=np.int32)), pa.array(sums), pa.array(products.tolist(), pa.list_(pa.float64()))], names=["i", "s", "p"])

    added = fit.select("v").mapInArrow(run, "i int, s double, p array<double>")
    got = added.groupBy("i").agg(F.sum("s").alias("s"), *[F.sum(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(len(some))]).orderBy("i").collect()
    if not got:
        return 0.0
    mean = np.array([r["s"] for r in got]) / model.n
    cov = np.array([[r[f"p{k}"] for k in range(len(some))] for r in got]) / model.n - np.outer(mean, mean)
    return round(float(np.abs(cov - np.eye(len(some))).max()), 9)  # what lies below depends on the order of adding


def fit_whitening(rows: DataFrame, dims: int, components: int = 16) -> Whitening:
    """The whitening of the distinct vectors v of rows, each once."""
    fit = stored(rows.select("v").distinct(), "whitening-fit")
    n, sums, least, most = _sums(fit, dims)
    if not n or not dims:
        discard(fit)
        return Whitening(n, sums, sums, np.zeros((0, dims)), np.zeros(0), np.zeros(0), 0)
    centre = [s // n for s in sums]
    largest = max(max(c - a, b - c) for c, a, b in zip(centre, least, most, strict=True))
    products = _products(fit, dims, centre, largest, n)
    rest = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    exact = n * products - np.outer(rest, rest)  # n * n times the covariance
    whole = np.array([[x / (n * n) for x in row] for row in exact.tolist()])
    values, vectors = np.linalg.eigh(whole)
    kept = np.argsort(-values, kind="stable")[:components]
    trace = int(np.trace(exact)) / (n * n)
    shares = values[kept] / trace if trace else np.zeros(len(kept))
    model = Whitening(n, sums, centre, vectors[:, kept].T.copy(), values[kept], np.maximum(shares, 0.0), largest)
    if model.some.any():
        model.identity_error = _identity_error(fit, dims, model)
    discard(fit)
    return model


def whiten(df: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error for each vector of df and each of the
    first components; and the model.

    An entry c counts as x = floor(scale * c) + offset, kept within 62 bits. The fit list holds each distinct vector once, so
    repeated rows weigh once in the fit and are whitened each. Rows whose vector is null or holds a null or non-finite value are left
    out; a shorter vector counts as filled up by zeros; a row without an id is whitened. A component without variance (one distinct
    vector, constant or dependent dimensions) has explained near 0 and whitened null and is no part of identity_error. Vectors
    without entries have no components, an empty df gives an empty result.

    Vectors move once, to find the distinct ones. What reaches the driver is a row for each pair of dimensions."""
    limit = 1 << 61
    counted = F.transform(floored(quoted(vector_col), scale), lambda x: F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)) + F.lit(offset).cast("long"))
    rows = stored(df.select(quoted(id_col).cast("long").alias("id"), counted.alias("v")).filter("v IS NOT NULL"), "whitening-vectors")
    even, dims = evened(rows, "v", fill=offset)
    model = fit_whitening(even, dims, components)
    count = len(model.explained)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, len(batch) if count else 0, ROWS):
                part = batch.slice(at, ROWS)
                z = _offsets(part.column(1), dims, model.centre)
                w = model.project(z).ravel()
                told = pa.array(model.deviations(z), pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(z)), count))
                size = len(z) * count
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))), pa.array(np.full(size, model.n)), told.take(each), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, len(z))), pa.array(np.full(size, model.identity_error))], names=names)
        release_memory()

    return even.mapInArrow(run, schema), model
