"""Whitening of embeddings by a covariance in which equal vectors are grouped.

An entry c counts as the integer x = floor(scale * c). Rows with equal x vectors are counted first; the distinct vectors
are the fit list, each weighted by one or by its number of rows. Sums per dimension are exact integers, kept in
decimals. The covariance is a matrix product of the centred vectors, weighted and summed over tasks, so that nothing of
the size of the mean is ever multiplied. Its eigenvectors, by falling eigenvalue, give the components: a vector's
whitened value is its centred projection over the root of the eigenvalue. Each distinct vector is whitened once, in
tasks, and joined back to its rows by a 128-bit hash. Vectors with over 1 / HEAVY of all rows, HEAVY at most, are joined
by broadcast, so no frequent vector gathers in one task.

The driver gets the sums and the covariance, that is dimensions ^ 2 numbers, whatever the number of rows.

Defined cases: rows whose vector is null or empty, or holds a null or an entry that isn't finite, go. So do rows with
another number of dimensions than most vectors of the fit list have (the larger one among equals). A component whose
eigenvalue is nothing but rounding (RANK of the largest) can't be whitened: its value is null, its share is given. With
fewer dimensions than components there are as many components as dimensions. Where all vectors are equal, all values
and shares are null. A squared deviation beyond 63 bits is null. An empty table, or one without a valid vector, gives no
rows. Null and repeated keys and other columns are kept; added names get underscores where they clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name
from veritab.session import durable

COMPONENTS = 4
SCALE = 256
#: Vectors with more than this part of all rows are joined by broadcast; there are HEAVY of them at most.
HEAVY = 1000
#: Eigenvalues below this part of the largest are rounding.
RANK = 1e-12
LONG_LIMIT = 2**63 - 1


@dataclass(frozen=True)
class Fit:
    """n: summed weights; sums: exact, by dimension; vectors: one unit eigenvector a column; values: their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part of the mean is taken off as an integer."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, whole, strict=True)])
        return _minus(x, whole) - part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The values of all vectors (rows) and components; NaN where a component has no variance."""
        usable = self.values > RANK * max(self.values.max(initial=0.0), 0.0)
        roots = np.sqrt(np.where(usable, self.values, np.nan))
        return self.centred(x) @ self.vectors / roots

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - sums) ^ 2 over the dimensions, exact; None beyond 63 bits."""
        bound = np.abs(x).astype(float).max(initial=0) * self.n + max(map(abs, self.sums), default=0)
        if bound < 2.0**62 and x.shape[1] * bound**2 < 2.0**62:
            off = x * self.n - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v <= LONG_LIMIT else None for v in (off * off).sum(1).tolist()]


def _minus(x: np.ndarray, whole: list[int]) -> np.ndarray:
    if max(map(abs, whole), default=0) < 2**62 and np.abs(x.astype(float)).max(initial=0) < 2.0**62:
        return (x - np.array(whole, np.int64)).astype(float)
    return (x.astype(object) - np.array(whole, object)).astype(float)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact_sum(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums by dimension as Python integers."""
    if np.abs(x.astype(float)).max(initial=0) * float(weights.sum()) < 2.0**62:
        return (x * weights[:, None]).sum(0).astype(object)
    return (x.astype(object) * weights.astype(object)[:, None]).sum(0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, total) of a task; dimension -1 has the summed weights."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            part = _exact_sum(_matrix(batch.column("x")), weights)
            n, total = n + int(weights.sum()), part if total is None else total + part
    if total is not None:
        yield pa.record_batch(
            {
                "dimension": pa.array(range(-1, len(total)), pa.int32()),
                "total": pa.array(map(Decimal, [n, *total.tolist()]), pa.decimal128(38, 0)),
            }
        )


def _products(fit: Fit):
    """(i, j, product), i <= j: a task's share of the centred, weighted matrix product."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = fit.centred(_matrix(batch.column("x")))
                part = (y * batch.column("weight").to_numpy(zero_copy_only=False)[:, None]).T @ y
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "product": total[i, j]})

    return multiply


def _in_tasks(fit: Fit):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(fit.sums)), np.int64)
            values = fit.whiten(x)
            flat = pa.array(values.ravel(), pa.float64(), from_pandas=True)  # NaN is null
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1])
            yield pa.record_batch(
                {
                    "h0": batch.column("h0"),
                    "h1": batch.column("h1"),
                    "copies": batch.column("copies"),
                    "weight": batch.column("weight"),
                    "deviation": pa.array(fit.deviation(x), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(ends, flat),
                }
            )

    return whiten


def fit_list(df: DataFrame, vector: str = "embedding", scale: int = SCALE, weights: str = "one") -> DataFrame:
    """(x, h0, h1, copies, weight): each distinct integer vector once, in a table of its own."""
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    counted = df.where(_valid(vector)).groupBy(_integers(vector, scale).alias("x")).agg(F.count(F.lit(1)).alias("copies"))
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    return durable(counted.select("x", *_hashed(F.col("x"), "h0", "h1"), "copies", weight.alias("weight")))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit:
    """Components of a fit list whose vectors have one length."""
    listed = distinct.select("x", "weight")
    sums = {
        r["dimension"]: int(r["total"])
        for r in listed.mapInArrow(_sums, "dimension int, total decimal(38, 0)")
        .groupBy("dimension")
        .agg(F.sum("total").alias("total"))
        .collect()  # a number for each dimension
    }
    n, size = sums.pop(-1), len(sums)
    start = Fit(n, tuple(sums[k] for k in range(size)), np.zeros((size, 0)), np.zeros(0), 0.0)
    products = (
        listed.mapInArrow(_products(start), "i int, j int, product double")
        .groupBy("i", "j")
        .agg(F.sum("product").alias("product"))
        .toPandas()  # dimensions ^ 2 numbers
    )
    covariance = np.zeros((size, size))
    covariance[products["i"], products["j"]] = products["product"] / n
    covariance += np.triu(covariance, 1).T
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0)[:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])
    return Fit(n, start.sums, vectors, values, float(np.trace(covariance)))


def identity_error(whitened: DataFrame, fitted: Fit) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity; None without variance."""
    places = [k for k, v in enumerate(fitted.values) if v > RANK * fitted.values.max()]
    if not places:
        return None
    value = {k: F.col("whitened")[k] for k in places}
    mean = whitened.agg(*[(F.sum(value[k] * F.col("weight")) / fitted.n).alias(f"m{k}") for k in places]).first()
    pairs = [(i, j) for i in places for j in places if i <= j]
    covariance = whitened.agg(
        *[
            (F.sum((value[i] - mean[f"m{i}"]) * (value[j] - mean[f"m{j}"]) * F.col("weight")) / fitted.n).alias(f"c{i}_{j}")
            for i, j in pairs
        ]
    ).first()
    return max(abs(covariance[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _valid(vector: str) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce((F.size(F.col(f"`{vector}`")) > 0) & F.forall(F.col(f"`{vector}`"), finite), F.lit(False))


def _integers(vector: str, scale: int) -> Column:
    return F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def _hashed(x: Column, *names: str) -> list[Column]:
    """Two 64-bit hashes from different starts."""
    return [F.xxhash64(x).alias(names[0]), F.xxhash64(F.lit(1), x).alias(names[1])]


def whiten(
    df: DataFrame,
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    weights: str = "one",
    heavy: int = HEAVY,
) -> DataFrame:
    """The valid rows of ``df`` with ``whitened`` and ``explained`` (arrays of double, by component), ``n`` and
    ``deviation`` (long) and ``identity_error`` (double, one value). ``heavy`` never changes the result."""
    distinct = fit_list(df, vector, scale, weights)
    lengths = (
        distinct.groupBy(F.size("x").alias("size"))
        .agg(F.count(F.lit(1)).alias("vectors"), F.sum("copies").alias("rows"))
        .orderBy(F.col("vectors").desc(), F.col("size").desc())
        .first()
    )
    names = {c: fresh_name(df, c) for c in ("n", "deviation", "whitened", "explained", "identity_error")}
    if lengths is None:
        kinds = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>"}
        none = [F.lit(None).cast(kinds.get(c, "double")).alias(name) for c, name in names.items()]
        return df.where(F.lit(False)).select("*", *none)
    same = distinct.where(F.size("x") == lengths["size"])
    fitted = fit(same, components)
    done = durable(
        same.mapInArrow(
            _in_tasks(fitted),
            "h0 long, h1 long, copies long, weight long, deviation long, whitened array<double>",
        )
    )
    error = identity_error(done, fitted)

    h0, h1 = fresh_name(df, "_h0"), fresh_name(df, "_h1")
    rows = df.where(_valid(vector)).select("*", *_hashed(_integers(vector, scale), h0, h1))
    values = done.select(
        F.col("h0").alias(h0),
        F.col("h1").alias(h1),
        (F.col("copies") * heavy > lengths["rows"]).alias("_often"),
        F.lit(fitted.n).cast("long").alias(names["n"]),
        F.col("deviation").alias(names["deviation"]),
        F.col("whitened").alias(names["whitened"]),
        F.array(*[F.lit(v).cast("double") for v in fitted.explained()]).alias(names["explained"]),
        F.lit(error).cast("double").alias(names["identity_error"]),
    )
    often = F.broadcast(values.where("_often").drop("_often"))  # ``heavy`` rows at most
    frequent = rows.join(often, [h0, h1])
    others = rows.join(often.select(h0, h1), [h0, h1], "left_anti").join(values.where("not _often").drop("_often"), [h0, h1])
    return frequent.unionByName(others).select(*df.columns, *names.values())
