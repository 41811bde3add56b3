"""Embedding whitening from a covariance weighted by multiplicity.

Vectors are first brought to whole numbers, so that equal ones can be grouped. Each distinct
vector is held once with the number of its copies; the covariance is a weighted, centred
matrix product over these (weights are the copies, or one), whitening is done once for each,
and the rows get the result by a lookup that splits a vector with very many copies.

``distinct_vectors`` is one aggregate, combined before it is shuffled, and is staged. Sums and
products are formed a batch at a time in numpy and added up by Spark cell by cell, so what
reaches the driver is a matrix as wide as the vectors, whatever the number of rows. Sums are
exact whole numbers, and ``n * x - S`` is too, so centring loses no digit.

Defined results: a vector that is null, holds a null, a NaN or an infinity, or an entry too
large for a whole number, is left out with its row; so is one whose width is not the most
frequent one (the larger of two equally frequent). Repeated rows are repeated, a null id is
kept. Equal vectors get equal results. A component without variance (its eigenvalue is zero to
double precision) cannot be scaled to one and has no row, so constant vectors, a single one,
empty ones and an empty table give no row. Of each unit eigenvector the largest entry is
positive; among equal eigenvalues the order is that of the eigenvalue routine. ``deviation`` is
null where it does not fit a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.operators.joins import lookup_join
from sharewise.session import stage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Whole numbers beyond this are not exact as doubles.
LARGEST = float(1 << 52)
LONG = (1 << 63) - 1


class Whitening(NamedTuple):
    """Number of fitted vectors, their sums, unit eigenvectors as columns by falling
    eigenvalue, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_numbers(vector: Column | str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * c) + offset`` of every entry as longs; null for a vector left out."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def usable(c: Column) -> Column:
        return F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False))

    moved = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)
    return F.when(F.forall(vector, usable) & (F.size(vector) > 0), moved)


def key_of(x: Column) -> Column:
    """One short key for equal vectors."""
    return F.sha2(F.concat_ws(",", x.cast("array<string>")).cast("binary"), 256)


def distinct_vectors(df: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """``key, x, copies``: the distinct vectors of the most frequent width, staged."""
    x = df.select(whole_numbers(vector, scale, offset).alias("x")).filter("x is not null")
    held = stage(x.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    widths = held.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("n"))
    usual = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).select("width").scalar()
    return held.filter(F.size("x") == usual).select(key_of(F.col("x")).alias("key"), "x", "copies")


# --- sums over all vectors -----------------------------------------------------------------


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def sum_of(held: DataFrame, part: Callable, kind: str, what: str, weights: str) -> np.ndarray:
    """The sum over all batches of ``part(rows, weights)``, a flat array, cell by cell.

    ``what`` names the column of lists and its entries' numpy type; each task adds up what it
    reads before it hands one value a cell on.
    """
    column, entry = what.split(":")
    arrow = {"bigint": pa.int64(), "double": pa.float64()}[kind]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = batch["w"].to_numpy(zero_copy_only=False)
                found = part(matrix(batch["rows"], np.dtype(entry).type), w)
                total = found if total is None else total + found
        if total is not None:
            cells = pa.array(np.arange(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([cells, pa.array(total, arrow)], names=["cell", "v"])

    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("bigint")
    rows = held.select(F.col(column).alias("rows"), weight.alias("w"))
    sums = rows.mapInArrow(add, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").alias("v"))
    return sums.orderBy("cell").toArrow()["v"].to_numpy()


def totals(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (rows * w[:, None]).sum(axis=0)


def products(rows: np.ndarray, w: np.ndarray, centre: Callable) -> np.ndarray:
    """The upper triangle of the weighted product of centred rows with themselves."""
    centred = centre(rows)
    gram = (centred * w[:, None].astype(float)).T @ centred
    return gram[np.triu_indices(len(gram))]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n``, from the exact ``n * x - S``."""
    return (n * x - sums) / float(n)


def symmetric(cells: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = cells
    return out + np.triu(out, 1).T


def fit(held: DataFrame, weights: str = "counts", components: int = COMPONENTS) -> Whitening | None:
    """Eigenvectors of the weighted covariance of distinct vectors; none for no vector.

    ``weights="counts"`` fits all vectors, ``"one"`` each distinct one once.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    n = held.agg(F.sum("copies" if weights == "counts" else F.lit(1)).alias("n")).first()["n"]
    if not n:
        return None
    sums = sum_of(held, totals, "bigint", "x:int64", weights)
    centre = partial(centred, n=n, sums=sums)
    cells = sum_of(held, partial(products, centre=centre), "double", "x:int64", weights)
    covariance = symmetric(cells, len(sums)) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = max(values[0], 0.0) * len(sums) * np.finfo(float).eps
    kept = min(components, int((values > floor).sum()))
    vectors = vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)]) if kept else 1.0
    return Whitening(n, sums, vectors * signs, values[:kept], float(np.trace(covariance)))


# --- whitened vectors ----------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, exact."""
    off = n * x - sums
    if len(off) and float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in off]
    return [v if v <= LONG else None for v in exact]


def whitened_vectors(held: DataFrame, model: Whitening) -> DataFrame:
    """``key, copies, deviation, z`` of each distinct vector, staged."""
    axes = model.components / np.sqrt(model.eigenvalues)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"], np.int64)
            z = centred(x, model.n, model.sums) @ axes
            ends = pa.array(np.arange(len(x) + 1) * axes.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"],
                    batch["copies"],
                    pa.array(deviations(x, model.n, model.sums), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(z.ravel())),
                ],
                names=["key", "copies", "deviation", "z"],
            )

    shape = "key string, copies bigint, deviation bigint, z array<double>"
    return stage(held.mapInArrow(apply, shape), "whitened")


def identity_error(done: DataFrame, n: int, weights: str) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    mean = sum_of(done, totals, "double", "z:float64", weights) / n
    part = partial(products, centre=lambda z: z - mean)
    cells = sum_of(done, part, "double", "z:float64", weights)
    return float(np.abs(symmetric(cells, len(mean)) / n - np.eye(len(mean))).max())


def whiten(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "counts",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each
    remaining row of ``df`` and component, numbered from 1 by falling eigenvalue."""
    kind = df.schema[key].dataType.simpleString()
    held = distinct_vectors(df, vector, scale, offset)
    model = fit(held, weights, components)
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame(
            [],
            f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, "
            "explained double, identity_error double",
        )
    done = whitened_vectors(held, model)
    error = identity_error(done, model.n, weights)
    rows = df.select(F.col(key).alias("id"), whole_numbers(vector, scale, offset).alias("x"))
    rows = rows.filter(F.size("x") == len(model.sums)).select("id", key_of(F.col("x")).alias("key"))
    counts = done.select("key", F.col("copies").alias("__n"))
    found = lookup_join(rows, done.drop("copies"), "key", ["id"], how="inner", counts=counts)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return found.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
