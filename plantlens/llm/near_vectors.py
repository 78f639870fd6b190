"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with its sign,
that it lies closest to. A bucket of a table is named by label, dimension and `HASHES` such axes. Every vector is put
into its own bucket of each of `TABLES` tables and looked for in that and in the `PROBES` next likely ones, those where
the runner-up axis is closest. Pairs found are made distinct and verified by cosine in double precision, so no pair
below the threshold is linked; how many above it are found depends on tables and probes (README gives the recall).

Equal vectors of a label are one class before anything is paired, pre-aggregated, so a vector that a third of all rows
hold costs one. The number of links counts all copies. Buckets are never cut: a bucket is joined whole, and the join can
be split by Spark where a bucket is large.

Cases: vectors that are null, empty, zero or hold null, NaN or infinite components, and rows with a null label or
vec_id, link with nothing and are components of their own; vectors of different dimensions never link; repeated rows
are copies and link with each other; two different vectors under one vec_id share its component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.components import components

LEAST_COSINE = 0.93
TABLES = 12
HASHES = 2
PROBES = 5
SEED = 4242
ROWS_AT_ONCE = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, k: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, table, k, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def buckets(x: np.ndarray, table: int, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of one table, the own bucket first, then the next likely ones: rows x (1 + probes)."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    own = np.zeros(len(x), np.int64)
    steps, gaps = [], []
    for k in range(hashes):
        y = rotated(x, table, k)
        both = np.concatenate([y, -y], axis=1)
        near = min(probes + 1, 2 * n)
        top = np.argpartition(-both, near - 1, axis=1)[:, :near]
        value = np.take_along_axis(both, top, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
        own = own * (2 * n) + top[:, 0]
        scale = (2 * n) ** (hashes - 1 - k)
        steps.append((top[:, 1:] - top[:, :1]) * scale)
        gaps.append(value[:, :1] - value[:, 1:])
    step, gap = np.concatenate(steps, axis=1), np.concatenate(gaps, axis=1)
    choice = np.argsort(gap, axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None], own[:, None] + np.take_along_axis(step, choice, axis=1)], axis=1)


def _hashed(tables: int, hashes: int, probes: int):
    names = ["id", "label", "place", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                dims = batch.column("dim").to_numpy()
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    x = part.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, d)
                    x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
                    for t in range(tables):
                        b = buckets(x, t, hashes, probes)
                        place = (b * tables + t) * 65_536 + d
                        rows = np.repeat(np.arange(len(x)), b.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(rows)), part.column("label").take(pa.array(rows)), pa.array(place.ravel()),
                             pa.array(np.tile(np.arange(b.shape[1]) == 0, len(x)))], names=names)
    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        out = np.zeros(batch.num_rows)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            part = batch.take(pa.array(at))
            a, b = (part.column(c).flatten().to_numpy().astype(np.float64).reshape(-1, d) for c in ("va", "vb"))
            a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
            out[at] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(out)],
                                         names=["a", "b", "na", "nb", "cosine"])


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. `vectors` has vec_id, embedding and label."""
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # one number for both zeros, so that equal vectors are equal as groups
    rows = vectors.select("vec_id", "label", F.when(fit, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    classes = stored(rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
                     .withColumn("dim", F.size("v")), "vectors")
    placed = stored(classes.select("id", "label", "v", "dim").mapInArrow(
        _hashed(tables, hashes, probes), "id bigint, label string, place bigint, own boolean"), "places")
    own, other = placed.where("own").select("label", "place", F.col("id").alias("x")), placed.select("label", "place", F.col("id").alias("y"))
    pairs = own.join(other, ["label", "place"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    a = classes.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"), F.col("n").alias("na"), "dim")
    b = classes.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"), F.col("n").alias("nb"), F.col("dim").alias("db"))
    both = stored(pairs, "pairs").join(a, "a").join(b, "b").where("la = lb AND dim = db").select("a", "b", "va", "vb", "na", "nb", "dim")
    links = stored(both.mapInArrow(_cosines, "a bigint, b bigint, na bigint, nb bigint, cosine double").where(F.col("cosine") >= least), "links")
    partners = links.select(F.col("a").alias("id"), F.col("nb").alias("n")).union(links.select("b", "na"))
    partners = partners.groupBy("id").agg(F.sum("n").alias("others"))
    groups = components(links.select("a", "b")).select(F.col("node").alias("id"), "component")
    named = stored(classes.select("label", "v", "id", "n").join(partners, "id", "left").join(groups, "id", "left").select(
        "label", "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id")), "named")
    return rows.join(named, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
