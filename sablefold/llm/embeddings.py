"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, components.

Vectors with equal components are one class that counts with its size.  Every
class puts its ``bits`` signs into each of ``tables`` hash tables; classes that
share a bucket are compared exactly, in double precision.  A pair that meets in
several tables is counted in the first of them only, so no list of pairs is
ever built: a bucket yields link counts and a spanning forest of its links.
Buckets beyond ``block`` classes are split into blocks, and each pair of blocks
is a piece of work; a task takes pieces of about ``PER_TASK`` vectors in all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .session import cut, prepare

NEAR, PER_TASK = 0.95, 8_000


def plan(n: int, threshold: float, miss: float, per_bucket: int = 64) -> tuple[int, int]:
    """Bits that keep an even bucket near ``per_bucket`` classes, and tables that miss a pair at the threshold with at most ``miss``."""
    bits = max(4, min(30, math.ceil(math.log2(max(2, n / per_bucket)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


@cache
def planes(seed: int, dim: int, n: int) -> np.ndarray:
    """Normals of ``n`` random hyperplanes, drawn once per worker."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def near_embeddings(vectors: DataFrame, threshold: float = NEAR, miss: float = 1e-5, block: int = 1024, seed: int = 29) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Null, zero, empty and non-finite vectors, and rows whose id is null, link
    with nothing and are their own component.  Vectors of different lengths
    never link.  Rows that repeat an id are vectors of their own.  Other
    columns of the input are not read.
    """
    prepare(vectors.sparkSession)
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = cut(v.where("fit").groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("weight")))
    n = classes.count()
    bits, tables = plan(n, threshold, miss)

    def unit(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(rows.tolist(), dtype=np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        signs = ((x @ planes(seed, x.shape[1], tables * bits)) >= 0).reshape(len(x), tables, bits)
        return x, signs @ (1 << np.arange(bits, dtype=np.int64))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["embedding"].map(len)):
                _, codes = unit(part["embedding"])
                yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), tables), "dim": np.int32(dim), "tab": np.tile(np.arange(tables, dtype=np.int32), len(part)), "code": codes.ravel()})

    keys = ["dim", "tab", "code"]
    codes = cut(classes.select("cls", "embedding").mapInPandas(code, "cls long, dim int, tab int, code long"))
    sizes = codes.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / F.lit(block)).cast("int")
    spread = codes.join(sizes, keys).withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # block pair (lo, hi): a class goes to every pair that has its block
    tasks = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    tasks = tasks.select("cls", *keys, "lo", "hi", (F.col("mine") == F.col("lo")).alias("left"))

    tasks = cut(tasks)
    some = max(1, tasks.count() // PER_TASK)
    tasks = tasks.withColumn("task", F.pmod(F.xxhash64(*keys, "lo", "hi"), F.lit(some)).cast("int")).join(classes, "cls")

    def buckets(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["tab", "code", "lo", "hi", "cls"], ignore_index=True)
        x, codes = unit(b["embedding"])
        piece = b[["tab", "code", "lo", "hi"]].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]).any(axis=1), [True]]))
        weight, is_left, ids = b["weight"].to_numpy(), b["left"].to_numpy(), b["cls"].to_numpy()
        out = []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            tab, _, lo, hi = piece[i]
            links, root = linked(x[i:j], codes[i:j, :tab], weight[i:j], np.ones(j - i, bool) if lo == hi else is_left[i:j], lo == hi)
            found = np.flatnonzero(links)
            out.append((ids[i:j][found], links[found].astype(np.int64), ids[i:j][root[found]]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("cls", "links", "root"), zip(*out))})

    def linked(x: np.ndarray, earlier: np.ndarray, weight: np.ndarray, is_left: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Links of each vector that met in no earlier table, and the first vector that links reach."""
        left = np.flatnonzero(is_left)
        right = left if same else np.flatnonzero(~is_left)
        hits_a, hits_b = [], []
        for i in range(0, len(left), 512):
            some = left[i : i + 512]
            p, q = np.nonzero(x[some] @ x[right].T >= threshold - 1e-12)
            p, q = some[p], right[q]
            if same:
                p, q = p[p < q], q[p < q]
            if earlier.shape[1] and len(p):
                first = ~(earlier[p] == earlier[q]).any(axis=1)
                p, q = p[first], q[first]
            exact = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            hits_a.append(p[exact])
            hits_b.append(q[exact])
        p, q = np.concatenate(hits_a or [[]]).astype(int), np.concatenate(hits_b or [[]]).astype(int)
        links = np.bincount(p, weight[q], len(x)) + np.bincount(q, weight[p], len(x))
        return links, forest(len(x), p, q)

    found = cut(tasks.groupBy("dim", "task").applyInPandas(buckets, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls")
    about = classes.join(links, "cls", "left").join(linked, "cls", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    result = v.where("fit").join(about, "embedding").select("vec_id", "n_links", "component_id")
    alone = v.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
