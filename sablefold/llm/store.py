"""Token ids of documents in a content-addressed store.

Each document's ids, with an end id, are one stream.  A rolling hash over the
last ``WINDOW`` ids cuts it into chunks where the hash hits a mask, so equal
passages give equal chunks wherever they stand.  The store holds

* ``chunks``: every distinct chunk once: its digest and its ids, as
  little-endian integers under zstd;
* ``recipes``: in ascending doc_id order, for each document its first
  position, its number of ids, the digests of its chunks and a leaf digest;
* ``manifest``: the Merkle root over the leaves of each recipe file, and one
  root over those.

Reading recomputes every chunk's digest, each leaf and the roots.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import running
from .session import cut, prepare, release, shared_dir, shuffle_partitions, written
from .tokens import Encoder
from .words import U, mix

END, WINDOW = 2, 8
LEAST, MASK, MOST = 128, 511, 4096


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    code = mix(ids.astype(U), 11)
    with np.errstate(over="ignore"):
        h = code.copy()
        for j in range(1, WINDOW):
            h[j:] += code[:-j] * U((0x9E3779B97F4A7C15 ** (j + 1)) & (2**64 - 1))
        hits = np.flatnonzero((mix(h) & U(MASK)) == 0) + 1
    ends, start = [], 0
    while n - start > LEAST:
        k = np.searchsorted(hits, start + LEAST)
        end = min(int(hits[k]) if k < len(hits) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def pack(ids: bytes) -> bytes:
    import zstandard

    a = np.frombuffer(ids, "<u4")
    narrow = not len(a) or int(a.max()) < 65536
    return (b"\2" if narrow else b"\4") + zstandard.ZstdCompressor(level=1).compress(a.astype("<u2").tobytes() if narrow else ids)


def unpack(data: bytes) -> bytes:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if data[:1] == b"\2" else raw


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in their order; an odd node moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encodes ``docs(doc_id, text)`` into a store at ``path``, a folder that all executors share.

    Null text is an empty document: its stream is the end id.  A null doc_id
    comes first; rows that repeat a doc_id are documents of their own, in an
    order that their ids decide.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = pa.schema([("key", pa.binary()), ("chunk", pa.bool_()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        seen: set[bytes] = set()
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, flat, edges in encoder.column(b.column(1)):
                keys, chunk, doc, n, names, data = [], [], [], [], [], []
                for d, i, j in zip(ids[lo:hi], edges[:-1].tolist(), edges[1:].tolist()):
                    raw = flat[i:j].astype("<u4", copy=False).tobytes() + tail
                    own, start = [], 0
                    for e in cut_points(np.frombuffer(raw, "<u4")):
                        part = raw[4 * start : 4 * e]
                        start = e
                        name = digest(part)
                        own.append(name)
                        if name not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(name)
                            keys.append(name), chunk.append(True), doc.append(None), n.append(e), names.append(name), data.append(pack(part))
                    joined = b"".join(own)
                    keys.append(digest(joined + str(d).encode())), chunk.append(False), doc.append(d), n.append(len(raw) // 4), names.append(joined), data.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, chunk, doc, n, names, data), schema)], schema=schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for i, (is_chunk, name) in enumerate(zip(b.column(1).to_pylist(), b.column(0).to_pylist())):
                if not is_chunk or name not in seen:
                    keep.append(i)
                    if is_chunk:
                        seen.add(name)
            yield b.take(pa.array(keep, pa.int64()))

    kind = "key binary, chunk boolean, doc_id long, n_tokens long, digests binary, data binary"
    rows = docs.select("doc_id", "text").mapInArrow(encode, kind)
    # A chunk goes where its digest says, once from each task; a recipe where its own key says, so copies don't meet.
    base = written(rows.repartition(shuffle_partitions(spark), "key").mapInArrow(once, kind), "chunk")
    release(spark)
    _move(spark, base, path)
    recipes = base.where("not chunk").select("doc_id", "n_tokens", "digests")
    placed, _ = running(recipes, [F.col("doc_id").asc_nulls_first(), F.col("digests")], "n_tokens", "start")

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["leaf"] = [digest(f"{s},{n},".encode() + d) for s, n, d in zip(b["start"], b["n_tokens"], b["digests"])]
            yield b

    with_leaf = placed.mapInPandas(leaf, "doc_id long, n_tokens long, digests binary, start long, leaf binary").withColumn("part", F.spark_partition_id())
    with_leaf.write.parquet(f"{path}/recipes")
    roots = _roots(spark.read.parquet(f"{path}/recipes"))
    total = merkle([bytes(r["root"]) for r in roots])
    spark.createDataFrame([(r["part"], r["root"]) for r in roots] + [(-1, total)], "part int, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _move(spark: SparkSession, base: DataFrame, path: str) -> None:
    """The chunk files that ``written`` made become the store's, without another copy."""
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(base.inputFiles()[0].rsplit("/chunk=", 1)[0] + "/chunk=true") if base.inputFiles() else None
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if source is not None and fs.exists(source):
        fs.mkdirs(target.getParent())
        fs.rename(source, target)
    else:
        base.drop("chunk").limit(0).write.parquet(f"{path}/chunks")


def _roots(recipes: DataFrame) -> list:
    """The Merkle root of each recipe file: one row for each, the files' number bounds them."""

    def root(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("start", kind="stable")
        return pd.DataFrame({"part": b["part"].iloc[:1], "root": [merkle([bytes(x) for x in b["leaf"]])]})

    return sorted(recipes.select("part", "start", "leaf").groupBy("part").applyInPandas(root, "part int, root binary").collect(), key=lambda r: r["part"])


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raises ValueError if the recipes aren't those that the manifest names."""
    recipes = spark.read.parquet(f"{path}/recipes")

    def bad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wrong = [digest(f"{s},{n},".encode() + bytes(d)) != bytes(x) for s, n, d, x in zip(b["start"], b["n_tokens"], b["digests"], b["leaf"])]
            yield pd.DataFrame({"doc_id": b["doc_id"][wrong]})

    roots = _roots(recipes)
    named = {r["part"]: bytes(r["root"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = {r["part"]: bytes(r["root"]) for r in roots} | {-1: merkle([bytes(r["root"]) for r in roots])}
    if found != named or recipes.mapInPandas(bad, "doc_id long").limit(1).count():
        raise ValueError(f"the recipes in {path} don't match their manifest")


CRC_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected CRC-32 polynomials."""
    a, b = a.astype(np.uint32).copy(), b.astype(np.uint32).copy()
    out = np.zeros_like(a)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(CRC_POLY), np.uint32(0))
    return out


def _shifts(n: int) -> np.ndarray:
    """x^(32 i) for i < n: what ``i`` ids behind do to a CRC."""
    out = np.empty(max(n, 2), np.uint32)
    out[0], step, have = 0x80000000, np.uint32(zlib.crc32(b"")), 1
    # x^32 by repeated squaring of x; reflected, x is 0x40000000.
    step = np.array([0x40000000], np.uint32)
    for _ in range(5):
        step = _times(step, step)
    while have < len(out):
        more = min(have, len(out) - have)
        out[have : have + more] = _times(out[:more], np.broadcast_to(step, more))
        have += more
        step = _times(step, step)
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the store.

    Each distinct chunk is read, checked against its digest and summed up once;
    a document's CRC-32 is put together from those of its chunks.  Raises if a
    chunk doesn't match its digest or a recipe's chunk is missing.
    """
    prepare(spark)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, n, crc = b.column(0).to_pylist(), [], []
            for name, data in zip(names, b.column(1).to_pylist()):
                ids = unpack(data)
                if digest(ids) != name:
                    raise ValueError(f"chunk {name.hex()} doesn't match its digest")
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    about = spark.read.parquet(f"{path}/chunks").select(F.col("digests").alias("digest"), "data").mapInArrow(sums, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes").select("start", "doc_id", "n_tokens", "digests")
    count = (F.length("digests") / 16).cast("int")
    parts = recipes.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("digests", i * 16 + 1, F.lit(16)))).alias("pos", "digest"))
    lists = parts.join(about, "digest", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc")))).alias("parts"))
    rows = recipes.select("doc_id", "start", "n_tokens").join(lists, "start").select("doc_id", "start", "n_tokens", F.col("parts.n").alias("n"), F.col("parts.crc").alias("crc"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = _shifts(MOST + 1)
        for b in batches:
            if not b.num_rows:
                continue
            n, c = b.column(3), b.column(4)
            edges = n.offsets.to_numpy()
            count = np.diff(edges)
            ns, cs = n.values.to_numpy(), c.values.to_numpy().astype(np.uint32)
            total = np.add.reduceat(ns, edges[:-1])
            if (ns < 0).any() or (total != b.column(2).to_numpy()).any():
                raise ValueError("a recipe names chunks that the store doesn't have")
            crc = cs[edges[:-1]].copy()
            for p in range(1, int(count.max())):
                live = np.flatnonzero(count > p)
                at = edges[:-1][live] + p
                crc[live] = _times(shift[ns[at]], crc[live]) ^ cs[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every document, put together from its chunks."""
    prepare(spark)
    recipes = spark.read.parquet(f"{path}/recipes").select("start", "doc_id", "digests")
    chunks = spark.read.parquet(f"{path}/chunks").select(F.col("digests").alias("digest"), "data")
    count = (F.length("digests") / 16).cast("int")
    parts = recipes.select("doc_id", "start", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("digests", i * 16 + 1, F.lit(16)))).alias("pos", "digest"))
    lists = parts.join(chunks, "digest").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("parts"))

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "start": b["start"], "ids": [b"".join(unpack(bytes(x)) for x in p) for p in b["data"]]})

    return lists.select("doc_id", "start", F.col("parts.data").alias("data")).mapInPandas(ids, "doc_id long, start long, ids binary")


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    release(spark)
    verify_manifest(spark, path)
    return cut(read_index(spark, path))
