"""SimHash fingerprints of whole documents, and permuted block tables over them.

Terms are the runs of five words of a text (all of a shorter one), weighted by
how often they occur; each term's 64-bit hash votes on 64 bits.  Built-in
expressions only: shingles are exploded and summed in the stage that made them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import shuffle_partitions, written

WIDTH, RADIUS, BLOCKS = 5, 3, 6
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Two 32-bit counters in one long: bits b and b + 32.
PAIR = 0x0000000100000001


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def votes(hash_: Column) -> list[Column]:
    """Aggregates whose b-th counts the terms with bit b (low half) and with bit b + 32 (high half)."""
    return [F.sum(F.shiftrightunsigned(hash_, b).bitwiseAND(F.lit(PAIR))).alias(f"_v{b}") for b in range(32)]


def majority(terms: Column) -> Column:
    """The fingerprint: the bits that more than half of the ``terms`` have; without terms 0."""
    bits = []
    for b in range(32):
        low = F.col(f"_v{b}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"_v{b}"), 32)
        bits += [F.when(low * 2 > terms, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"), F.when(high * 2 > terms, F.lit((1 << (b + 32)) - (1 << 64 if b == 31 else 0))).otherwise(F.lit(0)).cast("long")]
    return F.coalesce(reduce(lambda x, y: x.bitwiseOR(y), bits), F.lit(0).cast("long"))


def fingerprints(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp`` (long) for every row of ``texts``; ``keys`` name a row.

    If the rows are already partitioned by some of the keys, nothing moves.
    """
    w = texts.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    last = F.greatest(F.size("_w") - F.lit(WIDTH), F.lit(0))
    at = w.select(*keys, "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    term = F.when(F.size("_w") > 0, F.xxhash64(F.lit(WIDTH), *[F.get("_w", F.col("_i") + j) for j in range(WIDTH)]))
    summed = at.select(*keys, term.alias("_h")).groupBy(*keys).agg(F.count("_h").alias("_n"), *votes(F.col("_h")))
    return summed.select(*keys, majority(F.col("_n")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``bucket``, ``extra`` and ``tie``: consecutive stretches of descending doc_id.

    Each stretch ends with an extra copy of the row that follows it (the first
    row of all after the last), so windows over a stretch see every successor.
    Only the first row of each stretch passes through the driver.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    points = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("p")).first()["p"] if n > 1 else []
    points = sorted(set(points or []))
    bucket = F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in points]), lambda p: p < F.coalesce("doc_id", F.lit(-(2**63))))) if points else F.lit(0)
    d = d.withColumn("bucket", bucket.cast("int")).withColumn("extra", F.lit(False))
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("tie").cast("decimal(20)")).alias("low"), "tie")
    tops = sorted((r for r in d.groupBy("bucket").agg(F.max(first).alias("top")).collect()), key=lambda r: -r["bucket"])
    if not tops:
        return d
    follow = [(a["bucket"], b["top"]["doc_id"], b["top"]["tie"]) for a, b in zip(tops, [*tops[1:], tops[0]])]
    named = F.broadcast(spark.createDataFrame(follow, "bucket int, id long, tie long"))
    found = d.drop("bucket", "extra").join(named.withColumnRenamed("tie", "t"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
    extra = found.groupBy("bucket", "doc_id", "tie").agg(F.first("text").alias("text"))
    return d.unionByName(extra.select("doc_id", "text", "tie", "bucket", F.lit(True).alias("extra")))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the contract's columns and ``fp``.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex
    digits), near_edited, near_next.  Null text is empty; a text without words
    has fingerprint 0.  A null doc_id comes last; rows that repeat a doc_id
    follow each other by a hash of their text; a single row is its own next.
    """
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")
    chars = F.char_length("text")
    tail = F.floor(chars / 3).cast("int")
    rows = with_next(docs).withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    edited = F.concat(F.substring("text", F.lit(1), chars - tail), F.substring("next_text", F.lit(1), tail))
    both = rows.select("bucket", "place", "doc_id", "extra", "tie", chars.cast("long").alias("n_chars"), "text", F.when(~F.col("extra"), edited).alias("edited"))
    both = both.select("bucket", "place", "doc_id", "extra", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    both = both.select("*", "x.kind", "x.t").where("kind = 0 or not extra")
    keys = ["bucket", "place", "doc_id", "extra", "tie", "n_chars", "edited_sha256", "kind"]
    fps = fingerprints(both, "t", keys).groupBy(*keys[:-1]).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    out = fps.withColumn("nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("extra"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "fp")


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of the block choices: fingerprints within the radius agree on one of them at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(c) for c in combinations(whole, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fps(fp)`` and ``queries(fp)`` -> pairs (query, fp, n) of distinct fingerprints at most ``radius`` bits apart.

    Each fingerprint stands in one table per choice of ``blocks - radius``
    blocks, under its bits there.  A pair is kept in the first table where it
    meets, so each comes once; ``n`` counts the rows of ``fps`` with that
    fingerprint.  Equal fingerprints pair as well.
    """
    tables = masks(radius, blocks)
    keyed = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("tab"), F.col(c).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)]))
    side = lambda df, c: df.select(c, *(["n"] if "n" in df.columns else []), keyed(c).alias("k")).select("*", "k.tab", "k.key").drop("k")
    left = side(fps.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")), "fp")
    right = side(queries.where("fp is not null").select(F.col("fp").alias("query")).distinct(), "query")
    apart = F.col("fp").bitwiseXOR(F.col("query"))
    meets = reduce(lambda rest, im: F.when(apart.bitwiseAND(F.lit(im[1])) == 0, F.lit(im[0])).otherwise(rest), reversed(list(enumerate(tables))), F.lit(-1))
    near = (left["tab"] == right["tab"]) & (left["key"] == right["key"]) & (F.bit_count(apart) <= radius) & (meets == left["tab"])
    return left.join(right, near).select("query", "fp", "n")


def with_near(rows: DataFrame) -> DataFrame:
    """``rows(fp, ...)`` with ``near_docs``: how many other rows have a fingerprint at most ``RADIUS`` bits away."""
    rows = written(rows)
    near = within_radius(rows.select("fp"), rows.select("fp")).groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("near_docs"))
    return rows.join(near, "fp").select(*rows.columns, "near_docs")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return with_near(document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("fp")
