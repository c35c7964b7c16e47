"""N-gram Jaccard self-join with PartEnum signatures.

A document is the set of its distinct five-word shingles.  Documents with the
same set are one class.  Two classes can only link if at least ``percent`` of
either's shingles occur in another class too, so a first exact pass counts, for
every class, its shingles that another class has, and leaves out all classes
below that share.  The classes that remain emit PartEnum signatures:

* sizes fall into narrow bands; a set puts out signatures for its own band and
  for each larger one that could hold a partner;
* in a band of sizes up to ``r`` two linked sets differ in at most
  ``k = 2r(1-t)/(1+t)`` shingles.  The domain is cut by hash into ``n1`` parts
  of ``n2`` cells; some part holds at most ``k2`` of the differences, so the
  sets agree there in a choice of ``n2-k2`` cells, and each such choice is a
  signature;
* ``n1`` has ``slack`` parts more than that argument needs.  A set that has no
  more than ``slack`` parts with an empty choice of cells leaves its empty
  signatures out, since a linked set still shares one that isn't empty.

Classes with a common signature are compared exactly.  A first round, over one
signature in ``FIRST``, compares the members of a signature with one of them
only, which puts most near copies into one component.  The second round takes
all signatures and compares all members that are in different components: two
as a pair; of more, all that share a signature with the same largest component
are a star, whose members in different components are compared in blocks,
without listing the pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .joins import matched
from .session import cut, prepare, release, shuffle_partitions, written
from .words import U, mix, shingles, slabs, sorted_sets, sums_by, word_hashes, word_spans

WIDTH, PERCENT = 5, 75
RATIO = 1.125  # of the largest to the smallest size of a band
CHUNK = 1 << 20  # shingles that one block of the counting pass holds
BUCKET = 2 << 20  # shingles that one task of the counting pass reads, about
FIRST = 8  # one signature in so many counts in the first round; the second round has them all
FILTER_BITS = 25
BLOCK = 512  # classes of a star that meet with as many others at a time
PER_TASK = 3000  # classes that a task of such meetings reads, about


def document_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts ``lo:hi`` of the column: sorted distinct shingle hashes and the size of each set."""
    for slab in slabs(column):
        starts, ends, counts = word_spans(slab)
        sh, n = shingles(word_hashes(slab, starts, ends), counts, width)
        yield slab.lo, slab.hi, *sorted_sets(sh, n)


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, and two 64-bit sums that name the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, values, n in document_sets(b.column(1), width):
                s1, s2 = (sums_by(mix(values, salt), n).view(np.int64) for salt in (1, 2))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2)], schema=schema)

    return docs.mapInArrow(keys, "doc_id long, n_shingles long, s1 long, s2 long")


def shared_counts(docs: DataFrame, total: int, width: int = WIDTH) -> DataFrame:
    """s1, shared: how many of a set's shingles another set has too, or more (never fewer).

    Tasks send blocks of hashes, one for each of ``total / BUCKET`` hash ranges,
    in runs that belong to one set; a block names only the sets it has shingles
    of.  A shingle that several sets of a block have is sent once, without a
    set, and counted there, so a shingle that all documents have is one entry
    of each block.  A set that several blocks hold may count such shingles
    twice.  Counts come back in as many parts, by set.  What is sent either way
    follows the number of shingles.  Rows without a ``doc_id`` are left out.
    """
    buckets = max(8, -(-total // BUCKET))
    block_schema = pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("many", pa.binary()), ("local", pa.binary())])
    part_schema = pa.schema([("part", pa.int32()), ("sets", pa.binary()), ("counts", pa.binary()), ("local", pa.bool_())])

    def five(hashes: np.ndarray) -> bytes:
        return (hashes & U((1 << 40) - 1)).astype("<u8")[:, None].view(np.uint8)[:, :5].tobytes()

    def wide(low: bytes) -> np.ndarray:
        out = np.zeros((len(low) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
        return out.view("<u8").ravel()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, known = 0, set()

        def flush() -> pa.RecordBatch:
            sets, n = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
            values = np.concatenate([x[1] for x in held])
            owner = np.repeat(np.arange(len(sets), dtype=np.int64), n)
            order = np.argsort(values)
            s, who = values[order], owner[order]
            again = np.zeros(len(s) + 1, bool)
            again[1:-1] = s[1:] == s[:-1]
            many = again[:-1] | again[1:]
            local = np.bincount(who[many], minlength=len(sets))
            # A shingle of several sets here goes out under no set, once.
            sent = ~again[:-1]
            s, who = s[sent], np.where(many, len(sets), who)[sent]
            part = ((s >> U(40)) * U(buckets) >> U(24)).astype(np.int64)
            by = np.argsort(part * (len(sets) + 1) + who)
            s, who, part = s[by], who[by], part[by]
            edges = np.searchsorted(part, np.arange(buckets + 1))
            rows = []
            for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if i < j:
                    k = i + int(np.searchsorted(who[i:j], len(sets)))
                    begin = np.flatnonzero(np.diff(who[i:k], prepend=-1))
                    runs = np.diff(np.append(begin, k - i)).astype(np.uint32)
                    rows.append({"bucket": b, "sets": sets[who[i:k][begin]].tobytes(), "counts": runs.tobytes(), "low": five(s[i:k]), "many": five(s[k:j]), "local": b""})
            # The block's own counts travel with any one bucket.
            some = np.flatnonzero(local)
            if len(some):
                rows.append({"bucket": int(sets[some[0]] % buckets), "sets": sets[some].tobytes(), "counts": b"", "low": b"", "many": b"", "local": local[some].astype(np.uint32).tobytes()})
            held.clear(), known.clear()
            return pa.RecordBatch.from_pylist(rows, schema=block_schema)

        for b in batches:
            for _, _, values, n in document_sets(b.column(1), width):
                names = sums_by(mix(values, 1), n).view(np.int64)
                fresh = np.array([k > 0 and not (x in known or known.add(x)) for x, k in zip(names.tolist(), n.tolist())], bool)
                held.append((names[fresh], values[np.repeat(fresh, n)], n[fresh]))
                size += int(n[fresh].sum())
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def parts(sets: np.ndarray, counts: np.ndarray, local: bool) -> Iterator[dict]:
        to = (sets.view(U) % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        sets, counts, to = sets[order], counts[order].astype(np.uint32), to[order]
        edges = np.searchsorted(to, np.arange(buckets + 1))
        for p, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if i < j:
                yield {"part": p, "sets": sets[i:j].tobytes(), "counts": counts[i:j].tobytes(), "local": local}

    def count(block: pa.Table) -> pa.Table:
        out, sets, runs, hashes, free = [], [], [], [], []
        for names, n, low, many, own in zip(*(block.column(k).to_pylist() for k in ("sets", "counts", "low", "many", "local"))):
            names = np.frombuffer(names, np.int64)
            if own:
                out += parts(names, np.frombuffer(own, np.uint32), True)
            else:
                sets.append(names), runs.append(np.frombuffer(n, np.uint32)), hashes.append(wide(low)), free.append(wide(many))
        if sets:
            uniq, code = np.unique(np.concatenate(sets), return_inverse=True)
            # A shingle without a set is one of a set unlike all others.
            owner = np.concatenate([np.repeat(code.astype(np.uint32), np.concatenate(runs)), np.full(sum(map(len, free)), len(uniq), np.uint32)])
            s = np.concatenate([*hashes, *free])
            del sets, runs, hashes, free, code
            if len(uniq) >> 24:
                order = np.lexsort((owner, s))
                s, owner = s[order], owner[order]
            else:
                s <<= U(24)
                s |= owner
                s.sort()
                owner = (s & U((1 << 24) - 1)).astype(np.uint32)
                s >>= U(24)
            new = np.concatenate([[True], s[1:] != s[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            # Shared: the smallest and the largest set of the run differ, or the run has entries without a set.
            mixed = (owner[first] != owner[last]) | (owner[last] == len(uniq))
            del s
            new[1:] |= owner[1:] != owner[:-1]
            new &= np.repeat(mixed, last - first + 1)
            found = np.bincount(owner[new], minlength=len(uniq) + 1)[:-1]
            out += parts(uniq[found > 0], found[found > 0], False)
        return pa.Table.from_pylist(out, schema=part_schema)

    def fold(part: pa.Table) -> pa.Table:
        local = part.column("local").to_numpy()
        n = [np.frombuffer(x, np.uint32).astype(np.int64) for x in part.column("counts").to_pylist()]
        names, code = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in part.column("sets").to_pylist()]), return_inverse=True)
        own = np.repeat(local, [len(x) for x in n])
        n = np.concatenate(n)
        most = np.zeros(len(names), np.int64)
        np.maximum.at(most, code[own], n[own])
        total = np.bincount(code[~own], n[~own], minlength=len(names)).astype(np.int64) + most
        return pa.table({"s1": names, "shared": total})

    sent = docs.where("doc_id is not null").mapInArrow(blocks, "bucket int, sets binary, counts binary, low binary, many binary, local binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "part int, sets binary, counts binary, local boolean")
    return counted.groupBy("part").applyInArrow(fold, "s1 long, shared long")


@cache
def bands(upto: int) -> tuple[tuple[int, int], ...]:
    """Smallest and largest size of each band, up to the one that holds ``upto``."""
    out, low = [], 1
    while not out or out[-1][1] < upto:
        out.append((low, max(low, int(low * RATIO))))
        low = out[-1][1] + 1
    return tuple(out)


@cache
def band_plan(largest: int, percent: int) -> tuple[int, int, int, np.ndarray]:
    """n1, n2, slack and the cell choices for sets of at most ``largest`` shingles."""
    k = (2 * largest * (100 - percent)) // (100 + percent)
    k2 = min(k, 1)
    need = k // (k2 + 1) + 1
    n2 = k2 * 2 + 1
    picks = np.array([[c in chosen for chosen in combinations(range(n2), n2 - k2)] for c in range(n2)], dtype=U)
    slack = need // 4
    return need + slack, n2, slack, picks


def signatures(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of one sorted set of shingle hashes."""
    n = len(values)
    scale = bands(1 << (n * 100 // percent + 1).bit_length())
    out = []
    for band in range(bisect_left(scale, n, key=lambda b: b[1]), len(scale)):
        low, largest = scale[band]
        # its partners in a later band have the band's smallest size at least
        if low > n and n * 100 < percent * low:
            break
        n1, n2, slack, picks = band_plan(largest, percent)
        cell = (mix(values, 3 + band) >> U(40)).astype(np.int64) * (n1 * n2) >> 24
        order = np.argsort(cell, kind="stable")
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(values, 101)[order], dtype=U)])
            edges = np.searchsorted(cell[order], np.arange(n1 * n2 + 1))
            sums = (total[edges[1:]] - total[edges[:-1]]).reshape(n1, n2)
            held = np.diff(edges).reshape(n1, n2).astype(U) @ picks
            label = (np.arange(n1, dtype=U)[:, None] * U(4) + np.arange(picks.shape[1], dtype=U)[None, :]) * U(1 << 12) + U(band)
            sig = mix(sums @ picks + mix(label, 5))
        empty = held == 0
        out.append(sig[~empty] if int(empty.any(axis=1).sum()) <= slack else sig.ravel())
    return np.concatenate(out)


def _signature_rows(sets: DataFrame, percent: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """cls, comp, rank, sig for every signature of ``sets(cls, comp, rank, body)`` that ``wanted`` lets through."""
    names = ["cls", "comp", "rank", "sig"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            about = [b.column(k).to_numpy() for k in range(3)]
            for i, body in enumerate(b.column(3)):
                sig = signatures(body.values.to_numpy().view(U), percent)
                sig = sig if wanted is None else sig[wanted(sig)]
                if len(sig):
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(sig), a[i])) for a in about), pa.array(sig.view(np.int64))], names=names)

    return sets.select("cls", "comp", "rank", "body").mapInArrow(emit, "cls long, comp long, rank long, sig long")


def _filter(sigs: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A bit table of fixed size (4 MB) that lets all of ``sigs`` through, and others the less the fewer there are."""
    bit = F.col("sig").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = sigs.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sent = sigs.sparkSession.sparkContext.broadcast(table.view(U))

    def wanted(sig: np.ndarray) -> np.ndarray:
        at = sig & U((1 << FILTER_BITS) - 1)
        return (sent.value[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1

    return wanted


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets are similar enough."""
    a = sets.select(F.col("cls").alias("a"), F.col("body").alias("body_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("body").alias("body_b"))
    both = F.size(F.array_intersect("body_a", "body_b"))
    size = F.size("body_a") + F.size("body_b")
    sized = pairs.join(b, "b").join(a, "a").where((F.size("body_a") * 100 >= F.size("body_b") * percent) & (F.size("body_b") * 100 >= F.size("body_a") * percent))
    return sized.where(both * 100 >= (size - both) * percent).select("a", "b")


def _star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members(star, cls, comp)`` -> (a, b): links that tie together all linked classes of a star.

    A star is cut into blocks of about ``BLOCK`` classes: a component of that
    many has blocks of its own, which don't meet each other, and the others
    share theirs.  Each pair of blocks that meets is a piece of work that
    compares its classes and puts out a spanning forest of what links, not the
    links.  So the work is that of the classes outside of the largest
    component, each block of them with all classes.  A task takes many pieces.
    """
    sizes = cut(members.groupBy("star", "comp").agg(F.count("*").alias("c")))
    shared = sizes.where(F.col("c") < BLOCK).groupBy("star").agg(F.ceil(F.sum("c") / BLOCK).alias("shared"))
    homes = cut(sizes.join(shared, "star", "left").select("star", "comp", "c", F.when(F.col("c") >= BLOCK, F.col("comp")).alias("home"), F.when(F.col("c") >= BLOCK, F.ceil(F.col("c") / BLOCK)).otherwise(F.col("shared")).alias("of")))
    name = lambda no: F.xxhash64(F.col("home").isNull(), "home", no)
    blocks = homes.select("star", "home", "of").distinct().select("star", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("no")).select("star", "home", name(F.col("no")).alias("block"))
    top = sizes.groupBy("star").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"))
    blocks = cut(blocks.join(top, "star").select("star", "home", "block", F.coalesce(F.col("home") == F.col("top"), F.lit(False)).alias("top")))
    x = blocks.where("not top").select("star", F.col("home").alias("home_x"), F.col("block").alias("lo"))
    y = blocks.select("star", F.col("home").alias("home_y"), F.col("block").alias("hi"), "top")
    meet = cut(x.join(y, "star").where("(top or lo <= hi) and (home_x is null or home_y is null or home_x <> home_y)").select("star", "lo", "hi"))
    mine = matched(members, homes, ["star", "comp"]).select("cls", "star", name(F.pmod(F.xxhash64("cls"), F.col("of"))).alias("block"))
    one = mine.join(meet.withColumn("block", F.col("lo")), ["star", "block"]).withColumn("first", F.lit(True))
    two = mine.join(meet.where("lo <> hi").withColumn("block", F.col("hi")), ["star", "block"]).withColumn("first", F.lit(False))
    work = cut(one.union(two).drop("block"))
    tasks = max(1, work.count() // PER_TASK)
    full = work.join(sets.select("cls", "comp", "body"), "cls").withColumn("task", F.pmod(F.xxhash64("star", "lo", "hi"), F.lit(tasks)))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["star", "lo", "hi", "cls"], ignore_index=True)
        key = b[["star", "lo", "hi"]].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        cls, comp, first, bodies, diagonal = b["cls"].to_numpy(), b["comp"].to_numpy(), b["first"].to_numpy(), b["body"].to_list(), (key[:, 1] == key[:, 2])
        out_a, out_b = [], []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if j - i > 1 and (comp[i:j] != comp[i]).any():
                rows = np.arange(j - i)
                x, y = linked_sets(bodies[i:j], comp[i:j], rows if diagonal[i] else np.flatnonzero(first[i:j]), rows if diagonal[i] else np.flatnonzero(~first[i:j]), percent)
                out_a.append(cls[i:j][x]), out_b.append(cls[i:j][y])
        return pd.DataFrame({"a": np.concatenate(out_a or [np.empty(0, np.int64)]), "b": np.concatenate(out_b or [np.empty(0, np.int64)])})

    return full.groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def linked_sets(bodies: list[np.ndarray], comp: np.ndarray, rows: np.ndarray, cols: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the sets ``rows`` and ``cols`` that are in different components."""
    size = np.array([len(x) for x in bodies])
    values = np.concatenate(bodies)
    owner = np.repeat(np.arange(len(bodies)), size)
    order = np.argsort(values, kind="stable")
    s, o = values[order], owner[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    keep = same[1:] | same[:-1]  # shingles of one class alone are in no intersection
    term = np.cumsum(~same[:-1][keep]) - 1
    o = o[keep]
    at, at2 = np.full(len(bodies), -1), np.full(len(bodies), -1)
    at[rows], at2[cols] = np.arange(len(rows)), np.arange(len(cols))
    both = np.zeros((len(rows), len(cols)), np.float32)
    terms = int(term[-1]) + 1 if len(term) else 0
    for lo in range(0, terms, 4096):
        i, j = np.searchsorted(term, [lo, lo + 4096])
        t, d = term[i:j] - lo, o[i:j]
        wide = min(4096, terms - lo)
        x, y = np.zeros((len(rows), wide), np.float32), np.zeros((len(cols), wide), np.float32)
        x[at[d][at[d] >= 0], t[at[d] >= 0]] = 1
        y[at2[d][at2[d] >= 0], t[at2[d] >= 0]] = 1
        both += x @ y.T
    union = size[rows][:, None] + size[cols][None, :] - both
    p, q = np.nonzero(both * 100 >= union * percent)
    p, q = rows[p], cols[q]
    apart = comp[p] != comp[q]
    root = forest(len(bodies), p[apart], q[apart])
    moved = np.flatnonzero(root != np.arange(len(bodies)))
    return root[moved], moved


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, itself
    included.  Null, empty and blank texts have no shingles and link with
    nothing; a row without doc_id isn't linked and keeps a null component.
    Rows that repeat a doc_id are documents of their own with one name.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    keys = cut(set_keys(docs, width))
    total = keys.agg(F.sum("n_shingles")).first()[0] or 0
    key = ["n_shingles", "s1", "s2"]
    named = keys.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("cls"))
    shared = shared_counts(docs, total, width)
    likely = named.select(*key).distinct().join(shared, "s1").where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select(*key)
    wanted = cut(classes.join(likely, key).select("cls", *key))
    release(spark)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, values, n in document_sets(b.column(1), width):
                s1, s2 = (sums_by(mix(values, salt), n).view(np.int64) for salt in (1, 2))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), lists], names=["cls", "n_shingles", "s1", "s2", "body"])

    texts = docs.join(wanted.select(F.col("cls").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    made = texts.mapInArrow(bodies, "cls long, n_shingles long, s1 long, s2 long, body array<long>")
    sets = written(made.join(wanted, ["cls", *key], "left_semi").dropDuplicates(["cls", *key]).select("cls", F.col("cls").alias("comp"), F.lit(0).cast("long").alias("rank"), "body"))
    release(spark)
    # Round one, over a part of the signature space.  The class that shares most leads its groups: the text that
    # the others were copied from shares more with each copy than they with each other.
    spread = sets.repartition(shuffle_partitions(spark), "cls")
    part = lambda sig: (sig >> U(7)) % U(FIRST) == 0
    sizes = _signature_rows(spread, percent, part).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(_signature_rows(spread, percent, part).join(sizes, "sig").select("sig", "cls", "n"))
    share = met.groupBy("cls").agg(F.sum("n").alias("share"))
    leads = met.join(share, "cls").groupBy("sig").agg(F.max(F.struct("share", (-F.col("cls")).alias("low"))).alias("top")).select("sig", (-F.col("top.low")).alias("lead"))
    first = cut(met.join(leads, "sig").where("cls <> lead").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct())
    links = cut(_verified(first, sets, percent))
    linked = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    del sizes, met, share, leads
    release(spark)
    # Round two, over all signatures: whatever isn't in one component yet.  Two classes are a pair; groups of more
    # put their members into one cluster.
    comps = linked.join(linked.groupBy("component").agg(F.count("*").alias("n")), "component")
    # Larger components rank higher; equal ranks of two components do no harm.
    rank = F.shiftleft(F.least("n", F.lit((1 << 18) - 1)), 44).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.coalesce("component", "cls")), 20))
    now = written(spread.drop("comp", "rank").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))).select("cls", F.coalesce("component", "cls").alias("comp"), rank.alias("rank"), "body"))
    groups = _signature_rows(now, percent).groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("a"), F.max("cls").alias("b"), F.bit_xor(F.xxhash64("cls")).alias("members"), F.max("rank").alias("star")).where("lo < hi")
    two = F.col("members") == F.xxhash64("a").bitwiseXOR(F.xxhash64("b"))
    mixed = cut(groups.groupBy("a", "b", "members", "star", two.alias("two")).agg(F.min("sig").alias("sig")))
    del groups
    release(spark)
    second = mixed.where("two").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    links = links.union(cut(_verified(second, sets, percent)))
    large = mixed.where("not two").select("sig", "star")
    if large.take(1):
        members = cut(_signature_rows(now, percent, _filter(large)).join(large, "sig").select("star", "cls", "comp").distinct())
        links = links.union(cut(_star_links(members, now, percent)))
    linked = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named_by = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select(*key, F.coalesce("component", "cls").alias("component_id"))
    rows = keys.join(named_by, key, "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
