"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's ids and an end id are one piece, or, beyond ``size`` tokens,
pieces of ``size`` with a shorter first one.  Full pieces are sequences.  The
others are dealt by hash into groups of about ``GROUP`` pieces, and each group
is packed on ``ISLANDS`` islands: populations of packings that start from best
fit over orders from decreasing to random.  A crossover injects some of the
best-filled whole sequences of one parent into the other, drops the sequences
there that hold a piece twice, and best-fits what that displaced.  An island
goes on until ``PATIENCE`` generations in a row bring nothing, or more in a small
group, or until no packing can have fewer sequences and all but one are full.  Between the two epochs each island's best packing moves
to the next island, where it meets new founders.  Sequences that stay emptier
than ``keep`` are dissolved, and their pieces are dealt and packed again in
fewer groups, until one group is left or a round leaves more than ``SHRINK`` of
the pieces before it: then the lengths that are left don't fill sequences, in
whatever company.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, prepare
from .tokens import Encoder

SIZE, END = 2048, 0
GROUP, ISLANDS, POPULATION, PATIENCE, EFFORT = 4096, 2, 8, 2, 8_000
KEEP, SHRINK = 0.99, 0.9
NEAR, TRIED = 16, 6  # displaced pieces, and pieces of a sequence, that are tried in pairs


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs(doc_id, text)``; null text is empty."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, flat, edges in encoder.column(b.column(1)):
                rows = []
                for d, i, j in zip(ids[lo:hi], edges[:-1].tolist(), edges[1:].tolist()):
                    raw = flat[i:j].astype("<u4", copy=False).tobytes() + tail
                    n = j - i + 1
                    first = n % size or size
                    cuts = [0, *range(first, n + 1, size)]
                    rows += [(d, k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Sequences under construction: members, room left, and the open ones by room."""

    def __init__(self, size: int):
        self.size, self.members, self.room = size, [], []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def open(self, members: list[int], room: int) -> None:
        self.members.append(members)
        self.room.append(room)
        self._file(len(self.room) - 1, room)

    def _file(self, b: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(b)
        self.mask |= 1 << room

    def best_fit(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.open([item], self.size - length)
            return
        room = length + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        b = held.pop()
        if not held:
            self.mask &= ~(1 << room)
        self.members[b].append(item)
        self.room[b] = room - length
        self._file(b, room - length)


Packing = tuple[list[list[int]], list[int]]  # the pieces of each sequence, and the room left in it


def fill(order: Iterable[int], lengths: list[int], size: int, start: Packing | None = None) -> Packing:
    """Best fit of ``order`` into new sequences beside those of ``start``."""
    bins = Bins(size)
    for members, room in zip(*start) if start else ():
        bins.open(members[:], room)
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.members, bins.room


def as_packing(groups: Iterable[list[int]], lengths: list[int], size: int) -> Packing:
    members = list(groups)
    return members, [size - sum(lengths[i] for i in m) for m in members]


def fitness(packing: Packing, size: int) -> tuple[float, float]:
    """Fewer sequences first; then the mean square of their fill, so that what is free lies together."""
    rooms = packing[1]
    return -len(rooms), sum((1 - r / size) ** 2 for r in rooms) / max(1, len(rooms))


def settled(packing: Packing, lengths: list[int], size: int) -> bool:
    """No packing has fewer sequences, and all but one are as full as those that are kept."""
    return len(packing[1]) <= -(-sum(lengths) // size) and sum(r > size - int(KEEP * size) for r in packing[1]) <= 1


def cross(a: Packing, b: Packing, lengths: list[int], size: int, rng: np.random.Generator) -> Packing:
    """Well-filled sequences of ``a`` go whole into ``b``, where pieces that are there twice dissolve their sequences."""
    best = sorted(range(len(a[0])), key=a[1].__getitem__)
    chosen = best[: int(rng.integers(1, 1 + max(1, len(best) - 1)))]
    injected = {i for k in chosen for i in a[0][k]}
    kept, displaced = [], []
    for k, m in enumerate(b[0]):
        if injected.isdisjoint(m):
            kept.append(k)
        else:
            displaced += [i for i in m if i not in injected]
    # Mutation: a few of the emptiest sequences are dissolved too.
    kept.sort(key=b[1].__getitem__, reverse=True)
    drop = int(rng.integers(0, 1 + max(1, len(kept) // 20)))
    displaced += [i for k in kept[:drop] for i in b[0][k]]
    displaced.sort(key=lambda i: -lengths[i])
    start = [a[0][k] for k in chosen] + [b[0][k] for k in kept[drop:]], [a[1][k] for k in chosen] + [b[1][k] for k in kept[drop:]]
    start, displaced = trade(start, displaced, lengths)
    return fill(sorted(displaced, key=lambda i: -lengths[i]), lengths, size, start)


def trade(packing: Packing, displaced: list[int], lengths: list[int]) -> tuple[Packing, list[int]]:
    """Sequences give up to two pieces for up to two displaced ones that fill them better, so smaller pieces are left to place."""
    members, rooms = [], []
    for m, room in zip(*packing):
        m = m[:]
        while room and displaced:
            # Sums of one or two displaced pieces, in order; of many, those next to each other in size stand for all.
            near = displaced if len(displaced) <= NEAR else displaced[:: -(-len(displaced) // NEAR)]
            offers = sorted([(lengths[i], (i,)) for i in near] + [(lengths[i] + lengths[j], (i, j)) for i, j in combinations(near, 2)])
            best = None
            for out in [(i,) for i in m] + list(combinations(m[:TRIED], 2)):
                held = sum(lengths[i] for i in out)
                k = bisect_right(offers, held + room, key=lambda o: o[0]) - 1
                if k >= 0 and offers[k][0] > held and (best is None or offers[k][0] - held > best[0]):
                    best = offers[k][0] - held, out, offers[k][1]
            if best is None:
                break
            gain, out, in_ = best
            m = [i for i in m if i not in out] + list(in_)
            displaced = [i for i in displaced if i not in in_] + list(out)
            room -= gain
        members.append(m), rooms.append(room)
    return (members, rooms), displaced


def founders(lengths: list[int], size: int, rng: np.random.Generator, n: int) -> list[Packing]:
    """Best fit of ``n`` orders: decreasing, decreasing but disturbed more and more, and, last, any."""
    size_of = np.array(lengths)
    orders = [np.argsort(-size_of, kind="stable")]
    orders += [np.argsort(-(size_of + rng.normal(0, size / 100 * 2**k, len(lengths))), kind="stable") for k in range(n - 2)]
    return [fill(o.tolist(), lengths, size) for o in [*orders, rng.permutation(len(lengths))][:n]]


def evolve(population: list[Packing], lengths: list[int], size: int, rng: np.random.Generator, effort: int) -> Packing:
    """The best packing once it is settled or some generations in a row, of ``effort`` pieces in all, brought none better."""
    ranked = sorted(((fitness(p, size), p) for p in population), key=lambda x: x[0], reverse=True)
    idle, patience = 0, max(PATIENCE, effort // max(1, len(lengths)))
    while True:
        if idle >= patience or settled(ranked[0][1], lengths, size) or len(ranked) < 2:
            break
        before = ranked[0][0]
        pairs = [rng.permutation(len(ranked))[:2] for _ in range(len(population) - 1)]
        children = [cross(ranked[int(i)][1], ranked[int(j)][1], lengths, size, rng) for i, j in pairs]
        # One of each fitness stays, so that no packing fills the population with itself.
        by = dict(reversed([*ranked, *((fitness(c, size), c) for c in children)]))
        ranked = sorted(by.items(), key=lambda x: x[0], reverse=True)[: len(population)]
        idle = 0 if ranked[0][0] > before else idle + 1
    return ranked[0][1]


def pack(items: DataFrame, size: int = SIZE, keep: float = KEEP, group_size: int = GROUP) -> DataFrame:
    """``items(item, length)`` with distinct ids and 0 < length <= size -> item, sequence_id, offset."""
    spark = items.sparkSession
    prepare(spark)
    full = items.where(F.col("length") == size).select("item", F.col("item").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = cut(items.where(F.col("length") < size).select("item", "length")), [full]
    n, before, turn = rest.count(), None, 0
    while n:
        groups = max(1, -(-n // group_size))
        last = groups == 1 or (before is not None and n > SHRINK * before)
        packed = cut(_round(rest, size, groups, turn))
        if last:
            done.append(packed.select("item", "sequence_id", "offset"))
            break
        good = F.col("filled") >= F.lit(int(keep * size))
        done.append(packed.where(good).select("item", "sequence_id", "offset"))
        rest = packed.where(~good).select("item", "length")
        before, n, turn = n, rest.count(), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _round(items: DataFrame, size: int, groups: int, turn: int) -> DataFrame:
    """One packing of every group: item, length, sequence_id, offset, filled."""
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(groups)).cast("int")).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))

    def first(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("item", ignore_index=True)
        lengths = b["length"].tolist()
        rng = np.random.default_rng([turn, *map(int, key)])
        best = evolve(founders(lengths, size, rng, POPULATION), lengths, size, rng, EFFORT)
        b["bin"] = _labels(best, len(b))
        return b[["grp", "island", "item", "length", "bin"]]

    def second(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        own = b[~b["moved"]].sort_values("item", ignore_index=True)
        guest = b[b["moved"]].sort_values("item", ignore_index=True)
        lengths = own["length"].tolist()
        rng = np.random.default_rng([turn, 77, *map(int, key)])
        elite = [as_packing((x.tolist() for x in p.groupby("bin").indices.values()), lengths, size) for p in (own, guest)]
        best = evolve([*elite, *founders(lengths, size, rng, POPULATION - 2)], lengths, size, rng, EFFORT)
        own["bin"] = _labels(best, len(own))
        own["rank"], own["quality"] = (float(x) for x in fitness(best, size))
        return own[["grp", "island", "item", "length", "bin", "rank", "quality"]]

    def choose(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        top = b.sort_values(["rank", "quality", "island"], ascending=[False, False, True])["island"].iloc[0]
        b = b[b["island"] == top].sort_values(["bin", "length", "item"], ascending=[True, False, True])
        ends = b.groupby("bin")["length"].cumsum()
        return pd.DataFrame({"item": b["item"], "length": b["length"], "sequence_id": (turn << 56) + (int(key[0]) << 16) + b["bin"].astype("int64"), "offset": ends - b["length"], "filled": b.groupby("bin")["length"].transform("sum")})

    elite = dealt.groupBy("grp", "island").applyInPandas(first, "grp int, island int, item long, length long, bin int")
    both = elite.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("moved"))
    both = both.withColumn("island", F.when(F.col("moved"), (F.col("island") + 1) % ISLANDS).otherwise(F.col("island")))
    evolved = both.groupBy("grp", "island").applyInPandas(second, "grp int, island int, item long, length long, bin int, rank double, quality double")
    return evolved.groupBy("grp").applyInPandas(choose, "item long, length long, sequence_id long, offset long, filled long")


def _labels(packing: Packing, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, m in enumerate(packing[0]):
        out[m] = k
    return out


def pack_documents(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document, also one with a null or repeated
    doc_id, and null or empty text is a piece of the end id alone.  An empty
    table gives an empty result.
    """
    own = cut(pieces(docs, size, vocabulary).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(own.select("item", "length"), size)
    return own.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
