"""Token ids: encoding, the store, packing, mixing."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import EDGES, WORD, documents, empty
from pyspark.sql import functions as F

from sablefold.llm import packing, store
from sablefold.llm.mixing import mix_sources
from sablefold.llm.tokens import Encoder, default_vocabulary

ODD = ["", " ", "\n", "a", " a  b", "a\n", "x \n y", "a b ", "\n\n a", "é ü\tz", "it's we'll can't.' x'.. 12ab,,. -- a²! b²$$ _x_", "a\x1cb", "a　b c\xa0d", "one.Two three!!!\nfour| five", "<|endoftext|> hi", "日本語 テキスト", "ß×÷ ×. é÷", None]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_are_the_tokenizers(spark, sf_dir, monkeypatch):
    texts = ODD + [t for _, t, *_ in EDGES] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for keep in (3_000_000, 50):
        monkeypatch.setattr("sablefold.llm.tokens.KEEP", keep)
        e, got = Encoder(default_vocabulary()), []
        for i in range(0, len(texts), 60):
            for _, _, ids, edges in e.column(pa.array(texts[i : i + 60], pa.string())):
                got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
        assert got == plain(texts)


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_store(documents(spark), path)
    store.verify_manifest(spark, path)
    rows = [(i, t) for i, t, *_ in EDGES]
    want = sorted(((i, [*ids, 2]) for (i, _), ids in zip(rows, plain([t for _, t in rows]))), key=str)
    got = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in store.read_documents(spark, path).collect()]
    assert sorted(got, key=str) == want
    index = store.read_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in index] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in index:
        assert r.start == at
        at += r.n_tokens
    crc = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in index) == crc


def test_chunks_are_stored_once_and_checked(spark, tmp_path):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(6000))
    rows = [(i, " ".join(f"q{rng.randint(0, 999)}" for _ in range(300)) + " " + passage) for i in range(6)]
    path = str(tmp_path / "s")
    store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path)
    chunks = spark.read.parquet(f"{path}/chunks")
    named = spark.read.parquet(f"{path}/recipes").select(F.sum(F.length("digests") / 16)).first()[0]
    assert chunks.count() == chunks.select("digests").distinct().count() < 0.45 * named
    bad = chunks.withColumn("data", F.lit(bytearray(store.pack(np.arange(5, dtype="<u4").tobytes()))))
    bad.write.parquet(f"{path}-bad/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{path}-bad/recipes")
    with pytest.raises(Exception, match="doesn't match its digest"):
        store.read_index(spark, f"{path}-bad").collect()
    changed = spark.read.parquet(f"{path}/recipes").withColumn("n_tokens", F.col("n_tokens") + 1)
    changed.write.parquet(f"{path}-bad2/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-bad2/manifest")
    with pytest.raises(ValueError, match="manifest"):
        store.verify_manifest(spark, f"{path}-bad2")


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_store(empty(spark), path)
    store.verify_manifest(spark, path)
    assert store.read_index(spark, path).count() == 0


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, 400).astype(np.uint8).tobytes(), rng.integers(0, 256, 4 * 77).astype(np.uint8).tobytes()
    shift = store._shifts(100)
    got = store._times(shift[[77]], np.array([zlib.crc32(a)], np.uint32)) ^ np.uint32(zlib.crc32(b))
    assert int(got[0]) == zlib.crc32(a + b)


def check_packing(rows, size):
    total = 0
    seqs = {}
    for r in rows:
        assert 0 < r.length <= size
        total += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs), -(-total // size)


def test_packing(spark):
    size = 64
    got = packing.pack_documents(documents(spark), size).collect()
    used, least = check_packing(got, size)
    assert used <= least + 2
    want = {}
    for (i, t, *_), ids in zip(EDGES, plain([t for _, t, *_ in EDGES])):
        want.setdefault(i, []).append([*ids, 0])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, docs in want.items():
        whole = sorted((p.start, p.length, p.ids_crc32, p.piece) for p in by[i])
        expected = []
        for ids in docs:
            first = len(ids) % size or size
            cuts = [0, *range(first, len(ids) + 1, size)]
            expected += [(s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()), k) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        assert whole == sorted(expected)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_in_many_groups(spark):
    rng = random.Random(9)
    rows = [(i, min(2048, int(rng.lognormvariate(6, 1)) + 1)) for i in range(3000)]
    items = spark.createDataFrame(rows, "item long, length long")
    got = packing.pack(items, group_size=300).join(items, "item").collect()
    assert len(got) == len(rows)
    used, least = check_packing(got, 2048)
    assert used <= 1.01 * least + 2


def whole(packing_, lengths, size):
    members, rooms = packing_
    assert sorted(i for m in members for i in m) == list(range(len(lengths)))
    assert all(r >= 0 and sum(lengths[i] for i in m) + r == size for m, r in zip(members, rooms, strict=True))
    return len(members)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 90, 200).tolist()
    a, b = (packing.fill(rng.permutation(200).tolist(), lengths, 100) for _ in range(2))
    for _ in range(20):
        whole(packing.cross(a, b, lengths, 100, rng), lengths, 100)


def test_evolution_beats_best_fit():
    """Ten sequences cut into three pieces each: best-fit decreasing needs eleven, the islands mostly find the ten."""
    size, better = 2048, 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        lengths = [int(x) for _ in range(10) for x in np.diff([0, *np.sort(rng.choice(np.arange(1, size), 2, replace=False)), size])]
        population = packing.founders(lengths, size, rng, packing.POPULATION)
        best_fit = whole(population[0], lengths, size)
        evolved = whole(packing.evolve(population, lengths, size, rng, packing.EFFORT), lengths, size)
        assert 10 <= evolved <= best_fit
        better += evolved < best_fit
    assert better >= 8


def test_pieces_that_fill_nothing_end_the_rounds(spark):
    items = spark.createDataFrame([(i, 1500 + i % 300) for i in range(900)], "item long, length long")
    got = packing.pack(items, group_size=100)
    assert got.count() == 900 == got.select("sequence_id").distinct().count()


def water(sizes, share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    lo, hi = 0.0, 1e9
    want = share * sum(sizes.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(repeats * sizes[s], weight[s] * mid) for s in names) < want else (lo, mid)
    return {s: min(repeats * sizes[s], weight[s] * lo) for s in names}


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "B", "c", None, "d", "d", "d", "d"])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix_sources(df).collect()}
    sizes, taken = {}, {}
    for i, t, s in rows:
        n = len(WORD.findall(t))
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + got[i].taken
        assert got[i].size == n and 0 <= got[i].taken <= 2 * n
    want = water(sizes)
    for i, _, s in rows:
        assert got[i].source_size == sizes[s] and abs(got[i].target - want[s]) < 1e-3
    assert all(abs(taken[s] - want[s]) <= 65 for s in sizes)
    again = {r.doc_id: r.taken for r in mix_sources(df.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def test_mixing_takes_what_a_plain_queue_takes(spark):
    """Every pass of every document in one list, sorted by virtual finish time, taken up to the budget."""
    rng = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", None, "d", "d", "d"])) for i in range(300)]
    got = {r.doc_id: r.taken for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = water(sizes)
    queue, so_far = [], dict.fromkeys(sizes, 0)
    places = []
    for i, t, s in rows:
        tie = signed(xxhash.xxh64_intdigest(t.encode(), 42))
        h = xxhash.xxh64_intdigest((17).to_bytes(4, "little"), 42)
        for x in (i, tie):
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        places.append((signed(h), i, tie, len(t.split()), s))
    for place, i, tie, n, s in sorted(places):
        so_far[s] += n
        queue += [((so_far[s] + k * sizes[s]) / target[s], place, i, tie, n) for k in (0, 1) if n]
    left, want = int(1.5 * sum(sizes.values())), dict.fromkeys(got, 0)
    for _, _, i, _, n in sorted(queue):
        want[i] += min(n, left)
        left -= min(n, left)
    assert got == want


def test_mixing_edges(spark):
    rows = mix_sources(documents(spark)).collect()
    assert len(rows) == len(EDGES) and all(r.taken <= 2 * r.size for r in rows)
    assert mix_sources(empty(spark)).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()] == [0, 0]
