"""Near duplicates: n-gram Jaccard groups, embeddings, components, lines, fingerprints."""

import hashlib
import math
import random
import re

import numpy as np
import xxhash
from helpers import EDGES, TEXT, documents, empty, groups, near_lines, shingles
from pyspark.sql import functions as F

from sablefold.llm import jaccard, joins, simhash
from sablefold.llm.components import components
from sablefold.llm.embeddings import near_embeddings, plan
from sablefold.llm.lines import dedup_lines, repeated_lines
from sablefold.llm.words import U


def brute_groups(rows):
    found = groups([shingles(t) if i is not None else frozenset() for i, t in rows])
    least = {}
    for (i, _), g in zip(rows, found):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((i, len(shingles(t)), None if i is None else least[g]) for (i, t), g in zip(rows, found) if i is not None)


def corpus(seed, n=220):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.choice((3, 6, 12, 40, 150)))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 9))):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        out.append((i, " ".join(words)))
    return out


def test_jaccard_groups_are_those_of_all_pairs(spark):
    rows = corpus(5)
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_clusters_in_blocks(spark, monkeypatch):
    """Copies that link through their original only, with small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        copy = list(words)
        for k in rng.sample(range(150), rng.choice((2, 3, 4, 5, 6))):
            copy[k] = f"y{i}_{k}"
        rows.append((i + 10, " ".join(copy)))
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_jaccard_edges(spark):
    rows = [(i, t) for i, t, *_ in EDGES]
    got = [tuple(r) for r in jaccard.jaccard_groups(documents(spark)).collect()]
    assert len(got) == len(rows) and [r for r in got if r[0] is None] == [(None, 16, None)]
    assert sorted(r for r in got if r[0] is not None) == brute_groups(rows)
    assert jaccard.jaccard_groups(empty(spark)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        both = int(np.ceil(0.75 * n))
        a = rng.integers(0, 2**63, n).astype(U)
        more = int(rng.integers(0, n - both + 1)) if n > both else 0
        only = n - both - more
        x = np.sort(a[: both + only])
        y = np.sort(np.concatenate([a[:both], a[both + only :]]))
        inter = len(np.intersect1d(x, y))
        if inter * 100 >= 75 * len(np.union1d(x, y)):
            assert np.intersect1d(jaccard.signatures(x), jaccard.signatures(y)).size


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    want = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    want[k] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: min(s) for k, s in want.items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(300):
        c = centres[i % 12]
        rows.append((i, [float(x) for x in (c + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.6])).astype(np.float32)]))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [2 * x for x in rows[0][1]])]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [float("inf")] * 16), (404, []), (405, [None] + [1.0] * 15), (None, rows[0][1]), (406, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cls", F.lit(1))
    got = {r.vec_id: r for r in near_embeddings(df, block=40).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    ids = [r[0] for r in rows]
    assert [got[i].n_links for i in ids] == link.sum(axis=1).tolist()
    reach = {i: {i} for i in range(len(ids))}
    for i, j in zip(*np.nonzero(link)):
        if reach[i] is not reach[j]:
            reach[i] |= reach[j]
            for k in reach[j]:
                reach[k] = reach[i]
    assert [got[i].component_id for i in ids] == [ids[min(reach[k])] for k in range(len(ids))]
    for i in [r[0] for r in odd]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert near_embeddings(df.limit(0)).count() == 0


def test_tables_keep_their_promise():
    for n in (10, 10_000, 10**9):
        bits, tables = plan(n, 0.95, 1e-5)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 1e-5


def line_rows(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.choice((1, 2, 4, 9, 10, 12, 25)))) for _ in range(40)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(lines).split(" ")
            edit = rng.choice(("", "", "swap", "cut", "add", "two"))
            for _ in range(2 if edit == "two" else 1):
                k = rng.randrange(len(w))
                if edit in ("swap", "two"):
                    w[k] = f"z{rng.randint(0, 5)}"
                elif edit == "cut" and len(w) > 1:
                    del w[k]
                elif edit == "add":
                    w.insert(k, f"z{rng.randint(0, 5)}")
            text.append(rng.choice(("", "  ")) + "  ".join(w).title())
        rows.append((d, "\n".join(text)))
    return rows


def test_lines_that_go(spark):
    for seed in (1, 2):
        rows = line_rows(seed)
        gone = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r.ord, r.line_no) for r in gone.collect()) == sorted(near_lines(rows))


def test_common_keys_are_sent_to_all_tasks(spark, monkeypatch):
    """One line in every document, and many one substitution, insertion and half apart, with almost every key heavy."""
    monkeypatch.setattr(joins, "LEAST", 1)
    monkeypatch.setattr(joins, "HEAVY", 20)
    rows = [(d, f"the same line\nitem number {d} of this list\nof this list\nitem number of this list\n{TEXT} {d % 3}") for d in range(30)] + line_rows(4)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    gone = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.ord, r.line_no) for r in gone.collect()) == sorted(near_lines(rows))


def test_short_lines_that_go(spark):
    short = "Menu\nhome page\nall rights reserved here\n" + TEXT[:40]
    rows = [*line_rows(3), (900, short), (901, "menu\nHome  page\nall rights kept here\nother"), (902, "nine words are in this line of nine words"), (903, "nine words are in this long line of nine words")]
    gone = sorted((r.ord, r.line_no) for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert gone == sorted(near_lines(rows)) and {(901, 0), (901, 1), (901, 2), (903, 0)} <= set(gone) and (901, 3) not in gone


def test_line_dedup_keeps_everything_else(spark):
    docs = documents(spark)
    got = dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
        assert r.cls == "clash"
    assert by[4] == [None] and by[5] == [""] and by[6] == [" \t\n \n"] and by[1] == [TEXT]
    assert by[2] == [""] and by[3] == [""] and by[11] == [""] and by[None] == [""]
    assert by[7] == ["one two"] * 2 and by[12] == [""]
    assert dedup_lines(empty(spark)).count() == 0


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        m = len(t or "") // 3
        yield i, (t or "")[: len(t or "") - m] + after[:m], order[(k + 1) % len(order)][0]


def test_fingerprints(spark):
    rows = [(i, t) for i, t in corpus(7, 60)] + [(100, None), (101, ""), (102, "größe " * 50), (103, "größe " * 50)]
    got = {r.doc_id: r for r in simhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text, after in edited(rows):
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_chars == len(dict(rows)[i] or "")
        apart = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r.near_edited == apart(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == apart(r.fingerprint, got[after].fingerprint)
    assert got[102].fingerprint == got[103].fingerprint and got[100].fingerprint == got[101].fingerprint == "0" * 16
    assert simhash.document_fingerprints(documents(spark)).count() == len(EDGES)
    assert simhash.document_fingerprints(empty(spark)).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    terms = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    bits = [0] * 64
    for term in terms:
        h = xxhash.xxh64_intdigest((5).to_bytes(4, "little"), 42)
        for w in term:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(terms))


def test_fingerprints_are_those_of_a_plain_simhash(spark):
    rows = [(i, t) for i, t in corpus(8, 40)] + [(i + 100, t) for i, (_, t, *_) in enumerate(EDGES)]
    got = {r.doc_id: int(r.fingerprint, 16) for r in simhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in rows} and len(set(got.values())) > 30


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(150):
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.query, r.fp) for r in simhash.within_radius(df, df.limit(80)).collect()}
    some = [r.fp for r in df.limit(80).collect()]
    want = {(q, f) for q in some for f in signed if bin((q ^ f) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def test_op8_counts_near_documents(spark, sf_dir):
    rows = simhash.op8_simhash(spark, sf_dir).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    assert [r.near_docs for r in rows] == [sum((a ^ b).bit_count() <= simhash.RADIUS for b in fps) - 1 for a in fps]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and any(r.near_docs for r in rows)
