"""Licence scan, the pipeline's stages one by one, and the subpackage's place in the library."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from helpers import EDGES, TEXT, documents, near_lines

import corpus_pipeline as cp
from sablefold.llm import licences
from sablefold.llm.jaccard import jaccard_groups
from sablefold.llm.mixing import mix_sources
from sablefold.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]


def test_licence_oracle(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{big}/documents.parquet'")
    got = QUERIES["op4_license_scan"](spark, big).collect()
    assert got and sorted(map(tuple, got)) == sorted(duckdb.sql(f"SELECT doc_id, license_id, scope, hits FROM ({ORACLES['op4_license_scan']})").fetchall())


def test_licence_spellings(spark):
    mit = dict(licences.KNOWN)["MIT"]
    long = next(t for i, t in licences.KNOWN if i == "MIT")
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + long.upper()),
        (2, "// " + long.replace(". ", ".\n// ")),
        (3, "Intro text\n\nreleased   under the MIT Licence\n\nmore"),
        (4, "Released under the MIT License, mostly."),
        (5, None),
        (6, ""),
        (7, long + " But not for you."),
    ]
    got = {(r.doc_id, r.license_id, r.scope, r.hits) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", "text", 1), (2, "MIT", "text", 1), (3, "MIT", "paragraph", 1)}
    assert mit and licences.scan(documents(spark)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows before and after every stage over the small documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert len(cp.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage(spark, sf_dir, stages):
    """Good documents stay and bad ones go, as far as some three hundred labels teach; what stays is unchanged."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.keep_good(spark, spark.read.parquet(f"{big}/documents.parquet"), big).collect()}
    share = lambda y: sum(i in kept for i, q in labels.items() if q == y) / sum(q == y for q in labels.values())
    assert share(1) >= 0.97 and share(0) <= 0.1
    assert {(r.doc_id, r.text) for r in stages[1].collect()} <= {(r.doc_id, r.text) for r in stages[0].collect()}


def test_line_stage(stages):
    before = sorted((r.doc_id, r.text) for r in stages[1].collect())
    gone = set(near_lines(before))
    want = [(i, "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in before]
    assert sorted((r.doc_id, r.text) for r in stages[2].collect()) == want


def test_one_of_each_group_stays(stages):
    groups = {r.doc_id: r.component_id for r in jaccard_groups(stages[2]).collect()}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({c for c in groups.values()})


def test_mix_stage(stages):
    import re

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    plan = {r.doc_id: r.taken for r in mix_sources(stages[3]).collect()}
    words = {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + count(r.text)
    assert words == {i: n for i, n in plan.items() if n}


def test_packed(stages):
    rows = stages[5].collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_run_is_the_stages(spark, sf_dir, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, cp.run(spark, sf_dir).collect())) == sorted(map(key, stages[-1].collect()))


def test_stages_take_any_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    for name, stage in cp.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, str(tmp_path))
            rows = out.collect()
            assert name == "best-fit packing" or out.columns == docs.columns
            assert len(rows) <= 3 * len(EDGES) or name == "best-fit packing"
    kept = [r.text for r in cp.one_of_each(spark, docs, str(tmp_path)).collect()]
    assert kept.count(TEXT) + kept.count(TEXT.upper()) == 1 and kept.count("one two") == 1


def test_the_library_does_without(tmp_path):
    """Without the subpackage the entry module imports and has the other queries."""
    import shutil

    shutil.copytree(ROOT / "sablefold", tmp_path / "sablefold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_wrapped_licences(spark):
    long = next(t for i, t in licences.KNOWN if i == "MIT")
    rows = [
        (1, "This is free and unencumbered software released into the public\ndomain.", "Unlicense"),
        (2, "// This is free and unencumbered software released into the public\n//  domain.", "Unlicense"),
        (3, "This work is dedicated to the public-domain under CC0 1.0.", "CC0-1.0"),
        (4, "Licensed under the Apache License, Version\n2.0.", "Apache-2.0"),
        (5, "Copyright 2020 Someone\n(c) 2021 Other\n\n" + long.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace(" copyright notice", "\ncopyright notice"), "MIT"),
        (6, "Copyright Jane Doe\n" + long, "MIT"),
    ]
    got = {(r.doc_id, r.license_id) for r in licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {(r[0], r[2]) for r in rows}


def test_more_licences(spark):
    bsd = "\n\n".join([licences._BSD, "1. " + licences._BSD_1, "2. " + licences._BSD_2, licences._BSD_WARRANTY])
    three = bsd.replace("\n\nTHIS", "\n\n3. " + licences._BSD_3.replace("copyright holder", "\n   copyright holder") + "\n\nTHIS")
    gnu = "\n\n".join(licences._gnu("General Public License", "3", True))
    grant = next(t for i, t in licences.KNOWN if i == "MIT").split(" The above")[0]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + bsd, ("BSD-2-Clause", "text")),
        (2, "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\n\n" + three, ("BSD-3-Clause", "text")),
        (3, gnu, ("GPL-3.0", "text")),
        (4, "A program.\n\n" + gnu.replace("GNU General", "GNU Affero General"), ("AGPL-3.0", "paragraph")),
        (5, "\n\n".join(licences._UNLICENSE) + " <https://unlicense.org/>", ("Unlicense", "text")),
        (6, "About us\n\n" + grant + "\n\nThe end", ("MIT", "paragraph")),
    ]
    got = {(r.doc_id, r.license_id): r.scope for r in licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    shared = {(1, "BSD"): "paragraph", (2, "BSD"): "paragraph"}
    assert got == {(i, want): scope for i, _, (want, scope) in rows} | shared


def test_known_texts_of_a_caller(spark):
    """A text without any of the usual words is found when a caller asks for it; null, empty and other texts aren't."""
    rows = [(1, "Do what you want with this code!"), (2, "intro\n\nDO WHAT YOU WANT\nwith this code\n\nend"), (3, None), (4, ""), (5, "do what you want")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("WTFPL", "Do what you want with this code.")]).collect()
    assert sorted((r.doc_id, r.license_id, r.scope) for r in got) == [(1, "WTFPL", "text"), (2, "WTFPL", "paragraph")]
