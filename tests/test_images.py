"""Images, transforms, OCR words and models that a caller brings."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sablefold.errors import ScanError
from sablefold.functions import geometry as g
from sablefold.operators import model_rules
from sablefold.operators.line_rules import RULES, line_findings
from sablefold.operators.redact import effective_style, hex_colour, initials, mask_images
from sablefold.plans.policy import Policy, RuleRef
from sablefold.plans.scan import Models, scan_images
from sablefold.schema import BBOX
from sablefold.sources import images, ocr
from sablefold.sources.text import text_lines


def picture(h=40, w=60):
    return np.random.default_rng(1).integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_png_round_trip(spark, tmp_path):
    p = picture()
    data = images.encode_png(p)
    assert (images.decode_png(data) == p).all()
    (tmp_path / "a.png").write_bytes(data)
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (row.height, row.width) == (40, 60)
    assert (np.frombuffer(bytes(row.data), np.uint8).reshape(40, 60, 3)[:, :, ::-1] == p).all()


@pytest.mark.parametrize("style", ["block", "pixelate"])
def test_no_pixel_leaks(spark, style):
    df = spark.createDataFrame([(1, bytearray(images.encode_png(picture()))), (2, bytearray(b"broken"))], "doc_id long, content binary")
    boxes = spark.createDataFrame([(1, {"x": 5, "y": 6, "w": 20, "h": 10}), (1, {"x": 55, "y": 35, "w": 50, "h": 50})], f"doc_id long, bbox {'struct<x:int,y:int,w:int,h:int>'}")
    rows = {r.doc_id: r for r in mask_images(df, boxes, style, padding=1).collect()}
    out = images.decode_png(bytes(rows[1].content))
    for area in (out[5:17, 4:26], out[34:, 54:]):
        assert len(np.unique(area.reshape(-1, 3), axis=0)) == 1
    assert (out[20:30] == picture()[20:30]).all()
    assert rows[2].content is None and rows[2].error.startswith("E_REDACTION")


def test_styles():
    assert effective_style("blur") == ("block", True) and effective_style("label") == ("label", False)
    with pytest.raises(ScanError, match="E_REDACTION"):
        effective_style("none")


def test_ingest(spark):
    png = images.encode_png(picture(2, 2))
    rows = [(1, png, "image/png"), (2, png, "image/jpeg"), (3, b"BM", "image/bmp"), (4, png, "text/html"), (5, b"x" * 200, "image/png"), (6, b"\xff\xd8\xff\xe0aaaa", "image/JPG")]
    df = spark.createDataFrame([(i, bytearray(c), m) for i, c, m in rows], "doc_id long, content binary, mime_type string")
    got = {r.doc_id: (r.error, r.output_format) for r in images.ingest(df, max_bytes=150).collect()}
    assert got == {1: (None, "PNG"), 2: ("E_INPUT_FORMAT", None), 3: ("E_INPUT_FORMAT", None), 4: ("E_INPUT_FORMAT", None), 5: ("E_INPUT_TOO_LARGE", None), 6: (None, "JPEG")}


def test_transform_there_and_back(spark):
    df = spark.range(200).select(g.box(F.col("id") * 3, F.col("id") * 2, F.col("id") % 50 + 1, F.col("id") % 20 + 1).alias("b"), images.page_transform(F.lit(640), F.lit(480)).alias("t"))
    rows = df.select("b", g.project(g.inverse(F.col("t")), g.project(F.col("t"), F.col("b"))).alias("back"), "t").collect()
    assert abs(rows[0].t.a - 1500 / 640) < 1e-9
    assert all(abs(r.b[i] - r.back[i]) <= 1 for r in rows for i in range(4))


def test_words_to_lines(spark):
    words = [
        (1, 0, 1, 1, 2, 1, "second", 10, 50, 60, 20, "91"), (1, 0, 1, 1, 1, 2, "a@b.org", 80, 10, 70, 20, "40"), (1, 0, 1, 1, 1, 1, "mail", 10, 12, 40, 18, "97.5"),
        (1, 0, 1, 1, 1, 1, "twin", 12, 12, 40, 18, "97.5"), (1, 0, 1, 1, 1, 3, " ", 0, 0, 1, 1, "-1"), (1, 0, 2, 1, 1, 1, "x", 0, 90, 5, 5, "bad"),
    ]
    rows = ocr.compose(spark.createDataFrame(words, ocr.WORDS)).orderBy("reading_order").collect()
    assert [r.line_text for r in rows] == ["mail a@b.org", "second", "x"]
    assert tuple(rows[0].bbox) == (10, 10, 140, 20) and [t.confidence for t in rows[2].tokens] == [0.0]
    found = line_findings(ocr.compose(spark.createDataFrame(words, ocr.WORDS)), [RULES["CO-001"]]).first()
    assert tuple(found.bbox) == (80, 10, 70, 20) and found.conf_rank == 0


def engine():
    class Engine:
        def engine_id(self):
            return "fake"

        def recognise(self, image):
            if image == b"bad":
                raise ValueError("unreadable")
            return pd.DataFrame([{"page_index": 0, "block_num": 1, "par_num": 1, "line_num": 1, "word_num": 1, "text": image.decode(), "x": 1, "y": 1, "w": 5, "h": 5, "conf": "90"}])

    return Engine


def test_engine_failures_are_rows(spark):
    words = ocr.recognise(spark.createDataFrame([(1, bytearray(b"hi")), (2, bytearray(b"bad"))], "doc_id long, content binary"), engine())
    assert [(r.doc_id, r.code) for r in ocr.failures(words).collect()] == [(2, "E_OCR")]


def fake(spans):
    def make():
        def model(text):
            if "boom" in text:
                raise RuntimeError("boom")
            return [(text.find(s), text.find(s) + len(s), label, score) for s, label, score in spans if s in text]

        return model

    return make


def test_entities(spark):
    lines = text_lines(spark.createDataFrame([(1, "call Bob at noon"), (2, "boom")], "doc_id long, text string"))
    make = fake([("Bob", "Person", 0.9), ("noon", "person", 0.7), ("call", "person", 0.4), ("at", "unknown", 0.9)])
    found = model_rules.entity_findings(lines, "ML-001", make)
    rows = found.where(F.col("category") != model_rules.FAILED).collect()
    assert sorted((r.matched_text, r.category, r.conf_rank) for r in rows) == [("Bob", "IDENTITY", 2), ("noon", "IDENTITY", 1)]
    assert [(r.doc_id, r.fatal) for r in model_rules.failures(found, 1).collect()] == [(2, True)]
    assert [(r.doc_id, r.fatal) for r in model_rules.failures(found, 2).collect()] == [(2, False)]
    with pytest.raises(ScanError, match="E_POLICY"):
        model_rules.entity_findings(lines, "ML-001", make, least=2)


def test_names_and_their_handles(spark):
    docs = [(1, "by Nadeem Shaikh\nnadeem/redact nshaikh SHAIKH_nadeem\nnadeem.shaikh@x"), (2, "nadeem elsewhere")]
    lines = text_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = model_rules.person_names(lines, fake([("Nadeem Shaikh", "PERSON", 1.0)])).collect()
    assert {r.doc_id for r in rows} == {1}
    assert {(r.line_no, r.matched_text) for r in rows} == {(0, "Nadeem Shaikh"), (0, "Nadeem"), (0, "Shaikh"), (1, "nadeem"), (1, "nshaikh"), (2, "nadeem.shaikh")} or {"nadeem", "nshaikh", "nadeem.shaikh"} <= {r.matched_text for r in rows}
    assert [r.conf_rank for r in rows if r.matched_text == "Nadeem Shaikh"] == [2]


def test_faces(spark):
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b""))], "doc_id long, content binary")
    found = model_rules.faces(df, lambda: lambda data: [(1, 2, 3, 4)] if data else 1 / 0)
    rows = found.where(F.col("category") != model_rules.FAILED).collect()
    failed = model_rules.failures(found, 3, 1).collect()
    assert [(r.doc_id, r.fatal) for r in failed] == [(2, True)] and failed[0].message.startswith("ID-007: ZeroDivisionError")
    assert [(r.doc_id, tuple(r.bbox), r.conf_rank) for r in rows] == [(1, (1, 2, 3, 4), 1)]
    with pytest.raises(ScanError, match="E_POLICY"):
        model_rules.faces(df, lambda: None, scale_factor=1.0)


def test_clinical_labels(spark):
    lines = text_lines(spark.createDataFrame([(1, "call Bob at noon")], "doc_id long, text string"))
    rows = model_rules.entity_findings(lines, "ML-002", fake([("Bob", "First_Name", 0.9), ("noon", "time", 0.7), ("call", "first name", 0.9)])).collect()
    assert sorted((r.matched_text, r.category) for r in rows) == [("Bob", "IDENTITY"), ("noon", "IDENTITY")] and len(model_rules.CLINICAL_LABELS) == 38


def test_colours_and_captions(spark):
    assert hex_colour("#0a10Ff") == (10, 16, 255)
    with pytest.raises(ScanError, match="E_POLICY"):
        hex_colour("#12")
    assert spark.range(1).select(initials(F.lit("CREDENTIALS")).alias("c")).first().c == "[CRE]"


def reader():
    class Engine:
        def engine_id(self):
            return "fake"

        def recognise(self, image):
            h, w, _ = images.decode_png(image).shape
            if w == h:
                raise ValueError("unreadable")
            assert (w, h) == (1500, 1000)
            words = [("to", 100, 250, 100), ("a@b.org", 250, 250, 500)]
            return pd.DataFrame([{"page_index": 0, "block_num": 1, "par_num": 1, "line_num": 1, "word_num": i, "text": t, "x": x, "y": y, "w": w, "h": 250, "conf": "96"} for i, (t, x, y, w) in enumerate(words)])

    return Engine


def test_images_from_intake_to_masks(spark):
    png = lambda *shape: bytearray(images.encode_png(picture(*shape)))
    rows = [(1, png(), "image/png"), (2, png(50, 50), "image/png"), (3, png(), "image/gif"), (4, bytearray(b"\x89PNG\r\n\x1a\nbroken"), "image/png"), (5, None, "image/png")]
    df = spark.createDataFrame(rows, "doc_id long, content binary, mime_type string")
    face = lambda: lambda data: [(50, 30, 4, 4)]
    policy = Policy("p", detectors=(RuleRef("CO-001"), RuleRef("ID-007")))
    out = scan_images(df, reader(), policy, b"k", Models(faces=face))
    assert sorted((r.doc_id, r.rule_id, tuple(r.bbox)) for r in out.findings.collect()) == [(1, "CO-001", (10, 10, 20, 10)), (1, "ID-007", (50, 30, 4, 4))]
    got = {r.doc_id: r for r in out.masked.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].error is None and all(got[i].content is None for i in (2, 3, 4, 5))
    assert [got[i].error.split(":")[0] for i in (2, 3, 4)] == ["E_OCR", "E_INPUT_FORMAT", "E_INPUT_FORMAT"]
    want = picture()
    want[8:22, 8:32] = 0
    want[28:36, 48:56] = 0
    assert (images.decode_png(bytes(got[1].content)) == want).all()
    manifest = {r.doc_id: r for r in out.manifest.collect()}
    assert manifest[1].stats.redactions_total == 2 and manifest[1].ocr_engine == "fake" and manifest[2].output_hash is None


def test_captions(spark):
    page = np.full((200, 400, 3), 255, np.uint8)
    df = spark.createDataFrame([(1, bytearray(images.encode_png(page)))], "doc_id long, content binary")
    boxes = spark.createDataFrame([(1, {"x": 10, "y": 10, "w": 300, "h": 40}, "CREDENTIALS"), (1, {"x": 10, "y": 100, "w": 60, "h": 20}, "FINANCIAL"), (1, {"x": 380, "y": 180, "w": 60, "h": 60}, "LOCATION")], f"doc_id long, bbox {BBOX}, category string")
    got = images.decode_png(bytes(mask_images(df, boxes, "label").first().content))
    inside = [got[10:50, 10:310], got[100:120, 10:70]]
    assert all((a == 255).any() and (a == 0).any() for a in inside)
    columns = lambda a: np.flatnonzero((a == 255).any(axis=(0, 2)))
    # [CREDS] is seven characters of six columns, three pixels each; FINANCIAL has no room and becomes [FIN].
    assert 6 * 6 * 3 < np.ptp(columns(inside[0])) < 7 * 6 * 3 and np.ptp(columns(inside[1])) < 5 * 6
    assert (got[150:170] == 255).all()


def test_png_filters():
    """Rows of every filter type, against a plain undoing of them."""
    rng = np.random.default_rng(5)
    for channels, colour in ((1, 0), (3, 2), (4, 6)):
        h, w = 15, 9
        want = rng.integers(0, 256, (h, w * channels)).astype(int)
        rows = []
        for y in range(h):
            up = want[y - 1] if y else np.zeros(w * channels, int)
            left, corner = (np.concatenate([np.zeros(channels, int), r[:-channels]]) for r in (want[y], up))
            p = left + up - corner
            near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            add = [np.zeros_like(up), left, up, (left + up) // 2, near][y % 5]
            rows.append(bytes([y % 5]) + ((want[y] - add) % 256).astype(np.uint8).tobytes())
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
        pixels = want.reshape(h, w, channels)
        assert (images.decode_png(data) == (np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, :3])).all()
