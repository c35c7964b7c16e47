"""Merging: both paths, against each other and against properties of the result."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sablefold.operators.common import shaped
from sablefold.operators.merge import fold, merge, merge_boxes, merge_rows
from sablefold.schema import FINDINGS

box = st.fixed_dictionaries({"x": st.integers(0, 400), "y": st.integers(0, 400), "w": st.integers(10, 80), "h": st.integers(10, 40), "conf_rank": st.integers(0, 2), "rule_id": st.sampled_from(["ID-001", "CO-001", "FI-001"]), "matched_text": st.sampled_from(["", "a", "b"]), "char_start": st.just(0), "char_end": st.just(1), "merged_from": st.just([])})


@settings(max_examples=150, deadline=None)
@given(st.lists(box, max_size=20), st.randoms())
def test_fold_is_idempotent_and_ignores_order(boxes, rng):
    once = fold([dict(b) for b in boxes])
    assert fold([dict(b) for b in once]) == once
    mixed = [dict(b) for b in boxes]
    rng.shuffle(mixed)
    assert fold(mixed) == once


def rows(seed, docs=30, flat=True):
    rng = random.Random(seed)
    for d in range(docs):
        for i in range(rng.randint(1, 12)):
            y = 10 + 30 * rng.randint(0, 3) if flat else rng.randint(0, 60)
            yield (d, 0, "b", i, rng.choice(["CO-001", "CO-002", "CO-003", "CU-001"]), "CONTACT", {"x": rng.randint(0, 200), "y": y, "w": rng.randint(5, 40), "h": 24}, rng.randint(0, 2), f"t{i}", i, i + 1, [])


def plain(df):
    return sorted((r.doc_id, r.rule_id, tuple(r.bbox), r.conf_rank, r.matched_text, tuple(r.merged_from)) for r in df.collect())


def test_rows_of_text_take_the_window_path_and_agree_with_the_fold(spark):
    f = shaped(spark.createDataFrame(list(rows(1)), FINDINGS))
    assert plain(merge_rows(f)) == plain(merge_boxes(f))


def test_any_boxes(spark):
    f = shaped(spark.createDataFrame([*rows(2), *((d + 100, *r) for d, *r in rows(3, flat=False))], FINDINGS))
    assert plain(merge(f)) == plain(merge_boxes(f))


def test_categories_and_pages_stay_apart(spark):
    b = {"x": 0, "y": 0, "w": 10, "h": 10}
    data = [(1, 0, "b", 0, "CO-001", "CONTACT", b, 1, "a", 0, 1, []), (1, 0, "b", 0, "FI-001", "FINANCIAL", b, 1, "a", 0, 1, []), (1, 1, "b", 0, "CO-001", "CONTACT", b, 1, "a", 0, 1, []), (1, 1, "b", 0, "CO-002", "CONTACT", b, 2, "z", 0, 1, [])]
    out = {(r.page_index, r.category): r for r in merge(spark.createDataFrame(data, FINDINGS)).collect()}
    assert len(out) == 3
    assert (out[1, "CONTACT"].rule_id, out[1, "CONTACT"].merged_from, out[1, "CONTACT"].matched_text) == ("CO-002", ["CO-001"], "z")


def test_rules_that_joined_last_come_first(spark):
    f = lambda x, rule, rank: (1, 0, "b", 0, rule, "CONTACT", {"x": x, "y": 0, "w": 10, "h": 10}, rank, "t", x, x + 1, [])
    for ranks, want in (((2, 1, 1), ("CO-001", ["CO-003", "CO-002"])), ((0, 1, 2), ("CO-003", ["CO-002", "CO-001"])), ((1, 2, 1), ("CO-002", ["CO-003", "CO-001"]))):
        df = spark.createDataFrame([f(12 * i, f"CO-00{i + 1}", r) for i, r in enumerate(ranks)], FINDINGS)
        for way in (merge, merge_boxes):
            r = way(df).first()
            assert (r.rule_id, r.merged_from) == want
