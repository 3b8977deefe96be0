import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.llm import pieces


def check(text, limit, overlap):
    out = pieces.cut_text(text, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(end - start <= limit for start, end, _, _ in out)
    for (_, end, _, _), (start, _, back, _) in zip(out, out[1:]):
        assert start <= end and back == end - start and back in (0, overlap)
    forced = max(map(len, re.split(r"[ \t\r\n]+", text))) > limit
    assert any(f for *_, f in out) == forced
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "word.", "x" * 19, "y" * 20, "z" * 45, " ", "\n", "\n\n", ", ", "\t"]), max_size=40), st.sampled_from([(20, 3), (20, 0), (11, 4)]))
def test_any_text(parts, settings_):
    check("".join(parts), *settings_)


def test_prefers_strong_boundaries():
    text = "First sentence here. Second one,\n\nNew part begins now and goes on and on."
    cuts = [text[a:b] for a, b, _, _ in check(text, 40, 0)]
    assert cuts[0].endswith("one,\n\n")


def test_range_maximum_like_brute_force():
    rng = np.random.default_rng(1)
    strength = rng.integers(0, 4, 300).astype(np.int8)
    table = pieces.StrongestCut(strength, 64)
    for _ in range(300):
        low = int(rng.integers(0, 290))
        high = min(299, low + int(rng.integers(0, 63)))
        best = max(strength[low : high + 1])
        right = max(i for i in range(low, high + 1) if strength[i] == best)
        assert table.query(low, high) == (best, right)


def test_long_text_in_spans(monkeypatch):
    monkeypatch.setattr(pieces, "SPAN", 64)
    check("some words here. " * 200, 50, 10)


def test_bad_overlap():
    with pytest.raises(ValueError):
        pieces.cut_text("x", 10, 5)


def test_tables(spark):
    big, solid = "word " * 1000, "x" * 4500
    rows = [("a", "short", 1), ("b", big, 2), ("b", big, 2), ("c", solid, 3), ("d", None, 4), ("e", "", 5), ("f", " ", 6), (None, big, 7)]
    df = spark.createDataFrame(rows, "k string, t string, piece_no int")
    out = pieces.split_oversized(df, "k", "t").collect()
    assert sum(r.item_id == "a" for r in out) == 1 and not any(r.item_id == "d" for r in out)
    assert {r.item_id for r in out if r.n_chars == 0} == {"e"}
    found = {r.item_id: r.cut for r in pieces.oversized_items(df, "k", "t", "x").collect()}
    assert found == {"b": "boundary", "c": "forced", None: "boundary"}
    assert pieces.split_oversized(df.limit(0), "k", "t").count() == 0


def test_forced_cuts_at_marks_and_between_signs():
    text = "漢字が続く。" * 20
    assert all(text[:end].endswith("。") and forced for _, end, _, forced in check(text, 30, 0)[:-1])
    # a letter and its accents, and a sequence of joined signs, stay together
    accents = "e\u0301\u0302" * 40
    assert all(end % 3 == 0 for _, end, _, _ in check(accents, 20, 0))
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467" * 12
    assert all(end % 5 == 0 for _, end, _, _ in check(family, 17, 0))
    check("\u0301" * 100, 20, 3)
