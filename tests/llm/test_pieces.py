import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import pieces as p


def check(text, limit, overlap):
    spans = p.pieces(text, limit, overlap)
    if len(text) <= limit:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == max(0, b - overlap) and d > b
    assert all(0 < b - a <= limit for a, b in spans)
    assert text[spans[0][0] : spans[0][1]] + "".join(text[b0:b1] for (_, b0), (_, b1) in zip(spans, spans[1:])) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab租。；.!\n 　😀", max_size=300), st.integers(2, 40), st.integers(0, 12))
def test_round_trip(text, limit, overlap):
    check(text, limit, min(overlap, limit - 1))


def test_cuts_at_sentences():
    text = "".join("租" * 99 + "。" for _ in range(30))
    for a, b in p.pieces(text):
        assert text[b - 1] == "。" and b - a <= 800


def test_stretch():
    assert p.longest_stretch("a" * 801 + "。") == 801 and p.longest_stretch("a" * 800 + "。" + "b" * 5) == 800
    assert p.longest_stretch("1.5" * 300) == 900 and p.longest_stretch("a. b.") == 2 + 0 and p.longest_stretch("a\nb") == 1


def test_long_text_is_linear():
    check("租" * 500_000, 800, 80)
    check("租約 " * 200_000, 800, 80)


def test_query(spark):
    rng = random.Random(3)
    rows = [("a", "租" * 801), ("b", "租" * 800), ("c", None), ("d", ""), ("e", "租約。" * 400), ("e", "租約。" * 400), (None, "x. " * 400), ("f", "".join(rng.choice("租 \n") for _ in range(5000)))]
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "chunk_id string, content string, k string")
    assert {tuple(r) for r in p.oversized(frame).collect()} == {("a", "hard"), ("e", "boundary"), (None, "boundary"), ("f", "boundary")}
    got = [r for r in p.cut_pieces(frame.limit(1)).collect()]
    assert [(r["start"], r["end"], r["n_pieces"]) for r in got] == [(0, 800, 2), (720, 801, 2)]
    assert p.oversized(frame.limit(0)).collect() == []
