import random

import pytest

from lexmill.llm import tokenize as t

PATH = f"{t.VOCABULARY_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(t, "RUN_CHARS", 5)
    monkeypatch.setattr(t, "_LONG_RUN", t.re.compile(f"[{t._SPACE}]{{5,}}"))


def test_pieces_give_the_same_ids(short):
    enc, rng = t.encoding(PATH), random.Random(1)
    alphabet = "ab 1租。,'\n\t　  ​\x1f\x85😀é"
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) * rng.choice([1, 1, 2, 30]) for _ in range(rng.randrange(60)))
        ids = []
        for piece, single in t.safe_pieces(text, 17):
            ids += enc._core_bpe.encode_single_piece(piece.encode()) if single else enc.encode_ordinary(piece)
        assert ids == enc.encode_ordinary(text)
        assert t.decode_ids(ids, enc) == text


@pytest.mark.parametrize("text", [" " * 300_000 + "a", "a" * 300_000, "\n 　" * 100_000, "。" * 300_000, "租約" * 100_000, "1" * 200_000])
def test_very_long_texts(text):
    enc = t.encoding(PATH)
    assert t.decode_ids(t.encode_text(text, enc), enc) == text


def test_table(spark):
    rows = [(1, "租約 lease"), (2, None), (3, ""), (3, ""), (None, "a")]
    got = t.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS k")).collect()
    enc = t.encoding(PATH)
    assert sorted(map(tuple, got), key=str) == sorted(((k, enc.encode_ordinary(x or "")) for k, x in rows), key=str)
    assert t.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
