"""Each part of the method is needed: characters are linked by their vectors, with the table of glyphs as a prior only."""

import random

import numpy as np

from lexmill.llm import scan


def corpus(seed=1):
    """Sentences of a small language, with 末 misread for 未 and 崖 for 屋 in 1 of 60 places."""
    rng = random.Random(seed)
    words = ["未依約給付", "未經同意", "尚未返還", "房屋所有權", "系爭房屋", "承租房屋之人", "租賃契約", "押金返還", "出租人同意", "承租人給付", "未能修繕", "房屋修繕費", "房屋租金", "未付租金", "從未使用", "本屋所在", "該屋點交"]
    texts = []
    for _ in range(1500):
        t = "".join(rng.choice(words) + rng.choice("，。之於") for _ in range(12))
        texts.append("".join({"未": "末", "屋": "崖"}[c] if c in "未屋" and rng.random() < 1 / 60 else c for c in t))
    return texts


def model(texts):
    counts = {}
    for t in texts:
        for k, v in scan.contexts(t).items():
            counts[k] = counts.get(k, 0) + v
    return scan.Model({k: v for k, v in counts.items() if v > 1})


def found(texts, made):
    return sum(len(made.corrections(t)) for t in texts)


def test_vectors_find_pairs_without_the_table(monkeypatch):
    texts = corpus()
    wrong = sum(t.count("末") + t.count("崖") for t in texts)
    with_table = found(texts, model(texts))
    monkeypatch.setattr(scan, "GLYPHS", [])
    made = model(texts)
    assert set(made.links) == {"末", "崖"} and "未" in made.links["末"] and "屋" in made.links["崖"]
    assert found(texts, made) >= 0.9 * wrong and with_table >= 0.9 * wrong


def test_nothing_is_linked_without_vectors(monkeypatch):
    texts = corpus()
    monkeypatch.setattr(scan.Model, "_place_vector", lambda self, contexts: None)
    monkeypatch.setattr(scan.Model, "_fits", lambda self, *a: False)
    assert found(texts, model(texts)) == 0


def test_sound_text_stays(monkeypatch):
    clean = [t.replace("末", "未").replace("崖", "屋") for t in corpus(2)]
    assert found(clean, model(clean)) == 0


def test_few_characters_give_no_vectors():
    made = scan.Model({"甲乙丙": 3})
    assert made.links == {} and not len(made.char_vectors) and made.corrections("甲乙丙") == []
    assert np.asarray(made.char_vectors).size == 0
