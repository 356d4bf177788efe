import itertools
import random
from collections import Counter

import pytest

from lexmill.llm import together


@pytest.mark.parametrize("share,most,block,least", [(0.05, 1500, 256, 1), (0.05, 3, 2, 1), (2.0, 10, 3, 1), (0.0, 1500, 256, 1), (0.0, 7, 256, 1), (0.05, 3, 2, 4)])
def test_counts_equal_brute_force(spark, share, most, block, least):
    rng = random.Random(7)
    rows = [(f, b, f"i{min(int(rng.expovariate(0.15)), 60):02d}") for f in "xy" for b in range(150) for _ in range(rng.randrange(6))]
    rows += rows[:50] + [("x", None, "i01"), ("x", 1, None), ("x", 1, ""), ("y", 999, "i00")]
    baskets = {}
    for f, b, i in rows:
        if b is not None and i:
            baskets.setdefault((f, b), set()).add(i)
    want, single = Counter(), Counter()
    for (f, _), items in baskets.items():
        want.update((f, *p) for p in itertools.combinations(sorted(items), 2))
        single.update((f, i) for i in items)
    n = Counter(f for f, _ in baskets)
    got = together.pair_counts(spark.createDataFrame(rows, "field string, basket bigint, item string"), least, share, most, block).collect()
    got = [r for r in got if r["n_ab"] >= least]
    want = Counter({k: c for k, c in want.items() if c >= least})
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == {(f, a, b): (c, single[f, a], single[f, b], n[f]) for (f, a, b), c in want.items()}
    assert len(got) == len(want)


def test_large_basket_in_blocks(spark):
    rows = [("f", b, f"i{i:03d}") for b in (1, 2) for i in range(300)] + [("f", 3 + b, "h") for b in range(50)] + [("f", 1, "h")]
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in together.pair_counts(spark.createDataFrame(rows, "field string, basket bigint, item string"), 1, 0.5, basket_items=40).collect()}
    assert len(got) == 300 * 299 // 2 + 300 and all(n == (1 if "h" in p else 2) for p, n in got.items())


def test_empty(spark):
    assert together.pair_counts(spark.createDataFrame([], "field string, basket bigint, item string")).collect() == []
