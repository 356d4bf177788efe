import random
import re

from pyspark.sql import functions as F

from lexmill.functions import text as t

WIDE = re.compile("[㐀-鿿豈-﫿　-〿＀-￯]")
MARKS = {",": "，", ";": "；", ":": "："}


def by_hand(text):
    out, code = [], False
    for line in text.split("\n"):
        if line.lstrip(" ").startswith("```"):
            code = not code
        elif not code:
            parts = re.findall(r"`[^`]*`|\$[^$]*\$|[^`$]+|[`$]", line)
            for i, part in enumerate(parts):
                if not re.fullmatch(r"`.*`|\$.*\$", part):
                    part = part.replace("**", "")
                    near = lambda j, p=part: 0 <= j < len(p) and WIDE.match(p[j])
                    parts[i] = "".join(MARKS[c] if c in MARKS and (near(k - 1) or near(k + 1)) else c for k, c in enumerate(part))
            line = "".join(parts)
        out.append(line)
    return "\n".join(out)


def test_style_equals_a_walk_over_the_characters(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["租", "約", ",", ";", ":", "a", " ", "**", "`", "$", "\n", "```\n", "。"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in [*texts, "租,;a `x,租` $租,$ **b**,約", "```\n租,約\n```\n租,約", "", None]], "x string")
    for r in rows.select("x", t.styled(F.col("x")).alias("y")).collect():
        assert r["y"] == (None if r["x"] is None else by_hand(r["x"])), r["x"]
