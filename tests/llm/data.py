"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SEED = 11
WORDS = "the of and stone river light ing tion über señor 漢字 12 x -- a! b? C,D".split()

#: Columns of other tables and of the operators' own results.
CLASHING = "doc_id long, text string, n_tokens string, score string, shard string, id string, h string, component_id string, ids string, mark string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents() -> list[tuple]:
    base = words(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    far = base.split(" ")
    far[10:110:9] = ["other"] * len(far[10:110:9])
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: " ".join(far), 5: None, 6: "", 7: "  \n\t ", 8: "one", 9: "ONE", 10: "one two three four", 11: "one two three four five", 12: "one two three four five six",
        13: words(30_000, 2), 14: "x" * 50_000, 15: "日本語" * 5000, 16: "\n" * 3000 + "a", 17: "<|endoftext|> a<|endoftext|>b", 18: base.upper(), 19: "It's we're 'sabc ''' !!'s  12ab\u00a0\u2003z\u0085", 20: "é" * 9000 + " fin",
    }
    rows = [(i, t) for i, t in texts.items()]
    return rows + [(1, base), (None, base), (None, None), (12, texts[12])]


def frame(spark, rows: list[tuple], schema: str = "doc_id long, text string"):
    """The rows with clashing extra columns, all null."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    for c in ("n_tokens", "score", "shard", "id", "h", "component_id", "mark", "n", "key", "label"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df
