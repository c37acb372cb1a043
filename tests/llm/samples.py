"""Small documents with the awkward cases: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""

import random

CLASHING = "a string, n string, row string, size string, shard string, slot string, _d string, _th string, lo string, starts string, leaks string, score string, predicted string, node string, k string, tie string, host string, bin string, fill string"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(["ka", "lo", "mi", "tu", "re", "sha"]) for _ in range(rnd.randrange(2, 5))) for _ in range(n))


def documents(spark, rows, clash=True):
    """rows: (doc_id, text)."""
    base = "doc_id long, text string, lang string, source string, n_chars long"
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    if not clash:
        return spark.createDataFrame(out, base)
    names = len(CLASHING.split(","))
    return spark.createDataFrame([(*r, *["x"] * names) for r in out], f"{base}, {CLASHING}")


def messy(seed=1):
    rnd = random.Random(seed)
    base = sentence(rnd, 120).split()
    near = list(base)
    near[60] = "changed"
    passage = sentence(rnd, 50)
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one"), (9, "two words"),
        (10, f"{sentence(rnd, 40)} {passage} {sentence(rnd, 30)}"), (11, f"{sentence(rnd, 20)}\n{passage}\n{sentence(rnd, 60)}"), (12, sentence(rnd, 3000)),
        (13, "tick " * 200), (14, "Ünïcode\u00a0naïve \u2028 日本語 \U0001f600 words"), (None, sentence(rnd, 40)), (None, None), (15, sentence(rnd, 35)), (15, sentence(rnd, 36)),
    ]
    return [*rows, rows[0], rows[9], rows[9]]
