"""Small tables with the rows that are easily got wrong."""

from __future__ import annotations

import random


def documents(seed=5, n=80):
    """(doc_id, text, lang, source): copies, near copies, shared passages, long, short, empty and null texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda k: r.choice([" ", "\n", "  "]).join(r.choice(vocabulary) for _ in range(k))
    passage, rows = prose(40), []
    for i in range(n):
        kind, text = i % 8, prose(r.randint(20, 160))
        if kind == 1 and rows:
            text = r.choice(rows)[1]
        elif kind == 2 and rows:
            w = (r.choice(rows)[1] or "").split(" ")
            w[len(w) // 2 : len(w) // 2] = [r.choice(vocabulary)]
            text = " ".join(w)
        elif kind == 3:
            text = f"{prose(20)} {passage} {prose(15)}"
        elif kind == 4:
            text = r.choice([None, "", " ", "one", "a b c d", prose(13), "x" * 60, "ab " * 200])
        rows.append((i * 3 % n if n % 3 else i, text, r.choice(["en", None]), r.choice(["s1", "s2", None])))
    rows.append((n, prose(9000), "en", "s1"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
