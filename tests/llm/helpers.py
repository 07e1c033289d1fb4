"""Small document tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang) as a document table in several partitions."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
    frame = spark.createDataFrame(full, SCHEMA)
    return frame.repartition(3) if rows else frame


def awkward(seed=1, n=40):
    """Nulls, empty and blank texts, repeated rows, ties, copies, near copies and one long text."""
    rand = random.Random(seed)
    words = [f"{a}{b}" for a in "the ou re and ing stone water light".split() for b in "abcdefgh"]
    rows = [(i, " ".join(rand.choice(words) for _ in range(rand.randint(1, 60)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, rows[0][1]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (5, "another text for id five")]
    rows += [(110 + i, rows[2][1]) for i in range(4)] + [(120 + i, rows[4][1] + f" tail{i}") for i in range(3)]
    rows += [(130, " ".join(rand.choice(words) for _ in range(6000))), (131, "x" * 20000), (132, "Ünïcode ñandú 漢字 😀 \x00 end")]
    return rows


def clashing(frame):
    """The table with extra columns that are named like the operators' own."""
    for name in ("fp", "key", "id", "doc", "kept", "body", "votes", "h1", "pos", "posterior", "text_key", "own", "label", "s"):
        frame = frame.selectExpr("*", f"1 as `{name}`")
    return frame
