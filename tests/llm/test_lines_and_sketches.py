import hashlib
import re

import pytest
import xxhash
from llm.helpers import awkward, clashing, table
from pyspark.sql import functions as F

from pairloom.llm.line_dedup import dedup_lines, line_dedup_report, one_edit, removed_lines
from pairloom.llm.sketches import containment, document_fingerprints, likeness, merge, printed, sketch

SPACES = " \t\n\x0b\x0c\r"


def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_dedup(rows):
    """Every pair of lines is compared."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    lines = [(k, p, line) for k, (_, _, t) in enumerate(docs) for p, line in enumerate(t.split("\n")) if line.strip(SPACES)]
    first = {}
    for k, p, line in lines:
        first.setdefault(line, (k, p))
    near = {
        line for line, at in first.items()
        if len(line.split(" ")) >= 8 and any(o < at and len(x.split(" ")) >= 8 and one_word_apart(line.split(" "), x.split(" ")) for x, o in first.items())
    }
    out = {}
    for k, doc in enumerate(docs):
        out[doc] = "\n".join(x for p, x in enumerate(doc[2].split("\n")) if not x.strip(SPACES) or (x not in near and first[x] == (k, p)))
    return out


def line_rows():
    base = "one two three four five six seven eight nine ten"
    words = base.split()
    rows = [(10, base + "\nshort\n\n" + base), (11, "short\nx y z\nx y w"), (12, " ".join(words[:4] + ["new"] + words[4:])), (13, " ".join(words[:-1])),
            (14, " ".join(words[:3] + ["swap"] + words[4:])), (15, " ".join(words[:3] + ["swap"] + words[4:9] + ["other"])), (9, "a later id comes\nafter this"),
            (16, None), (17, ""), (18, "\n \n\t"), (None, "short\nonly here"), (19, "same " * 40), (20, ("same " * 39) + "x"), (21, "same " * 39), (22, "eight words are in this line here now"),
            (23, "eight words are in that line here now"), (24, "seven words are in this line here"), (25, "seven words are in that line here")]
    for n in (16, 17, 32, 33, 64, 65):  # around the sizes where the compared ends change
        line = [f"w{n}x{i}" for i in range(n)]
        rows += [(100 + n, " ".join(line)), (300 + n, " ".join(line[:-1])), (500 + n, " ".join(line[:2] + line[3:])), (700 + n, " ".join(line + ["more"]))]
    return rows


def test_dedup_matches_comparing_all_pairs(spark):
    rows = line_rows()
    want = plain_dedup(rows)
    got = dedup_lines(clashing(table(spark, rows)))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(got.columns) == 19
    for r in got.collect():
        before = dict(rows)[r.doc_id]
        assert r.text == (None if before is None else want[(r.doc_id is None, r.doc_id or 0, before)])
        assert r.n_chars == (None if before is None else len(r.text))


def test_lines_that_occur_often_give_the_same_rows(spark):
    rows = line_rows() + [(1000 + i, f"a line that all share\nown {i}\nshort") for i in range(30)]
    docs = table(spark, rows)
    here = [{(r.no_id, r.id, r.key): sorted(r.gone) for r in removed_lines(docs, hot).collect()} for hot in (2, 20, 10_000)]
    assert here[0] == here[1] == here[2] and sum(len(g) for g in here[0].values()) >= 59


def test_dedup_of_awkward_tables(spark):
    rows = awkward()
    assert dedup_lines(table(spark, rows)).count() == len(rows) and dedup_lines(table(spark, [])).count() == 0
    twice = dedup_lines(table(spark, [(1, "a b\nc"), (1, "a b\nc"), (2, "c")])).orderBy("doc_id").collect()
    assert [r.text for r in twice] == ["a b\nc", "a b\nc", ""]


def test_report(spark):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup_report(table(spark, [(1, "p\nq"), (2, "q\nr"), (3, "p\nq"), (4, None)])).collect()}
    assert got == {1: ("p\nq", 2, 0), 2: ("r", 2, 1), 3: ("", 2, 2), 4: (None, 0, 0)}


@pytest.mark.parametrize("a,b", [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "b c"), ("a b c", "a b"), ("a b c", "a c"), ("a b c", "c b a"), ("a a b", "a b"), ("", "a"), ("a b c", "a")])
def test_one_edit(spark, a, b):
    frame = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    assert frame.select(one_edit(F.col("a"), F.col("b")).alias("x")).first().x == one_word_apart(a.split(), b.split())


def sketches_of(spark, texts, scale):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: r.s for r in frame.select("i", sketch(F.col("t"), 5, scale).alias("s")).collect()}


def test_sketch_keeps_the_lowest_part(spark):
    text = " ".join(f"w{i % 700}" for i in range(4000))
    every, part = sketches_of(spark, [text, None, "", "Two Words", "two  words"], 1), sketches_of(spark, [text], 8)
    assert len(every[0]) == 700 and part[0] == [h for h in every[0] if h <= -(1 << 63) + (1 << 61) - 1] and 50 < len(part[0]) < 130
    assert every[1] == every[2] == [] and every[3] == every[4] and len(every[3]) == 1


def test_sketches_merge_and_compare(spark):
    long, short = [f"a{i}" for i in range(3000)], [f"a{i}" for i in range(300)]
    frame = spark.createDataFrame([(" ".join(long), " ".join(short), " ".join(long[:1600]), " ".join(long[1596:]))], "l string, s string, x string, y string")
    one = frame.select(*(sketch(F.col(c), 5, 4).alias(c) for c in "lsxy"))
    r = one.select(containment(F.col("s"), F.col("l")).alias("c"), likeness(F.col("s"), F.col("l")).alias("j"), (merge(F.col("x"), F.col("y")) == F.col("l")).alias("m"),
                   likeness(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")).alias("e")).first()
    assert r.c == 1 and abs(r.j - 0.1) < 0.04 and r.m and r.e == 1


def plain_hashes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i:i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h - (1 << 64) if h >= 1 << 63 else h)
    return out


def plain_measures(a, b, scale):
    """Likeness and containment by the sketches, or by all hashes where a sketch is empty."""
    full = plain_hashes(a), plain_hashes(b)
    low = [{h for h in hs if h < -(1 << 63) + (1 << 64) // scale} for hs in full]
    x, y = low if all(low) else full
    return len(x & y) / len(x | y) if x | y else 1.0, len(x & y) / len(x) if x else 1.0


@pytest.mark.parametrize("scale", [2, 8])
def test_measures_match_plain_hashes(spark, scale):
    rows = [(i, t) for i, t in {i: t for i, t in awkward() if i is not None}.items()]
    rows += [(200, rows[0][1]), (199, " ".join(rows[0][1].split()[:6])), (198, "one two three"), (197, "one two three"), (196, "four")]
    line = sorted(((i, t or "") for i, t in rows), reverse=True)
    got = {r.doc_id: r for r in document_fingerprints(table(spark, rows), scale=scale).collect()}
    short = 0
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        cut = len(t) // 3
        edited, r = t[:len(t) - cut] + after[:cut], got[i]
        assert (r.near_edited, r.in_edited) == pytest.approx(plain_measures(t, edited, scale))
        assert (r.near_next, r.in_next) == pytest.approx(plain_measures(t, after, scale))
        lowest = sorted(h for h in plain_hashes(t) if h < -(1 << 63) + (1 << 64) // scale)
        every = sorted(plain_hashes(t))
        assert r.fingerprint == ("".join(f"{h % (1 << 64):016x}" for h in lowest) or (f"-{every[0] % (1 << 64):016x}" if every else ""))
        short += bool(every and not lowest)
    assert short > 0


def test_empty_sketches_keep_merging_right(spark):
    texts = [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4}" for i in range(40)]
    empty = sum(not s for s in sketches_of(spark, texts, 2).values())
    assert 5 < empty < 35  # none is filled up with a hash above the fraction
    frame = spark.createDataFrame(list(zip(texts, texts[1:])), "a string, b string")
    for r in frame.select("a", "b", merge(sketch(F.col("a")), sketch(F.col("b"))).alias("m")).collect():
        assert r.m == sorted(h for h in plain_hashes(r.a) | plain_hashes(r.b) if h < 0)


def test_fingerprints_of_every_document_and_its_successor(spark):
    rows = [r for r in awkward() if r not in [(3, awkward()[3][1])]] + [(3, awkward()[3][1])]
    got = document_fingerprints(clashing(table(spark, rows))).collect()
    assert len(got) == len(rows)
    alone = {r.k: r.f for r in spark.createDataFrame([(t or "",) for _, t in rows], "k string").select("k", printed(sketch(F.col("k")), F.col("k")).alias("f")).collect()}
    ids = {(i, t or "") for i, t in rows}
    unique = [(i, t) for i, t in ids if i is not None and sum(j == i for j, _ in ids) == 1]
    line = sorted(unique, reverse=True)
    following = {i: line[k + 1][1] for k, (i, _) in enumerate(line[:-1])}
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    checked = 0
    for i, t in unique:
        r = by_id[i][0]
        assert r.n_chars == len(t) and r.fingerprint == alone[t] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        after = [j for j, _ in line if j < i]
        if after and len(by_id[after[0]]) == 1 and not [1 for j, _ in ids if j is not None and after[0] < j < i]:
            cut = len(t) // 3
            assert r.edited_sha256 == hashlib.sha256((t[:len(t) - cut] + following[i][:cut]).encode()).hexdigest()
            checked += 1
    assert checked > 30
    single = document_fingerprints(table(spark, [(1, "abc def")])).first()
    assert single.near_next == 1 and single.edited_sha256 == hashlib.sha256(b"abc d" + b"ab").hexdigest()
    assert document_fingerprints(table(spark, [])).count() == 0
