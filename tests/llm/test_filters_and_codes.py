"""Filter audit, url filters and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from pairloom.llm.filter_audit import Ranges, Trie, filter_audit, filter_masks
from pairloom.llm.queries import URL_RULES
from pairloom.llm.url_filters import judge_urls, page_links
from pairloom.llm.vector_codes import vector_codes
from tests.llm.helpers import awkward, clashing, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text, copy):
    text = text or ""
    words = WORD.findall(text)
    return ((len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
            + 8 * bool(re.search(r"[#$%&*|]", text)) + 16 * copy)


def plain_masks(rows):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    return [(r[0], (r[2] if len(r) > 2 else None) or "", plain_mask(r[1], r[0] is not None and r[0] > least[r[1] or ""])) for r in rows]


def audit_rows():
    rand = random.Random(5)
    base = [(r[0], r[1], rand.choice([None, "en", "de", ""])) for r in awkward()]
    long = " ".join(f"word{i}" for i in range(150))
    base += [(200 + i, long, "en") for i in range(6)] + [(199, long, "de"), (199, long, "en"), (300, "LOUD " * 120, "en"), (301, long + " $", "fr")]
    base += [(400 + i, long + f" end{i % 7}" + "x" * i, rand.choice("ab")) for i in range(40)]
    return base


def test_masks_and_audit_equal_a_plain_version(spark, monkeypatch):
    import pairloom.llm.filter_audit as fa
    rows = audit_rows()
    labels = [(i, rand % 2, rand % 3 == 0) for rand, i in enumerate([None, 0, 1, 2, 3, 3, 5, 101, 110, 200, 201, 301, 401, 402])]
    frame = clashing(table(spark, rows)).withColumnRenamed("mask", "mask")
    marks = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    want = defaultdict(int)
    for m in plain_masks(rows):
        want[m] += 1
    # many ranges and slices, and windows of one text
    original = fa.adaptive_ranges
    monkeypatch.setattr(fa, "adaptive_ranges", lambda t, d: original(t, d, trie_bytes=2000, most=5, prefix=12))
    combined = fa._combined
    monkeypatch.setattr(fa, "_combined", lambda d, r: combined(d, r, window=300))
    got = defaultdict(int)
    for r in filter_masks(frame).collect():
        got[r["doc_id"], r["part"], r["mask"]] += r["n"]
    assert got == want

    good, bad = ({i for i, *m in labels if i is not None and m[j] == 1} for j in (0, 1))
    rows_of = defaultdict(list)
    for i, part, mask in plain_masks(rows):
        rows_of[part].append((i, mask))
    plain, shapley = {}, defaultdict(int)
    for part, members in rows_of.items():
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[1] & bit]
                failing = [m for m in members if m[1] & bit]
                left = [m for m in left if not m[1] & bit]
                shapley[part, letter] += len(gone)
                plain[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == bit for m in members),
                                                     sum(m[0] in good for m in gone), sum(m[0] in bad for m in gone)]
    audit = filter_audit(frame, marks).collect()
    assert len(audit) == len(plain) == 600 * len(rows_of)
    for r in audit:
        assert [r[c] for c in "kept removed redundant unique_fails good_lost toxic_lost".split()] == plain[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_of_no_documents(spark):
    none = table(spark, [])
    assert filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_trie_terminals_are_whole_texts():
    rand = random.Random(2)
    texts = list({bytes(rand.choice(b"ab") for _ in range(rand.randint(0, 12))) for _ in range(400)}) + [b"a" * 5000 + b"b", b"a" * 5000]
    trie, least = Trie(), {}
    for _ in range(3):
        for t in rand.sample(texts, len(texts)):
            i = rand.randint(0, 10 ** 6)
            least[t] = min(least.get(t, i), i)
            trie.holders(t).add(i, "", 0, 1, [])
    assert {t: trie.holders(t).least for t in texts} == least
    assert sorted(h.least for h in trie.terminals()) == sorted(least.values())


def test_ranges_cut_as_short_as_can_be_and_slice_heavy_ones():
    r = Ranges([b"licence " * 8] * 60 + [bytes([97 + i]) * 40 for i in range(20)], 16, 8)
    assert all(len(c) <= 2 for c in r.cuts) and max(r.slices) >= 8
    tries = {r.trie(b"licence " * 8 + str(i).encode(), hashlib.blake2b(str(i).encode()).digest()) for i in range(200)}
    assert len(tries) >= 8 and max(tries) < r.total


def page(i, url, links="", other=""):
    return (i, url, f"<html><head>{links}</head><body>{other}</body></html>")


def url_pages():
    canonical = '<link rel="canonical" href="{}">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    pages = [
        page(1, "http://a.net/1", canonical("https://b.net/2")), page(2, "https://b.net/2#x", refresh("http://c.net/3")),
        page(3, "https://c.net/3", canonical("https://www.example.org/es/9")),  # blocked, so 1 to 3 are
        page(4, "https://d.net/", canonical("/4")), page(5, "https://d.net/4", "<LINK HREF='https://shop.com/de/x' REL=Canonical>"),
        page(6, "https://e.net/6", refresh("https://shop.com/de/x")), page(7, "https://e.net/7", canonical("https://e.net/6") + canonical("https://x.org/")),
        page(8, "http://sub.example.org/en/10?a=1"), page(9, "HTTP://WWW.Example.ORG/en/2"), page(10, "http://shop.com/fr/1"),
        page(11, "https://f.net/1", "<!-- " + canonical("https://shop.com/de/") + " --><script>'" + canonical("https://shop.com/de/") + "'</script>"),
        page(12, "https://shop.com/de/y", canonical("https://x.org/")), page(None, "https://g.net", refresh("https://g.net/")),
        page(13, None, canonical("https://shop.com/de/z")), page(14, "mailto:x@y.org"), (15, "https://h.net/", None), (16, "https://h.net/", ""), (16, "https://h.net/", ""),
        page(17, "https://i.net/a#b?c", canonical("http://[bad")), page(18, "http://orgx/es/"), page(19, "http://example.org"),
    ]
    pages += [page(100 + i, f"https://chain.net/{i}", canonical(f"https://chain.net/{i + 1}")) for i in range(40)]
    pages += [page(200, "https://chain.net/40", refresh("https://de.shop.com/de/")), page(300, "https://j.net/", "", "x " * 200_000 + canonical("https://shop.com/de/far"))]
    return pages


def plain_verdicts(pages):
    def cut(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return m[1].lower(), m[2]

    def best(url):
        host, path = cut(url)
        fit = [(len(h + p), v == "allow", v, h + p) for v, h, p in URL_RULES if ("." + host).endswith("." + h) and host and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    def spelled(url):
        if url is None or "://" not in url:
            return url
        scheme, rest = url.split("://", 1)
        host, path = cut(url)
        query = re.match(r"[^?#]*(\?[^#]*)?", url)[1] or ""
        return ("https" if scheme.lower() in ("http", "https") else scheme.lower()) + "://" + re.sub(":(80|443)?$", "", host) + (path or "/") + query

    linked = defaultdict(set)
    for _, url, body in pages:
        for to in page_links(body, url) if url and "://" in url else []:
            a, b = spelled(url), spelled(to)
            linked[a].add(b)
            linked[b].add(a)
    out = []
    for i, url, _ in pages:
        verdict, rule = best(url)
        seen, todo = {spelled(url)}, [spelled(url)]
        while todo:
            for n in linked[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        votes = {best(u)[0] for u in seen} - {None}
        out.append((i, *cut(url), rule, verdict or ("allow" if "allow" in votes else "block" if votes else "allow")))
    return out


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_verdicts_reach_aliases(spark):
    pages = url_pages()
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for name in ("host", "path", "rule", "decision", "label", "address", "_rules"):
        frame = frame.selectExpr("*", f"1 as `{name}`")
    got = [tuple(r) for r in judge_urls(frame, URL_RULES).collect()]
    assert sorted(got, key=key) == sorted(plain_verdicts(pages), key=key)
    verdicts = {r[0]: (r[3], r[4]) for r in got}
    assert verdicts[1] == verdicts[2] == verdicts[3] == (None, "block")
    assert verdicts[4] == verdicts[5] == (None, "allow")  # x.org allows through e.net/7, e.net/6 and shop.com/de/x
    assert verdicts[8] == ("example.org/en/1", "block") and verdicts[9] == ("org/", "allow") and verdicts[12] == ("com/de/", "block")
    assert verdicts[11][1] == verdicts[13][1] == "allow" and verdicts[100][1] == verdicts[139][1] == verdicts[300][1] == "block"


def test_url_filters_on_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(none, URL_RULES).collect() == []
    some = spark.createDataFrame([(1, "http://a.b/c", "")], none.schema)
    assert [tuple(r) for r in judge_urls(some, []).collect()] == [(1, "a.b", "/c", None, "allow")]


def plain_codes(rows, rounds=6, count=8, entries=16):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(order[0][2])
    kept = [r for r in kept if len(r[2]) == dim]
    first = {}
    for i, _, v in order:
        if len(v) == dim:
            first.setdefault(i, v)
    size = dim // count
    books = [[v[p * size:(p + 1) * size] for v in list(first.values())[:entries]] for p in range(count)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(count):
            members = defaultdict(list)
            for _, _, v in kept:
                part = v[p * size:(p + 1) * size]
                members[near(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*members[e])] if members[e] else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, lab, v in kept:
        found = [near(v[p * size:(p + 1) * size], books[p]) for p in range(count)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), lab))
    return [(i, c, e, sum(x[2] for x in coded if x[3] == lab), digest) for i, c, e, lab in coded]


def vectors(n=300, dim=16, seed=3):
    rand = random.Random(seed)
    rows = [(i * 7 % 1000, [rand.gauss(i % 5, 0.4) for _ in range(dim)], rand.choice([None, 1, 2])) for i in range(n)]
    rows += [(5000 + i, rows[0][1], 3) for i in range(200)]  # a third are copies
    rows += [(rows[1][0], rows[2][1], 1), rows[3], rows[3], (None, rows[4][1], None), (1, None, 1), (2, [None] * dim, 1), (3, [float("nan")] * dim, 1),
             (4, [float("inf")] + [0.0] * (dim - 1), 1), (6, [1.0] * 3, 1), (8, [-0.0] * dim, 1)]
    return rows


@pytest.mark.parametrize("owner", [250_000, 2])
def test_codes_equal_plain_lloyd(spark, monkeypatch, owner):
    import pairloom.llm.vector_codes as vc
    monkeypatch.setattr(vc, "MEMBERS_AN_OWNER", owner)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    for name in ("v", "code", "error", "position", "parts"):
        frame = frame.selectExpr("*", f"1 as `{name}`")
    got = sorted((tuple(r) for r in vector_codes(frame).collect()), key=key)
    assert got == sorted(plain_codes(rows), key=key)


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    few = [(2, [float(j) for j in range(8)], None), (1, [0.5] * 8, None), (9, [-1.0] * 8, 4)]
    assert sorted(map(tuple, vector_codes(spark.createDataFrame(few, schema)).collect())) == sorted(plain_codes(few))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(spark.createDataFrame([(1, [1.0] * 9, 1)], schema))


def test_wide_components_stay_exact(spark):
    rand = random.Random(1)
    rows = [(i, [rand.uniform(-60000, 60000) for _ in range(8)], 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vector_codes(frame).collect())) == sorted(plain_codes(rows))
