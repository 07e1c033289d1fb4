import numpy as np
import pytest
import xxhash
from llm.helpers import awkward, clashing, table

from pairloom.llm.components import connected_components
from pairloom.llm.simhash import BKTree, drop_near_duplicates, fingerprint_links, shard_links, simhash64, simhash_groups


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(prints)
    low = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            low[group[p]] = min(doc_id, low.get(group[p], doc_id))
    return sorted((str(i), f"{p:016x}", low.get(group[p])) for (i, _), p in zip(rows, prints))


def test_groups_match_brute_force(spark):
    rows = awkward()
    got = simhash_groups(clashing(table(spark, rows))).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected(rows)


def test_one_document_of_each_group_stays(spark):
    rows = awkward()
    kept = drop_near_duplicates(clashing(table(spark, rows)))
    assert len(kept.columns) == 19
    prints = [plain_fingerprint(r.text) for r in kept.collect()]
    assert len(prints) == len(set(plain_groups(prints).values())) == len(set(plain_groups([plain_fingerprint(t) for _, t in rows]).values()))
    assert kept.where("doc_id = 3").count() == 1


def test_empty_table(spark):
    assert simhash_groups(table(spark, [])).count() == 0 and drop_near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("text", [None, "", " \t", "A", "a B c", "Été a b c d", "x y " * 50, "\x1c a\xa0b c d"])
def test_fingerprint(text):
    assert simhash64(text) == plain_fingerprint(text)


def test_tree_finds_every_neighbour():
    rand = np.random.default_rng(3)
    base = rand.integers(0, 2**63, 20, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ (np.uint64(1) << np.uint64(40)), rand.integers(0, 2**63, 300, dtype=np.uint64)]))
    who, found = BKTree(points).within(points, 3)
    brute = {(i, j) for i in range(len(points)) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= 3}
    assert set(zip(who.tolist(), found.tolist())) == brute
    groups = plain_groups([int(p) for p in points])
    assert [int(points[i]) for i in shard_links(points, 3)] == [groups[int(p)] for p in points]


def test_large_shards_are_split_without_loss(spark):
    """Fingerprints of one dense ball, with shards of four rows at most."""
    rand = np.random.default_rng(5)
    values = {0}
    for _ in range(150):
        v = 0
        for b in rand.integers(0, 63, rand.integers(0, 7)):
            v |= 1 << int(b)
        values.add(v)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    labels = {r.node: r.label for r in connected_components(fingerprint_links(frame, 3, shard_rows=4)).collect()}
    groups = plain_groups(values)
    assert {v: labels.get(v, v) for v in values} == groups


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}
