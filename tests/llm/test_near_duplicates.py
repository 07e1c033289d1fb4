import os
import random

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from llm.helpers import awkward, clashing, table
from pyspark.sql import functions as F

from pairloom.llm import near_duplicates as nd
from pairloom.llm.near_duplicates import drop_similar
from pairloom.llm.simhash import keep_first
from pairloom.session import cut_lineage, shared_dir


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """Brute force: one id of each group of sets linked at 0.8 or more."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(str(min((x for x in ids if x is not None), default=None)) for ids in groups.values())


def edited(rand, words, changes):
    return " ".join("new%d" % rand.randint(0, 10**6) if i in changes else w for i, w in enumerate(words))


def test_stage_links_all_similar_texts_and_no_others(spark):
    """Edits on both sides of 0.8, a chain, a large group of near copies, and awkward rows."""
    rand = random.Random(6)
    rows = [(i + 1000 if i is not None else None, t) for i, t in awkward() if i is None or i < 130]
    for k in range(60):
        words = [f"w{rand.randint(0, 900)}" for _ in range(rand.randint(12, 200))]
        rows.append((2000 + 10 * k, " ".join(words)))
        for j in range(3):
            changes = set(rand.sample(range(len(words)), max(1, len(words) * (j + 1) // 90)))
            rows.append((2001 + 10 * k + j, edited(rand, words, changes)))
    words = [f"w{rand.randint(0, 900)}" for _ in range(100)]
    rows += [(4000 + k, edited(rand, words, {rand.randint(0, 99)})) for k in range(80)]
    for k in range(30):  # each like the next, not like those further away
        words = words[4:] + [f"c{k}x{i}" for i in range(4)]
        rows.append((5000 + k, " ".join(words)))
    got = corpus_pipeline.near_duplicates(spark, clashing(table(spark, rows)), "")
    assert sorted(str(r.doc_id) for r in got.collect()) == plain_kept(rows)


def test_cut_shards_and_families_give_the_same_groups(spark):
    """Chunks of two or three rows meet in blocks, and no link is lost; fingerprints that are equal stay apart unless their sets are similar."""
    rand = random.Random(8)
    words = [f"w{rand.randint(0, 900)}" for _ in range(90)]
    rows = [(k, edited(rand, words, set(rand.sample(range(90), rand.randint(1, 4))))) for k in range(25)]
    rows += [(100 + k, " ".join([*words[:60], *(f"t{k}x{i}" for i in range(30))])) for k in range(10)]  # share their start, similar to none
    docs = table(spark, rows)
    prints = cut_lineage(nd.shingle_prints(docs, 5, 0.8))
    got = [sorted(nd.similar_groups(docs, prints, 22, 0.8, 5, *sizes).collect()) for sizes in ((), (3, 2), (2, 3, 1500))]
    assert got[0] and got[0] == got[1] == got[2]
    keys = {r.set_key: r.doc_id for r in prints.collect()}
    label = {keys[r.set_key]: r.label for r in got[0]}
    groups = {label.get(i, -i) for i, _ in rows}
    assert len(groups) == len(plain_kept(rows))


def test_a_group_is_searched_by_a_tree_and_gives_no_pairs(monkeypatch):
    """300 fingerprints within the radius of each other, in one shard and in one family: spanning links only."""
    trees = []

    class Counted(nd.BKTree):
        def __init__(self, points):
            trees.append(len(points))
            super().__init__(points)

    monkeypatch.setattr(nd, "BKTree", Counted)
    rand = np.random.default_rng(3)
    fp = (np.uint64(1) << rand.integers(0, 64, 300).astype(np.uint64)).view(np.int64)
    frame = pd.DataFrame({"h": 7, "i": 0, "j": 0, "asks": False, "set_key": np.arange(300), "n": 100, "pos": 1, "fp": fp})
    stars = pd.concat(nd._stars(22, 0.8)(iter([frame[:100], frame[100:]])))
    assert len(stars) == 299 and set(stars["v"]) == {0} and trees == [len(set(fp.tolist()))]
    base = np.sort(rand.integers(0, 2**63, 120).astype(np.uint64))
    sets = [np.sort(np.append(base[:-1], np.uint64(k))) for k in range(300)]
    links = nd._spanning(22, 0.8)(frame[["asks", "set_key", "fp"]].assign(hashes=[x.tobytes() for x in sets]))
    assert len(links) == 299 and len(trees) == 2
    late = frame.assign(pos=40)  # what is left after position 40 of 100 is too little
    assert not len(pd.concat(nd._stars(22, 0.8)(iter([late]))))


@pytest.mark.parametrize("bits", [6, 24])
def test_only_marked_documents_are_shuffled(spark, bits):
    rows = [(i, f"text {i}") for i in range(300)] + [(5, "text 5"), (5, "text 5"), (None, "text 7"), (None, "alone"), (None, "alone"), (8, None), (9, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    # every fourth text is one group; equal texts are one group
    labelled = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.xxhash64("text")).alias("label"))
    kept = keep_first(docs, labelled, bits)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    texts = {(i, t) for i, t in rows if i is None or i % 4} | {(0, "text 0")}
    texts -= {(None, "text 7")}  # (7, "text 7") is first
    assert got == sorted((i is None, i or 0, t or "") for i, t in texts)
    assert kept.columns == docs.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan  # documents that surely stay are read and handed on


def test_the_stage_leaves_no_sets_behind(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 30) * 100 + k}" for k in range(60)) + (" x" if i >= 30 else "")) for i in range(60)], "doc_id long, text string")
    assert {r["doc_id"] for r in drop_similar(docs).collect()} == set(range(30))
    left = {x.rsplit("-", 5)[0] for x in set(os.listdir(folder)) - before}
    assert not {x.split("-")[0] for x in left} & {"shingles", "shared", "sets", "stars"}
