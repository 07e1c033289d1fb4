"""Universes, variants, labels, splits, checks and run files."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.operators import labels as lb
from pairloom.operators import pair_filters as pf
from pairloom.operators import quality as dq
from pairloom.operators import splits as sp
from pairloom.operators import universe as un
from pairloom.operators import variants as va
from pairloom.plans.sources import write_runs
from pairloom.session import shared_dir
from pairloom.sources import files, runs, sinks


def universe(spark, pools, organism="Homo sapiens"):
    rows = [(t, list(c), i + 1, organism) for i, (t, c) in enumerate(pools.items())]
    return spark.createDataFrame(rows, "target_id string, candidate_ids array<string>, source_row_id long, organism string")


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


# -- readers ---------------------------------------------------------------------------------------

def test_universe_csv(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text(
        "target_id,candidate_ids,target_label,organism,taxonomy_id,note\n"
        "target1, c1;c2 ;c3,positive,Homo sapiens,9606, x \n"
        ",c1;c2,positive,,,\n"
        "target2,c4;;c5,,,,\n"
        "target3, ; ,,,,\n"
        '"target,4","a;""b""",neg,,,\n'
    )
    rows = {r["target_id"]: r for r in files.read_universe_csv(spark, str(path)).collect()}
    assert set(rows) == {"target1", "target2", "target,4"}
    one = rows["target1"]
    assert one["candidate_ids"] == ["c1", "c2", "c3"] and one["raw_payload"] == {"note": "x"} and one["candidate_count"] == 3
    assert one["source_row_id"] == 1 and rows["target2"]["source_row_id"] == 3 and rows["target,4"]["source_row_id"] == 5
    assert rows["target2"]["target_label"] == "positive" and rows["target2"]["organism"] is None
    assert rows["target,4"]["candidate_ids"] == ["a", '"b"'] and one["pool_metadata"]["generation_source"]


def test_universe_csv_needs_columns(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("target_id,other\na,b\n")
    with pytest.raises(ValueError, match="candidate_ids"):
        files.read_universe_csv(spark, str(path))


def test_universe_jsonl(spark, tmp_path):
    path = tmp_path / "u.jsonl"
    good = {"target_id": "t1", "target_label": "positive", "candidate_ids": ["a", "b"], "source_file": "f", "source_row_id": 1}
    path.write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({**good, "target_id": "t2"}) + "\n")
    assert as_set(files.read_universe_jsonl(spark, str(path)), "target_id") == {("t1",), ("t2",)}


def test_row_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("target_id,candidate_ids\n" + "".join(f"t{i},c{i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_universe_csv(spark, str(path))
        assert rows.where(F.col("target_id") == F.concat(F.lit("t"), F.col("source_row_id").cast("string"))).count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_records(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"data": {"items": [{"a": 1}, {"a": 2}], "one": {"a": 3}, "text": "x"}}))
    assert as_set(files.read_json_records(spark, str(path), "data.items"), "a") == {(1,), (2,)}
    assert as_set(files.read_json_records(spark, str(path), "data.one"), "a") == {(3,)}
    with pytest.raises(ValueError):
        files.read_json_records(spark, str(path), "data.text")


def test_load_data_rejects_unknown(spark):
    with pytest.raises(ValueError):
        files.load_data(spark, "x", "excel")


def make_run(base, run_id, pairs, assignments, legacy=False):
    folder = os.path.join(base, run_id)
    os.makedirs(folder)
    with open(os.path.join(folder, "final_dataset.csv"), "w") as f:
        f.write(("target_id,non_target_id" if legacy else "tp_id,ntp_id") + "\n" + "".join(f"{a},{b}\n" for a, b in pairs))
    with open(os.path.join(folder, "mf_assignments.csv" if legacy else "target_assignments.csv"), "w") as f:
        f.write(("mf_id" if legacy else "target_id") + ",num_candidates,candidates\n")
        f.write("".join(f'{t},{len(c)},"{",".join(c)}"\n' for t, c in assignments))
    with open(os.path.join(folder, "run_metadata.json"), "w") as f:
        json.dump({"run_id": run_id, "species": "x", "species_category": "humans", "filter1_rows": 9, "filter2_rows": 5, "filter3_rows": 3,
                   "final_rows": len(pairs), "random_seed": 42}, f, indent=2)


def test_run_directory(spark, tmp_path):
    base = str(tmp_path)
    make_run(base, "r2", [("t1", "a"), ("t1", "b"), ("t9", "z")], [("t1", ["a", "b"])])
    make_run(base, "r1", [("t1", "a")], [("t1", ["a"])], legacy=True)
    os.makedirs(tmp_path / "empty")
    assert [r["run_id"] for r in runs.list_runs(spark, base).collect()] == ["r1", "r2"]
    run = runs.load_run(spark, base, "r2", load_all=True)
    pairs = files.parse_assignments(run["assignments"])
    assert as_set(pairs, "target_id", "candidate_id", "count_ok") == {("t1", "a", True), ("t1", "b", True)}
    assert as_set(dq.run_consistency(run["pairs"], pairs), "tp_id") == {("t9",)}
    both = runs.load_runs_union(spark, base, ["r1", "r2"])
    assert both.count() == 4 and as_set(both, "species") == {("humans",)}
    assert as_set(pf.stage_funnel(run["metadata"]), "stage", "rows") == {("filter1", 9), ("filter2", 5), ("filter3", 3), ("final", 3)}
    messages = as_set(runs.run_validate(spark, base, "r1", ["final_dataset.csv", "pipeline.log"]), "level", "message")
    assert ("error", "missing file: pipeline.log") in messages and ("warning", "legacy column mf_id") in messages
    assert ("error", "pair file lacks tp_id, ntp_id") in messages
    assert runs.species_of(spark, base, "r1") == "humans" and runs.species_of(spark, base, "gone") == "unknown"
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, base, "gone")


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export_takes_less_room_than_its_text(spark, tmp_path, fmt):
    pairs = [(f"target{i // 400:04d}", f"candidate{i % 400:03d}") for i in range(8000)]
    make_run(str(tmp_path / "base"), "r1", pairs, [("target0000", ["a", "b"])])
    sinks.export_dataset(spark, str(tmp_path / "base"), "r1", str(tmp_path / "out"), fmt, include_metadata=True)
    reader = spark.read.schema("tp_id string, ntp_id string").option("header", True)
    assert sorted(map(tuple, reader.format(fmt).load(f"{tmp_path}/out/pairs").collect())) == sorted(pairs)
    assert as_set(spark.read.option("header", True).csv(f"{tmp_path}/out/assignments"), "target_id") == {("target0000",)}
    assert folder_bytes(tmp_path / "out" / "pairs") < 8000 * 24 / 4


def test_runs_leave_no_scratch_table_behind(spark, tmp_path):
    docs = [(i, "en" if i % 3 else "fr", f"w{i} " + "some words again, and again " * 20) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    base = write_runs(spark, f"{tmp_path}/in")
    new = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert new == {base.rsplit("/", 1)[1]}
    run = runs.load_run(spark, base, "run_b")
    words = [w for i, lang, text in docs if lang == "en" for w in re.split("[^A-Za-z0-9]+", text) if w]
    assert run["pairs"].count() == len(words) and run["assignments"].count() == 26
    assert runs.load_runs_union(spark, base, ["run_a", "run_b"]).where("run_id = 'run_b'").count() == len(words)


def plan_size(df):
    """Characters of the logical plan."""
    return len(df._jdf.queryExecution().analyzed().toString())


def test_many_runs_are_one_scan(spark, tmp_path):
    base = str(tmp_path)
    for i in range(500):
        folder = tmp_path / f"r{i:03d}"
        folder.mkdir()
        if i % 5:
            (folder / "final_dataset.csv").write_text(f"tp_id,ntp_id\nt{i},a\nt{i},b\n")
        else:  # another header, in another order
            (folder / "target_non_target_dataset.csv").write_text(f"extra,non_target_id,target_id\nx,a,t{i}\n")
        (folder / "run_metadata.json").write_text(json.dumps({"run_id": f"r{i:03d}", "species_category": "even" if i % 2 == 0 else "odd"}))
    names = [f"r{i:03d}" for i in range(500)]
    rows = runs.load_runs_union(spark, base, names)
    got = {(r["run_id"], r["tp_id"], r["ntp_id"], r["species"], r["extra"]) for r in rows.collect()}
    want = {(f"r{i:03d}", f"t{i}", c, "even" if i % 2 == 0 else "odd", None if i % 5 else "x") for i in range(500) for c in ("ab" if i % 5 else "a")}
    assert got == want
    few = runs.load_runs_union(spark, base, names[:10], {"r001": "own"})
    assert plan_size(rows) < 1.2 * plan_size(runs.load_runs_union(spark, base, names[:10])) and as_set(few, "run_id", "species") >= {("r001", "own"), ("r000", None)}
    with pytest.raises(FileNotFoundError):
        runs.load_runs_union(spark, base, ["r000", "gone"])


def test_headers_are_read_without_the_rows(spark, tmp_path):
    """First lines come from the files' starts, with no pass over their rows; empty files have none."""
    import gzip

    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "part-0.csv").write_text("a,b\n" + "1,2\n" * 1000)
    (tmp_path / "r1" / "part-1.csv").write_text("")
    (tmp_path / "r1" / "_SUCCESS").write_text("")
    (tmp_path / "r2.csv").write_text("b,a\n3,4\n")
    with gzip.open(tmp_path / "r3.csv.gz", "wt") as f:
        f.write("a,b\n5,6\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = runs._headers(spark, [str(tmp_path / n) for n in ("r1", "r2.csv", "r3.csv.gz")])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {h: [os.path.basename(f) for f in files] for h, files in found.items()} == {"a,b": ["part-0.csv", "r3.csv.gz"], "b,a": ["r2.csv"]}


def test_large_files_are_digested_in_blocks(spark, tmp_path):
    import hashlib

    contents = {"small": b"abc", "large": bytes(range(256)) * 40_000, "empty": b""}
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in sinks.artifact_fingerprints(spark, [f"{tmp_path}/{n}" for n in [*contents, "gone"]], whole_bytes=1000).collect()}
    assert got == {**{n: hashlib.sha256(b).hexdigest() for n, b in contents.items()}, "gone": "unknown"}


# -- variants --------------------------------------------------------------------------------------

def md5(*parts):
    import hashlib

    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def greedy(pools, neg, seed, drop=True, floor=0, mode="sample_without_replacement", order="hash"):
    """The sequential definition."""
    names = list(pools)
    line = sorted(names, key=lambda t: (md5(seed, t), t)) if order == "hash" else names
    used, out = set(), {}
    for t in line:
        if len(pools[t]) < floor:
            continue
        free = [c for c in dict.fromkeys(pools[t]) if c not in used]
        if len(free) < neg and drop:
            continue
        if mode == "use_all":
            picks = free[:neg]
        elif mode == "sample_with_replacement":
            picks = [min(free, key=lambda c: (md5(seed, i, t, c), c)) for i in range(neg)] if free else []
        else:
            picks = sorted(free, key=lambda c: (md5(seed, t, c), c))[:neg]
        out[t] = sorted(picks)
        used.update(picks)
    return out


def picked(assignments):
    out = {}
    for r in assignments.collect():
        out.setdefault(r["target_id"], [])
        if r["role"] == "negative":
            out[r["target_id"]].append(r["protein_id"])
    return {t: sorted(c) for t, c in out.items()}


@pytest.mark.parametrize("mode", va.MODES)
@pytest.mark.parametrize("scarcity", ["drop_target", "use_available"])
def test_variant_equals_sequential_greedy(spark, mode, scarcity):
    rng = random.Random(len(mode))
    names = [f"c{i}" for i in range(25)]
    pools = {f"t{i:02d}": rng.sample(names, rng.randint(1, 12)) for i in range(18)}
    order = "source" if mode == "use_all" else "hash"
    policy = va.VariantPolicy("1:3", 2, scarcity, mode, order)
    rows, events = va.variant_generate(universe(spark, pools), policy, seed=7)
    floor = 2 if scarcity == "drop_target" else 0
    want = greedy(pools, 3, 7, scarcity == "drop_target", floor, mode, order)
    assert picked(rows) == want
    if scarcity == "drop_target":
        assert {r["target_id"] for r in events.collect()} == set(pools) - set(want)


def test_variant_of_identical_pools(spark):
    # every target wants the same few candidates: the hardest case for the parallel rounds
    pools = {f"t{i}": [f"c{j}" for j in range(10)] for i in range(8)}
    policy = va.VariantPolicy("1:2", 1, selection="use_all", order="source")
    rows, events = va.variant_generate(universe(spark, pools), policy)
    assert picked(rows) == {f"t{i}": sorted([f"c{2 * i}", f"c{2 * i + 1}"]) for i in range(5)}
    assert events.count() == 3


def counted(monkeypatch):
    """Rounds after the first, as they are taken."""
    rounds, original = [], va._next_picks
    monkeypatch.setattr(va, "_next_picks", lambda *args: rounds.append(1) or original(*args))
    return rounds


def test_targets_are_served_in_source_order_by_default(spark):
    pools = {f"t{20 - i:02d}": [f"c{j:02d}" for j in range(13)] for i in range(14)}
    rows, events = va.variant_generate(universe(spark, pools), va.VariantPolicy("1:1", 1, selection="use_all"))
    assert picked(rows) == {f"t{20 - i:02d}": [f"c{i:02d}"] for i in range(13)} and events.count() == 1


def test_a_thousand_targets_of_one_pool_take_few_rounds(spark, monkeypatch):
    """Every target after the first loses its picks; they are solved in order in one round, not in one each."""
    rounds = counted(monkeypatch)
    pool = [f"c{j:03d}" for j in range(150)]
    rows, events = va.variant_generate(universe(spark, {f"t{i:04d}": pool for i in range(1000)}), va.VariantPolicy("1:2", 1, selection="use_all"))
    assert picked(rows) == {f"t{i:04d}": pool[2 * i:2 * i + 2] for i in range(75)}
    assert events.count() == 925 and len(rounds) <= 2


@pytest.mark.parametrize("mode,scarcity", [("use_all", "drop_target"), ("sample_without_replacement", "drop_target"),
                                           ("sample_without_replacement", "use_available"), ("sample_with_replacement", "drop_target")])
def test_components_larger_than_a_task(spark, monkeypatch, mode, scarcity):
    """Two separate groups of contended targets, in tasks of 40 rows."""
    monkeypatch.setattr(va, "BLOCK_ROWS", 40)
    monkeypatch.setattr(va, "PATIENCE", 1)
    monkeypatch.setattr(va, "SPAN", 3)
    rounds, rng = counted(monkeypatch), random.Random(9)
    pools = {f"t{i:02d}": rng.sample([f"{'ab'[i % 2]}{j}" for j in range(14)], rng.randint(3, 9)) for i in range(24)}
    order = "source" if mode == "use_all" else "hash"
    rows, _ = va.variant_generate(universe(spark, pools), va.VariantPolicy("1:2", 1, scarcity, mode, order), seed=3)
    assert picked(rows) == greedy(pools, 2, 3, scarcity == "drop_target", 0, mode, order)
    assert len(rounds) < 12


@pytest.mark.parametrize("mode,scarcity", [("use_all", "drop_target"), ("sample_without_replacement", "use_available"), ("sample_with_replacement", "drop_target")])
def test_blocks_of_targets_meet_the_sequential_rule(spark, monkeypatch, mode, scarcity):
    """Scarce candidates, blocks of a few targets, several rounds of longer lists; no task gets more than a block and a target."""
    monkeypatch.setattr(va, "BLOCK_ROWS", 30)
    monkeypatch.setattr(va, "UNIT", 1)
    monkeypatch.setattr(va, "PATIENCE", 1)
    sizes, blocks = [], va._blocks

    def seen(lists):
        placed = blocks(lists)
        rows = lists.withColumn("_unit", va._unit()).join(placed, ["variant_id", "_unit"]).groupBy("_block").count()
        sizes.extend(r["count"] for r in rows.collect())
        return placed

    monkeypatch.setattr(va, "_blocks", seen)
    rng = random.Random(4)
    pools = {f"t{i:02d}": rng.sample([f"c{j}" for j in range(60)], rng.randint(2, 20)) for i in range(40)}
    order = "source" if mode == "use_all" else "hash"
    rows, _ = va.variant_generate(universe(spark, pools), va.VariantPolicy("1:2", 1, scarcity, mode, order), seed=3)
    assert picked(rows) == greedy(pools, 2, 3, scarcity == "drop_target", 0, mode, order)
    assert len(sizes) > 4 and max(sizes) < 30 + 2 * 20


def test_conflict_components(spark):
    pools = {"t0": ["a", "b"], "t1": ["b", "c"], "t2": ["c", "d"], "t3": ["x"], "t4": ["y", "x"], "t5": ["lone"], "t6": ["d", "e"]}
    chain = {f"z{i:02d}": [f"k{i}", f"k{i + 1}"] for i in range(20)}
    rows = [("v", t, c) for t, cs in {**pools, **chain}.items() for c in cs] + [("w", "t0", "a"), ("w", "t5", "a")]
    got = va.conflict_components(spark.createDataFrame(rows, "variant_id string, target_id string, candidate_id string"))
    want = {("v", t): "t0" for t in ("t0", "t1", "t2", "t6")} | {("v", "t3"): "t3", ("v", "t4"): "t3", ("v", "t5"): "t5", ("w", "t0"): "t0", ("w", "t5"): "t0"}
    assert {(r.variant_id, r.target_id): r.component for r in got.collect()} == want | {("v", t): "z00" for t in chain}


def test_short_pools_are_dropped_and_counted(spark):
    pools = {"alpha": list("abcdefg"), "beta": list("hij"), "gamma": [], "delta": list("klmnopqr")}
    rows, events = va.variant_generate(universe(spark, pools), va.VariantPolicy("1:4", 7))
    assert {t: len(c) for t, c in picked(rows).items()} == {"alpha": 4, "delta": 4}
    assert as_set(events, "target_id", "reason") == {("beta", "insufficient_candidates"), ("gamma", "insufficient_candidates")}
    manifest = va.variant_manifest(rows, events).first()
    assert (manifest["targets_included"], manifest["targets_dropped"], manifest["ratio_realized"]) == (2, 2, "2:4")


def test_replay_and_families(spark, partitions):
    u = universe(spark, {f"t{i}": [f"c{(i * 7 + j) % 60}" for j in range(9)] for i in range(12)})
    policy = va.VariantPolicy("1:2", 3, order="hash")
    a, b = (picked(va.variant_generate(u, policy, 5)[0]) for _ in range(2))
    assert a == b == greedy({r["target_id"]: r["candidate_ids"] for r in u.collect()}, 2, 5, floor=3)
    rows, _ = va.variants_ratio_families(u, policy, seed=5)
    assert picked(rows.where("variant_id = 'policy_ratio_1_3'")) == picked(va.variant_generate(u, va.VariantPolicy("1:3", 3, order="hash"), 5)[0])
    many = va.variants_multi(u, policy, 3)[0]
    assert many.select("variant_id").distinct().count() == 3
    assert many.where("role = 'negative'").groupBy("variant_id", "protein_id").count().where("count > 1").count() == 0


def test_policy_refuses_what_it_would_ignore():
    for bad in ({"ratio": "2:3"}, {"ratio": "1:0"}, {"selection": "other"}, {"order": "other"}):
        with pytest.raises(ValueError):
            va.VariantPolicy(**bad)


def test_relax_ratio_records_an_event(spark):
    kept, events = un.scarcity_pool(universe(spark, {"a": ["1"], "b": list("12345")}), 3, "relax_ratio")
    assert as_set(kept, "target_id") == {("b",)} and as_set(events, "target_id", "reason") == {("a", "relax_ratio_skipped")}


def test_universe_checks(spark):
    dup = universe(spark, {"a": ["1"]}).unionByName(universe(spark, {"a": ["2"]}))
    with pytest.raises(ValueError, match="duplicate"):
        un.universe_normalize(dup)
    with pytest.raises(ValueError, match="empty"):
        un.universe_normalize(dup.where("false"))
    assert as_set(dq.universe_validate(dup.where("false")), "error") == {("empty universe",)}
    assert as_set(dq.universe_validate(dup), "target_id", "error") == {("a", "duplicate target_id")}


def test_group_split_and_bundle(spark, tmp_path):
    u = universe(spark, {f"g{i}": [f"k{(3 * i + j) % 40}" for j in range(6)] for i in range(10)})
    rows, events = va.variant_generate(u, va.VariantPolicy("1:3", 4))
    split = sp.split_group_by_target(rows, 0.5, 0.2, 0.3)
    assert split.groupBy("target_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    summary = va.bundle_summary(split, events).first()
    total = rows.count()
    assert summary["total_instances"] == total == 4 * summary["targets_included"] and summary["train_count"] + summary["val_count"] + summary["test_count"] == total
    sinks.export_bundle(split, events, un.universe_manifest(u, "u"), str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b" / "split")).count() == total
    with pytest.raises(ValueError):
        sp.split_group_by_target(rows, 0.7, 0.7, 0.1)


# -- labels ----------------------------------------------------------------------------------------

def test_repeated_and_joined_labels(spark):
    rows = spark.createDataFrame([("X7,X9", "red", 4), ("X8", "blue", 1), ("X7", "green", 2), ("X9", "red", 9), (None, "lost", 0), (" ", "lost", 3)], "accession string, label string, o int")
    got = {r["accession"]: r["labels"] for r in lb.labels_collapse(lb.labels_from_file(rows, order_col="o")).collect()}
    assert got == {"X7": ["green", "red"], "X8": ["blue"], "X9": ["red"]}


@pytest.mark.parametrize("labels,kind,size", [([["a"], ["b"]], "binary", 2), ([["a"], ["b"], ["c"]], "multiclass", 3), ([["a", "b"], ["a"]], "multilabel", 2)])
def test_problem_type(spark, labels, kind, size):
    row = lb.problem_type(spark.createDataFrame([(x,) for x in labels], "labels array<string>")).first()
    assert (row["problem_type"], row["output_size"]) == (kind, size)


def test_problem_type_of_nothing(spark):
    with pytest.raises(Exception, match="no labels"):
        lb.problem_type(spark.createDataFrame([], "labels array<string>")).collect()


# -- splits ----------------------------------------------------------------------------------------

def accessions(spark, n, organism="Homo sapiens"):
    return spark.createDataFrame([(f"A{i}", organism) for i in range(1, n + 1)], "accession string, organism string")


@pytest.mark.parametrize("n", [0, 1, 3, 10, 101])
def test_random_split_sizes(spark, n):
    counts = {r["split"]: r["count"] for r in sp.split_random(accessions(spark, n), test_size=0.25, val_size=0.1).groupBy("split").count().collect()}
    assert counts.get("test", 0) == int(n * 0.25) and counts.get("val", 0) == int(n * 0.1) and sum(counts.values()) == n


def test_independent_split_scans_its_input_a_few_times(spark):
    """Validation, zero-shot and test parts, and the leakage check, with every read of the input counted."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    rows = spark.range(0, 200, 1, 1).selectExpr("concat('A', id) as accession", "'Homo sapiens' as organism").mapInArrow(count, "accession string, organism string")
    conf = sp.IndependentSplit(validation="random", val_size=0.2, zero_shot="random", zero_size=0.1)
    parts = {r["split"]: r["count"] for r in sp.split_independent(rows, conf).groupBy("split").count().collect()}
    assert sum(parts.values()) == 200 and set(parts) == {"train", "val", "test", "zero_shot"} and reads.value <= 7


def test_split_does_not_depend_on_partitions(spark, partitions):
    ids = accessions(spark, 200)
    assert as_set(sp.split_random(ids), "accession", "split") == as_set(sp.split_random(ids.repartition(13)), "accession", "split")
    folds = as_set(sp.kfold_all(ids), "fold", "accession", "split")
    assert folds == as_set(sp.kfold_all(ids.repartition(3)), "fold", "accession", "split")
    assert len({a for _, a, s in folds if s == "test"}) == 200


def test_csv_validation(spark):
    table = spark.createDataFrame([("A3", "validation"), ("A11", "validation"), ("A17", "validation"), ("elsewhere", "validation")], "accession string, split string")
    out = sp.split_independent(accessions(spark, 20), sp.IndependentSplit(validation="csv", test_size=0.2, train_test_seed=31), table)
    rows = dict(as_set(out, "accession", "split"))
    assert {a for a, s in rows.items() if s == "val"} == {"A3", "A11", "A17"} and len(rows) == 20 and list(rows.values()).count("test") == 3


def test_csv_duplicates_are_an_error(spark):
    table = spark.createDataFrame([("A4", "zs"), ("A5", "zero_shot"), ("A6", "zs"), ("A5", "zs")], "accession string, split string")
    with pytest.raises(ValueError, match="Duplicate accession assignments"):
        sp.split_independent(accessions(spark, 6), sp.IndependentSplit(zero_shot="csv"), zero_table=table)


def test_kfold_with_zero_shot(spark):
    table = spark.createDataFrame([("A5", "validation"), ("A2", "zero_shot"), ("A7", "zero_shot"), ("A13", "zero_shot")], "accession string, split string")
    conf = sp.IndependentSplit(validation="csv", train_test="cross_validation", n_splits=4, train_test_seed=101, zero_shot="csv")
    rows = dict(as_set(sp.split_independent(accessions(spark, 14), conf, table, table), "accession", "split"))
    assert {a for a, s in rows.items() if s == "zero_shot"} == {"A2", "A7", "A13"} and len(rows) == 14


def test_organism_aliases(spark):
    df = spark.createDataFrame([("Homo sapiens",), ("Mus-musculus",), ("E. coli K12",), (None,)], "organism string")
    got = [r["matched_group"] for r in sp.organism_match(df, "organism", ["Human", "mouse", "EColi"]).collect()]
    assert got == ["Human", "mouse", "EColi", None]


def test_leakage_kinds(spark):
    samples = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val"), ("x", "val")], "accession string, split string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    assert as_set(dq.split_leakage_check(samples, ids), "kind", "accession") == {("overlap", "a"), ("missing", "c"), ("extra", "x")}


# -- pair filters ----------------------------------------------------------------------------------

def test_weighted_pick_prefers_heavy_candidates(spark):
    rows = [(f"t{i}", f"c{j}", 0.0, 0.0 if j < 5 else 9.0) for i in range(200) for j in range(10)]
    df = spark.createDataFrame(rows, "tp_id string, ntp_id string, sim_wang_avg double, mbl_avg double")
    picks = pf.pairs_rank_assign(df, 3)
    assert picks.groupBy("tp_id").count().where("count <> 3").count() == 0
    assert picks.where("distance > 1").count() < 10


def test_organism_and_blacklist(spark):
    df = spark.createDataFrame([("a", "x", "Human"), ("b", "y", "yeast"), ("c", "z", "human")], "tp_id string, ntp_id string, organism string")
    black = spark.createDataFrame([("z",)], "accession string")
    assert as_set(pf.pairs_prepare(df, ["homo sapiens"], blacklist=black), "tp_id") == {("a",)}
