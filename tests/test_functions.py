"""Scalars, ranks and tail probabilities."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import ranks, scalars, special
from pairloom.functions.hashing import pri, uniform
from pairloom.session import shared_dir


def test_dist_rank_equals_row_number(spark, partitions):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {(r["id"]): r["rank"] for r in ranks.dist_rank(df, [F.col("v"), F.col("id")], by=["g"]).collect()}
    for g in "ab":
        ordered = sorted((v, i) for i, x, v in rows if x == g)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))


def test_hashed_rank_is_a_permutation(spark, partitions):
    df = ranks.dist_rank(spark.range(300), [pri(1, F.col("id")), F.col("id")], hashed=True, total_col="n")
    rows = df.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 301)) and {r["n"] for r in rows} == {300}


def test_rank_with_one_hot_value(spark):
    # a third of all rows share one value; ids break the tie, so the buckets still split it
    df = spark.range(3000).withColumn("v", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    bucketed = ranks.with_buckets(df, [F.col("v"), F.col("id")])
    assert bucketed.groupBy("_b").count().agg(F.max("count")).first()[0] < 700
    ranked = ranks.dist_rank(df, [F.col("v"), F.col("id")]).orderBy("v", "id")
    assert [r["rank"] for r in ranked.collect()] == list(range(1, 3001))


@pytest.mark.parametrize("cuts", [(0, 0), (0, 5), (3, 3), (10, 20), (20, 20)])
def test_label_by_cuts(spark, cuts):
    df = spark.range(20)
    out = ranks.label_by_cuts(df, [F.col("id")], lambda n: [F.lit(c) for c in cuts], "part").orderBy("id")
    assert [r["part"] for r in out.collect()] == [(i >= cuts[0]) + (i >= cuts[1]) for i in range(20)]


def test_many_cuts_at_once(spark, partitions):
    df = spark.range(101).withColumn("even", F.col("id") % 2 == 0)
    orders = [([pri(seed, F.col("id")), F.col("id")], sizes, cond) for seed, sizes, cond in (
        (1, lambda n: [F.floor(n * 0.3)], F.lit(True)), (2, lambda n: [F.floor(n * 0.1), F.floor(n * 0.5)], F.col("even")), (3, lambda n: [F.lit(0)], F.lit(True)))]
    got = ranks.label_by_many(df, [(f"p{i}", *spec) for i, spec in enumerate(orders)]).collect()
    for i, (order, sizes, cond) in enumerate(orders):
        alone = ranks.label_by_cuts(df.where(cond), order, sizes, "p", hashed=True).collect()
        assert {r["id"]: r[f"p{i}"] for r in got if r[f"p{i}"] is not None} == {r["id"]: r["p"] for r in alone}
    assert sum(r["p1"] is None for r in got) == 50 and [sum(r["p0"] == 0 for r in got), sum(r["p2"] == 0 for r in got)] == [30, 0]


def test_prefix_sums(spark, partitions):
    df = spark.createDataFrame([(g, i, (i * 7) % 5) for g in "xy" for i in range(100)], "g string, i int, v long")
    for r in ranks.prefix_sums(df, [F.col("i")], ["v"], ["g"]).collect():
        assert r["v_before"] == sum((j * 7) % 5 for j in range(r["i"])) and r["v_all"] == 200


def test_coerce_vector_forms(spark):
    raw = np.array([0.1, 0.2, 0.3], dtype="<f4")
    df = spark.createDataFrame([(bytearray(raw.tobytes()), "[0.1, 0.2,0.3]", [0.1, 0.2, 0.3], "")], "b binary, t string, a array<double>, e string")
    row = df.select(
        scalars.coerce_vector(F.col("b"), T.BinaryType()).alias("b"), scalars.coerce_vector(F.col("t"), T.StringType()).alias("t"),
        scalars.coerce_vector(F.col("a"), T.ArrayType(T.DoubleType())).alias("a"), scalars.coerce_vector(F.col("e"), T.StringType()).alias("e"),
    ).first()
    assert row["b"] == row["t"] == row["a"] and np.allclose(row["a"], [0.1, 0.2, 0.3]) and row["e"] == []


def test_binary_labels(spark):
    cases = {"1": 1, "True": 1, " nmf ": 1, "mf": 0, "0.0": 0, "NEG": 0, "2": None, "": None, "maybe": None, "1.0": 1}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want int")
    for r in df.withColumn("got", scalars.coerce_binary_label(F.col("s"))).collect():
        assert r["got"] == r["want"], r["s"]
    typed = spark.createDataFrame([(True, 1.0, 0)], "a boolean, b double, c int").select(*[scalars.coerce_binary_label(F.col(c)) for c in "abc"])
    assert tuple(typed.first()) == (1, 1, 0)


def test_l2_keeps_zero_rows(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vec array<double>")
    assert [list(r[0]) for r in df.select(scalars.l2_unit(F.col("vec"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_uniform_range(spark):
    low, high, mean = spark.range(2000).select(uniform(3, F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03


def test_tail_probabilities():
    assert math.isclose(special.chi2_sf(9.0, 3), 0.029290886534888, rel_tol=1e-9)
    assert math.isclose(special.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.studentized_range_ppf(0.95, 3), 3.314493, rel_tol=1e-5)
    assert math.isclose(special.studentized_range_ppf(0.95, 10), 4.474124, rel_tol=1e-5)
    assert special.studentized_range_sf(0.0, 4) == 1.0


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
