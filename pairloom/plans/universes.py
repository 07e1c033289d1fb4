"""Universe and variant queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import pair_filters as pf
from pairloom.operators import universe as un
from pairloom.operators import variants as va
from pairloom.operators.splits import split_group_by_target
from pairloom.plans import query
from pairloom.plans.fixtures import UNIVERSE, longs, r6, table, u_sql, universe_pairs


def greedy_sql(neg: int, seed: int = 42, prefer: str | None = None, order: str | None = None, floor_size: int = 5) -> str:
    """The sequential definition as a recursive CTE: one target per step, ``used`` grows along the way."""
    prefer = prefer or f"md5('{seed}:' || target_id || ':' || candidate_id), candidate_id"
    order = order or f"md5('{seed}:' || target_id), target_id"
    return f"""{UNIVERSE},
  pools AS (SELECT target_id, source_row_id, organism, list(candidate_id ORDER BY {prefer}) AS pool, count(*) AS n FROM universe GROUP BY ALL),
  ordered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM pools WHERE n >= {floor_size}),
  steps AS (
    SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS target_id, NULL::VARCHAR AS organism, []::VARCHAR[] AS picks
    UNION ALL
    SELECT i, CASE WHEN len(free) >= {neg} THEN list_concat(used, free[1:{neg}]) ELSE used END, target_id, organism,
      CASE WHEN len(free) >= {neg} THEN free[1:{neg}] ELSE []::VARCHAR[] END
    FROM (SELECT o.i, s.used, o.target_id, o.organism, [c FOR c IN o.pool IF NOT list_contains(s.used, c)] AS free
      FROM steps s JOIN ordered o ON o.i = s.i + 1)),
  assignments AS (SELECT target_id, organism, target_id AS protein_id, 'positive' AS role FROM steps WHERE len(picks) > 0
    UNION ALL SELECT target_id, organism, unnest(picks), 'negative' FROM steps WHERE len(picks) > 0)"""


_POLICY = va.VariantPolicy(ratio="1:3", order="hash")
_SCARCE = va.VariantPolicy(ratio="1:24", order="hash")


@query("universe_normalize", f"WITH {UNIVERSE} SELECT target_id, count(*) AS candidate_count FROM universe GROUP BY target_id")
def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    return un.universe_normalize(un.pool_sizes(universe_pairs(spark, sf)).select("target_id", "candidate_count"))


@query("universe_manifest", f"""WITH {UNIVERSE} SELECT 'u1' AS universe_id, count(DISTINCT target_id) AS record_count, count(DISTINCT target_id) AS target_count,
  count(*) AS total_candidates, '1.0' AS schema_version FROM universe""")
def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return un.universe_manifest(universe_pairs(spark, sf), "u1")


@query("pool_size_distribution", f"""WITH {UNIVERSE} SELECT candidate_count, count(*) AS n FROM (
  SELECT count(*) AS candidate_count FROM universe GROUP BY target_id) GROUP BY 1""")
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return un.pool_size_distribution(universe_pairs(spark, sf))


@query("scarcity_pool", f"""WITH {UNIVERSE}, s AS (SELECT target_id, count(*) AS n FROM universe GROUP BY target_id)
  SELECT target_id, 'insufficient_candidates' AS reason, 'Need 550 candidates, have ' || n AS details FROM s WHERE n < 550""")
def _scarcity(spark: SparkSession, sf: str) -> DataFrame:
    return un.scarcity_pool(universe_pairs(spark, sf), 550)[1]


@query("variant_generate", f"WITH RECURSIVE {greedy_sql(3)} SELECT target_id, protein_id, role FROM assignments")
def _generate(spark: SparkSession, sf: str) -> DataFrame:
    return va.variant_generate(universe_pairs(spark, sf), _POLICY)[0].select("target_id", "protein_id", "role")


@query("variant_generate_scarce", f"WITH RECURSIVE {greedy_sql(24)} SELECT target_id, protein_id, role FROM assignments")
def _generate_scarce(spark: SparkSession, sf: str) -> DataFrame:
    return va.variant_generate(universe_pairs(spark, sf), _SCARCE)[0].select("target_id", "protein_id", "role")


@query("variant_generate_use_all", f"WITH RECURSIVE {greedy_sql(3, prefer='pos', order='source_row_id')} SELECT target_id, protein_id, role FROM assignments")
def _generate_all(spark: SparkSession, sf: str) -> DataFrame:
    policy = va.VariantPolicy(ratio="1:3", selection="use_all", order="source")
    return va.variant_generate(universe_pairs(spark, sf), policy)[0].select("target_id", "protein_id", "role")


_DRAWS = ", ".join(f"list_min([{{'k': md5('42:{i}:' || target_id || ':' || c), 'c': c}} FOR c IN free]).c" for i in range(3))


@query("variant_generate_replacement", f"""WITH RECURSIVE {UNIVERSE},
  pools AS (SELECT target_id, list(DISTINCT candidate_id) AS pool, count(*) AS n FROM universe GROUP BY target_id),
  ordered AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || target_id), target_id) AS i FROM pools WHERE n >= 5),
  steps AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS target_id, []::VARCHAR[] AS picks
    UNION ALL SELECT i, list_concat(used, picks), target_id, picks FROM (SELECT i, used, target_id, CASE WHEN len(free) >= 3 THEN [{_DRAWS}] ELSE []::VARCHAR[] END AS picks
      FROM (SELECT o.i, s.used, o.target_id, [c FOR c IN o.pool IF NOT list_contains(s.used, c)] AS free FROM steps s JOIN ordered o ON o.i = s.i + 1))),
  assignments AS (SELECT target_id, target_id AS protein_id, 'positive' AS role, -1 AS draw FROM steps WHERE len(picks) > 0 UNION ALL SELECT target_id, unnest(picks), 'negative', unnest(range(3)) FROM steps WHERE len(picks) > 0)
  SELECT target_id, protein_id, role, draw FROM assignments""")
def _generate_replacement(spark: SparkSession, sf: str) -> DataFrame:
    policy = va.VariantPolicy(ratio="1:3", selection="sample_with_replacement", order="hash")
    return va.variant_generate(universe_pairs(spark, sf), policy)[0].select("target_id", "protein_id", "role", "draw")


@query("variant_events", f"""WITH RECURSIVE {greedy_sql(24, floor_size=520)}
  SELECT target_id, 'insufficient_candidates' AS reason FROM pools WHERE n < 520
  UNION ALL SELECT target_id, 'insufficient_candidates_for_ratio' FROM steps WHERE target_id IS NOT NULL AND len(picks) = 0""")
def _events(spark: SparkSession, sf: str) -> DataFrame:
    policy = va.VariantPolicy(ratio="1:24", min_pool_size=520, order="hash")
    return va.variant_generate(universe_pairs(spark, sf), policy)[1].select("target_id", "reason")


@query("variant_manifest", f"""WITH RECURSIVE {greedy_sql(24)} SELECT 'variant_000042' AS variant_id,
  count(*) FILTER (WHERE role = 'positive') AS targets_included, (SELECT count(*) FROM pools) - count(*) FILTER (WHERE role = 'positive') AS targets_dropped,
  count(*) FILTER (WHERE role = 'positive') AS total_positive_instances, count(*) FILTER (WHERE role = 'negative') AS total_negative_instances,
  count(*) FILTER (WHERE role = 'positive') || ':' || (count(*) FILTER (WHERE role = 'negative') // count(*) FILTER (WHERE role = 'positive')) AS ratio_realized
  FROM assignments""")
def _variant_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return va.variant_manifest(*va.variant_generate(universe_pairs(spark, sf), _SCARCE))


@query("organism_distribution", f"""WITH RECURSIVE {greedy_sql(3)} SELECT 'variant_000042' AS variant_id, organism, count(*) AS n FROM assignments GROUP BY organism""")
def _organisms(spark: SparkSession, sf: str) -> DataFrame:
    universe = universe_pairs(spark, sf)
    return va.organism_distribution(va.variant_generate(universe, _POLICY)[0], universe)


def _policy_seed(i: int) -> int:
    return int(hashlib.md5(f"p:{i}".encode()).hexdigest()[:8], 16)


@query("variants_multi", " UNION ALL ".join(
    f"""SELECT * FROM (WITH RECURSIVE {greedy_sql(3, seed=_policy_seed(i))} SELECT 'p_variant_{i:04d}' AS variant_id, target_id, protein_id, role FROM assignments)""" for i in range(25)))
def _multi(spark: SparkSession, sf: str) -> DataFrame:
    policy = va.VariantPolicy(ratio="1:3", policy_id="p", order="hash")
    return va.variants_multi(universe_pairs(spark, sf), policy)[0].select("variant_id", "target_id", "protein_id", "role")


@query("variants_ratio_families", " UNION ALL ".join(
    f"""SELECT * FROM (WITH RECURSIVE {greedy_sql(n)} SELECT 'policy_ratio_1_{n}' AS variant_id, target_id, protein_id, role FROM assignments)""" for n in (1, 3, 5)))
def _families(spark: SparkSession, sf: str) -> DataFrame:
    rows = va.variants_ratio_families(universe_pairs(spark, sf), va.VariantPolicy(order="hash"))[0]
    return rows.select("variant_id", "target_id", "protein_id", "role")


@query("bundle_summary", f"""WITH RECURSIVE {greedy_sql(3)}, t AS (SELECT target_id, row_number() OVER (ORDER BY md5('1:' || target_id), target_id) AS k, count(*) OVER () AS n
    FROM (SELECT DISTINCT target_id FROM assignments)),
  placed AS (SELECT a.*, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM assignments a JOIN t ON t.target_id = a.target_id)
  SELECT 'variant_000042' AS variant_id, count(*) AS total_instances, count(*) FILTER (WHERE role = 'positive') AS positive_count,
    count(*) FILTER (WHERE role = 'negative') AS negative_count, count(*) FILTER (WHERE split = 'train') AS train_count,
    count(*) FILTER (WHERE split = 'val') AS val_count, count(*) FILTER (WHERE split = 'test') AS test_count,
    count(*) FILTER (WHERE role = 'positive') AS targets_included, (SELECT count(*) FROM pools) - count(*) FILTER (WHERE role = 'positive') AS targets_dropped,
    count(*) FILTER (WHERE role = 'positive') || ':' || (count(*) FILTER (WHERE role = 'negative') // count(*) FILTER (WHERE role = 'positive')) AS ratio_realized FROM placed""")
def _bundle(spark: SparkSession, sf: str) -> DataFrame:
    rows, events = va.variant_generate(universe_pairs(spark, sf), _POLICY)
    return va.bundle_summary(split_group_by_target(rows, seed=1), events)


@query("variant_distinct_ids", f"""WITH RECURSIVE {greedy_sql(3)} SELECT DISTINCT 'variant_000042' AS variant_id, 'target' AS kind, target_id AS id FROM assignments
  UNION ALL SELECT DISTINCT 'variant_000042', 'protein', protein_id FROM assignments""")
def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return va.variant_distinct_ids(va.variant_generate(universe_pairs(spark, sf), _POLICY)[0])


# -- documented pair-filter stages; lineitem measures stand for the metric columns ------------------

def metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tp_id"), F.col("l_partkey").alias("ntp_id")).agg(
        F.min("l_discount").alias("len_variance"), (F.max("l_quantity") / 50).alias("identity"),
        (F.min("l_quantity") / 50).alias("sim_wang_avg"), F.max("l_tax").alias("mbl_avg"),
    )


METRIC_PAIRS = """metric_pairs AS (SELECT l_suppkey AS tp_id, l_partkey AS ntp_id, min(l_discount) AS len_variance, max(l_quantity) / 50 AS identity,
    min(l_quantity) / 50 AS sim_wang_avg, max(l_tax) AS mbl_avg FROM lineitem GROUP BY 1, 2)"""


@query("pairs_prepare", f"""WITH {METRIC_PAIRS} SELECT p.tp_id, p.ntp_id FROM metric_pairs p JOIN supplier ON s_suppkey = tp_id JOIN nation ON n_nationkey = s_nationkey
  WHERE contains(lower(n_name), '1') AND ntp_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def _prepare(spark: SparkSession, sf: str) -> DataFrame:
    homes = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("tp_id"), F.col("n_name").alias("organism")
    )
    black = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("accession"))
    return pf.pairs_prepare(metric_pairs(spark, sf).join(homes, "tp_id"), ["1"], blacklist=black).select("tp_id", "ntp_id")


@query("pairs_filter_sequence", f"WITH {METRIC_PAIRS} SELECT tp_id, ntp_id FROM metric_pairs WHERE len_variance < 0.05 AND identity < 0.95")
def _sequence(spark: SparkSession, sf: str) -> DataFrame:
    return pf.pairs_filter_sequence(metric_pairs(spark, sf)).select("tp_id", "ntp_id")


@query("targets_without_match", """SELECT DISTINCT l_partkey AS tp_id FROM lineitem EXCEPT
  SELECT l_partkey FROM lineitem WHERE l_discount < 0.005 AND l_quantity / 50 < 0.5""")
def _without(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("tp_id"), F.col("l_discount").alias("len_variance"), (F.col("l_quantity") / 50).alias("identity")
    )
    return pf.targets_without_match(pairs, pf.pairs_filter_sequence(pairs, max_variance=0.005, max_identity=0.5))


@query("pairs_rank_assign", f"""WITH {METRIC_PAIRS}, keyed AS (SELECT *, abs(sim_wang_avg - mbl_avg) AS distance,
    -ln({u_sql("'42:' || tp_id || ':' || ntp_id")} + 0.5::DOUBLE / 4294967296.0::DOUBLE) / exp(-abs(sim_wang_avg - mbl_avg)) AS k FROM metric_pairs)
  SELECT tp_id, ntp_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY tp_id ORDER BY k, ntp_id) AS pick FROM keyed) WHERE pick <= 6""")
def _assign(spark: SparkSession, sf: str) -> DataFrame:
    return r6(pf.pairs_rank_assign(metric_pairs(spark, sf), 6).select("tp_id", "ntp_id", "distance"))


@query("pairs_filter_outlier", f"WITH {METRIC_PAIRS} SELECT tp_id, ntp_id FROM metric_pairs WHERE abs(sim_wang_avg - mbl_avg) <= 0.25")
def _outlier(spark: SparkSession, sf: str) -> DataFrame:
    return pf.pairs_filter_outlier(metric_pairs(spark, sf), 0.25, "sim_wang_avg", "mbl_avg").select("tp_id", "ntp_id")


@query("stage_funnel", """SELECT run_id, unnest(['filter1', 'filter2', 'filter3', 'final']) AS stage,
    unnest([count(*), count(*) FILTER (WHERE l_quantity < 40), count(*) FILTER (WHERE l_quantity < 20), count(*) FILTER (WHERE l_quantity < 5)]) AS "rows"
  FROM (SELECT l_returnflag AS run_id, l_quantity FROM lineitem) GROUP BY run_id""")
def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    meta = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.count(F.lit(1)).alias("filter1_rows"), F.sum((q < 40).cast("long")).alias("filter2_rows"),
        F.sum((q < 20).cast("long")).alias("filter3_rows"), F.sum((q < 5).cast("long")).alias("final_rows"),
    )
    return longs(pf.stage_funnel(meta), "rows")
