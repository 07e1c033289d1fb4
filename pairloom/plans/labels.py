"""Label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.scalars import coerce_binary_label, coerce_label_token, serialize_label
from pairloom.operators import labels as lb
from pairloom.operators.splits import split_random
from pairloom.plans import query
from pairloom.plans.fixtures import LABEL_ROWS, PROTEINS, label_rows, longs, proteins, table


@query("labels_from_file", """WITH cells AS (SELECT user_id % 97 AS a, event_id, event_type FROM events)
  SELECT accession, event_id AS pos, event_type AS label FROM (
    SELECT event_id, event_type, trim(unnest(string_split(replace('U' || a || '; V' || a || ' ,', ',', ';'), ';'))) AS accession FROM cells)
  WHERE accession <> ''""")
def _from_file(spark: SparkSession, sf: str) -> DataFrame:
    a = (F.col("user_id") % 97).cast("string")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("U"), a, F.lit("; V"), a, F.lit(" ,")).alias("accession"), F.col("event_type").alias("label"), "event_id"
    )
    return lb.labels_from_file(rows, order_col="event_id")


def user_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of a user as its labels, in event order; every fifth user has one label for all its events."""
    label = F.when(F.col("user_id") % 5 == 0, "click").otherwise(F.col("event_type"))
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("accession"), F.col("event_id").alias("pos"), label.alias("label"))
    return lb.labels_collapse(rows)


USER_LABELS = """user_first AS (SELECT user_id::VARCHAR AS accession, CASE WHEN user_id % 5 = 0 THEN 'click' ELSE event_type END AS label, min(event_id) AS pos FROM events GROUP BY 1, 2),
  user_labels AS (SELECT accession, list(label ORDER BY pos) AS labels FROM user_first GROUP BY accession)"""


@query("labels_collapse", f"WITH {USER_LABELS} SELECT accession, array_to_string(labels, '|') AS labels, len(labels)::BIGINT AS n FROM user_labels")
def _collapse(spark: SparkSession, sf: str) -> DataFrame:
    return user_labels(spark, sf).select(
        "accession", F.array_join("labels", "|").alias("labels"), F.size("labels").cast("long").alias("n")
    )


@query("labels_from_query", "SELECT user_id AS accession, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id")
def _from_query(spark: SparkSession, sf: str) -> DataFrame:
    return lb.labels_from_query(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("labels_align", f"WITH {PROTEINS}, {LABEL_ROWS} SELECT * FROM label_rows WHERE accession IN (SELECT accession FROM proteins)")
def _align(spark: SparkSession, sf: str) -> DataFrame:
    return lb.labels_align(label_rows(spark, sf), proteins(spark, sf))


@query("labels_missing_report", f"""WITH {PROTEINS}, {LABEL_ROWS}
  SELECT DISTINCT accession FROM label_rows WHERE accession NOT IN (SELECT accession FROM proteins) ORDER BY 1""")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    return lb.labels_missing_report(label_rows(spark, sf), proteins(spark, sf))


@query("problem_type", f"""WITH {USER_LABELS}
  SELECT 'users' AS source, 'multilabel' AS problem_type, string_agg(DISTINCT label, '|' ORDER BY label) AS classes,
    count(DISTINCT label)::BIGINT AS output_size, 'BCEWithLogitsLoss' AS loss FROM user_first
  UNION ALL SELECT 'quality', 'binary', string_agg(DISTINCT quality::VARCHAR, '|' ORDER BY quality::VARCHAR), count(DISTINCT quality)::BIGINT, 'BCEWithLogitsLoss' FROM labels
  UNION ALL SELECT 'lang', 'multiclass', string_agg(DISTINCT lang, '|' ORDER BY lang), count(DISTINCT lang)::BIGINT, 'CrossEntropyLoss' FROM documents""")
def _problem(spark: SparkSession, sf: str) -> DataFrame:
    quality = table(spark, sf, "labels").select(F.array(F.col("quality").cast("string")).alias("labels"))
    lang = table(spark, sf, "documents").select(F.array("lang").alias("labels"))
    parts = [
        lb.problem_type(rows).select(
            F.lit(name).alias("source"), "problem_type", F.array_join("classes", "|").alias("classes"),
            F.col("output_size").cast("long").alias("output_size"), "loss",
        )
        for name, rows in (("users", user_labels(spark, sf)), ("quality", quality), ("lang", lang))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EVENT_CLASSES = ("click", "purchase", "signup", "view")


@query("multilabel_binarize", f"""WITH {USER_LABELS} SELECT accession, array_to_string(
    [list_contains(labels, c)::INTEGER FOR c IN ['click', 'purchase', 'signup', 'view']], '') AS y FROM user_labels""")
def _binarize(spark: SparkSession, sf: str) -> DataFrame:
    return lb.multilabel_binarize(user_labels(spark, sf), "labels", EVENT_CLASSES).select(
        "accession", F.array_join(F.col("y").cast("array<string>"), "").alias("y")
    )


@query("label_encode", """SELECT d.doc_id, c.i AS label_index FROM documents d JOIN (
    SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang FROM documents)) c ON c.lang = d.lang""")
def _encode(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return longs(lb.label_encode(docs, "lang", lb.class_list(docs, "lang")).select("doc_id", "label_index"), "label_index")


@query("labels_decode", """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN (vec_id % 5)::VARCHAR
    ELSE ['a', 'b', 'c'][(vec_id % 3 + 1)::INTEGER] END AS predicted_label FROM embeddings""")
def _decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 2).alias("model"),
        F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 5).otherwise(F.col("vec_id") % 3).cast("int").alias("i"),
    )
    return lb.labels_decode(rows, "i", ["a", "b", "c"], by=["model"]).select("vec_id", "predicted_label")


_SPELLINGS = ["TRUE", " yes", "nmf", "Positive", "0.0", "1.0", "mf", "neg ", "False", "2", "", "what", "1", "t", "3.0", "-7", "1e2"]
_SPELL_SQL = "[" + ", ".join(f"'{s}'" for s in _SPELLINGS) + "]"


def spelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("event_id") % len(_SPELLINGS) + 1).cast("int")).alias("s")
    )


SPELLED = f"spelled AS (SELECT event_id, {_SPELL_SQL}[(event_id % {len(_SPELLINGS)} + 1)::INTEGER] AS s FROM events)"


@query("coerce_binary_label", f"""WITH {SPELLED} SELECT event_id, CASE
    WHEN lower(trim(s)) IN ('1','true','t','yes','y','positive','pos','nmf') THEN 1
    WHEN lower(trim(s)) IN ('0','false','f','no','n','negative','neg','mf') THEN 0
    WHEN try_cast(trim(s) AS DOUBLE) = 1 THEN 1 WHEN try_cast(trim(s) AS DOUBLE) = 0 THEN 0 END::BIGINT AS label FROM spelled""")
def _coerce_binary(spark: SparkSession, sf: str) -> DataFrame:
    return spelled(spark, sf).select("event_id", coerce_binary_label(F.col("s")).cast("long").alias("label"))


@query("coerce_label_token", f"""WITH {SPELLED} SELECT event_id, CASE WHEN trim(s) = '' THEN NULL
    WHEN lower(trim(s)) IN ('true','t','yes','y') THEN '1' WHEN lower(trim(s)) IN ('false','f','no','n') THEN '0'
    WHEN try_cast(trim(s) AS DOUBLE) = floor(try_cast(trim(s) AS DOUBLE)) THEN try_cast(trim(s) AS DOUBLE)::BIGINT::VARCHAR
    ELSE trim(s) END AS label FROM spelled""")
def _coerce_token(spark: SparkSession, sf: str) -> DataFrame:
    return spelled(spark, sf).select("event_id", coerce_label_token(F.col("s")).alias("label"))


@query("serialize_label", f"""WITH {USER_LABELS} SELECT accession, CASE WHEN len(labels) > 1 THEN '["' || array_to_string(labels, '","') || '"]'
    ELSE labels[1] END AS label FROM user_labels""")
def _serialize(spark: SparkSession, sf: str) -> DataFrame:
    return user_labels(spark, sf).select("accession", serialize_label(F.col("labels")).alias("label"))


@query("class_distribution", f"""WITH {PROTEINS}, r AS (SELECT p.accession, organism, row_number() OVER (ORDER BY md5('42:' || p.accession), p.accession) AS k,
    count(*) OVER () AS n FROM proteins p)
  SELECT CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' WHEN k <= floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split,
    organism AS label, count(*) AS n FROM r GROUP BY ALL""")
def _distribution(spark: SparkSession, sf: str) -> DataFrame:
    samples = split_random(proteins(spark, sf)).withColumnRenamed("organism", "label")
    return lb.class_distribution(samples)
