"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range, so that sketches merge by union and texts of
very unequal length can be compared. Only built-in functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import cut_lineage

SHINGLE = 5
SCALE = 2
SPACES = r"[\x20\x09-\x0D]+"


def bound_to(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside array functions."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all word shingles, in order and with repeats.

    Words are lower-cased and parted by ASCII white space; fewer words than a shingle make one; no words (or null) have none.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")

    def hashes(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - shingle, F.lit(0))
        return F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(shingle)))))

    return F.coalesce(bound_to(words, hashes), F.array().cast("array<bigint>"))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes of word shingles that lie in the lowest 1/scale of the range, and no others: a short text may have none."""
    below = F.lit(-(1 << 63) + (1 << 64) // scale - 1)
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(text, shingle), lambda h: h <= below)))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the union of two sketches; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Part of the first sketch found in the second; an empty one is contained in any."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts taken together."""
    return F.array_sort(F.array_union(a, b))


def compared(measure, a: Column, a_text: Column, b: Column, b_text: Column, shingle: int = SHINGLE) -> Column:
    """``measure`` of two sketches; where one is empty, and so tells nothing of its text, of all shingle hashes of both texts."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), measure(a, b)).otherwise(
        bound_to(F.struct(shingle_hashes(a_text, shingle).alias("a"), shingle_hashes(b_text, shingle).alias("b")), lambda s: measure(F.array_distinct(s["a"]), F.array_distinct(s["b"]))))


def _digits(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def printed(hashes: Column, text: Column | None = None, shingle: int = SHINGLE) -> Column:
    """A sketch as text: 16 hex digits a hash, in order. With its text given, an empty sketch is shown as ``-`` and the text's lowest
    hash, which tells short texts apart and is no part of the sketch; a text without words is shown as nothing."""
    shown = F.array_join(F.transform(hashes, _digits), "")
    if text is None:
        return shown
    return F.when(F.size(hashes) > 0, shown).otherwise(F.coalesce(F.concat(F.lit("-"), _digits(F.array_min(shingle_hashes(text, shingle)))), F.lit("")))


def id_buckets(ids: DataFrame) -> tuple[Column, int]:
    """The bucket of a row by its ``id`` (larger ids first, null ids last), and the number of buckets: four to a shuffle partition, cut at
    approximate quantiles, so that following rows are neighbours in a bucket or first and last of two."""
    parts = 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10 * max(1000, parts))).first()[0] or []
    bounds = sorted(set(found), reverse=True)
    held = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    at = bound_to(F.struct(F.col("id").alias("id"), held.alias("bounds")), lambda s: F.size(F.filter(F.transform(s["bounds"], lambda b: b >= s["id"]), lambda x: x)))
    return F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(at), len(bounds) + 2


def document_fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    containments in_edited and in_next.

    The edited text replaces the last third of the code points (rounded down) by the first as many, or all, of the next document in
    descending doc_id; the last document is followed by the first, a single one by itself. Null texts read as empty. Rows of one id follow
    one another in the order of their texts' hashes, so a repeated row is followed by its like; null ids come last. Columns other than
    doc_id and text are not read.

    A text whose sketch is empty is compared by all its shingles (``compared``), so short texts have exact values.

    Whole texts are shuffled once, into buckets of neighbouring ids; what follows the last row of a bucket is fetched for one row a bucket.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bucket, _ = id_buckets(texts.select("id"))
    keyed = texts.select("id", "text", F.xxhash64("text").alias("key"), bucket.alias("bucket"))
    place = F.struct(F.col("bucket"), F.bitwise_not("id").alias("down"), F.col("key"))
    firsts = keyed.groupBy("bucket").agg(F.min(place).alias("first"))
    over = Window.orderBy("bucket")  # one row a bucket
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = cut_lineage(firsts.select("bucket", F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("next")), "follow")
    heads = keyed.withColumn("place", place).join(F.broadcast(follow.select(F.col("next").alias("place"))), "place", "left_semi").dropDuplicates(["place"])
    heads = cut_lineage(follow.join(heads.select(F.col("place").alias("next"), F.col("text").alias("over_text")), "next").select(F.col("bucket").alias("over_bucket"), "over_text"), "heads")

    line = Window.partitionBy("bucket").orderBy(F.col("id").desc(), "key")
    sketched = keyed.repartition("bucket").withColumn("sketch", sketch(F.col("text"), shingle, scale))
    followed = sketched.select("id", "bucket", "text", "sketch", F.lead("text").over(line).alias("inner"), F.lead("sketch").over(line).alias("inner_sketch"))
    joined = followed.join(heads, (F.col("bucket") == F.col("over_bucket")) & F.col("inner").isNull(), "left")
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = joined.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "sketch",
        F.coalesce(F.col("inner_sketch"), sketch(F.col("over_text"), shingle, scale)).alias("next_sketch"), cut.alias("cut"), "text", F.coalesce("inner", "over_text").alias("after"))
    edited = edited.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cut)"), F.expr("substring(after, 1, cut)")))
    edited = edited.withColumn("edited_sketch", sketch(F.col("edited"), shingle, scale))
    own, changed, after_it = (F.col("sketch"), F.col("text")), (F.col("edited_sketch"), F.col("edited")), (F.col("next_sketch"), F.col("after"))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(*own, shingle).alias("fingerprint"), printed(*changed, shingle).alias("edited_fingerprint"),
        compared(likeness, *own, *changed, shingle).alias("near_edited"), compared(likeness, *own, *after_it, shingle).alias("near_next"),
        compared(containment, *own, *changed, shingle).alias("in_edited"), compared(containment, *own, *after_it, shingle).alias("in_next"))
