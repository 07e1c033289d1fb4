"""Embedding vectors: layer aggregation, joins to samples, scaling.

Vectors are never exploded into one row per element; sums and moments run in the vector summarizer,
element-wise work in array functions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import l2_unit, normalize_name

Strategy = Callable[[DataFrame], DataFrame]


def _ml(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def _layer_stats(layers: DataFrame, *metrics: str) -> DataFrame:
    """Element-wise statistics per (view, accession), combined map-side."""
    stats = layers.groupBy(F.col("model").alias("view"), "accession").agg(
        Summarizer.metrics(*metrics).summary(_ml("vec")).alias("_s")
    )
    return stats.select("view", "accession", *[vector_to_array(F.col("_s")[m]).alias(m) for m in metrics])


def layers_mean(layers: DataFrame) -> DataFrame:
    """Mean over the layers an accession has; the soft-attention aggregator computes the same."""
    return _layer_stats(layers, "mean").withColumnRenamed("mean", "vec")


def layers_max(layers: DataFrame) -> DataFrame:
    return _layer_stats(layers, "max").withColumnRenamed("max", "vec")


def layers_mean_max(layers: DataFrame) -> DataFrame:
    return _layer_stats(layers, "mean", "max").select("view", "accession", F.concat("mean", "max").alias("vec"))


def layers_concat(layers: DataFrame) -> DataFrame:
    """Concatenation in ascending layer order, over the layers an accession has.

    The layers of one accession, a short list, meet in one hash aggregate and are sorted there; of repeated layers the larger vector counts.
    """
    layer = F.struct(F.col("layer_index").alias("i"), F.col("vec").cast("array<double>").alias("v"))
    held = layers.where("layer_index is not null and vec is not null").groupBy(F.col("model").alias("view"), "accession").agg(F.sort_array(F.collect_list(layer)).alias("_l"))
    last = F.filter("_l", lambda x, i: F.coalesce(F.get("_l", i + 1)["i"] != x["i"], F.lit(True)))
    return held.select("view", "accession", F.flatten(F.transform(last, lambda x: x["v"])).alias("vec"))


def layers_none(layers: DataFrame) -> DataFrame:
    """A model with one layer is one view; otherwise each layer is a view ``model__layer_k``."""
    counts = layers.groupBy("model", "layer_index").agg(F.lit(1).alias("_x")).groupBy("model").agg(
        F.count(F.lit(1)).alias("_layers")
    )
    view = F.when(F.col("_layers") > 1, F.concat_ws("__layer_", "model", F.col("layer_index").cast("string"))).otherwise(
        F.col("model")
    )
    return attach(layers, counts, ["model"], ["_layers"]).select(view.alias("view"), "accession", F.col("vec").cast("array<double>").alias("vec"))


AGGREGATIONS: Mapping[str, Strategy] = {
    "mean": layers_mean, "attention": layers_mean, "max": layers_max,
    "mean_max": layers_mean_max, "concat": layers_concat, "none": layers_none,
}


def aggregate_layers(layers: DataFrame, mode: str) -> DataFrame:
    if mode not in AGGREGATIONS:
        raise ValueError(f"unknown layer aggregation: {mode}")
    return AGGREGATIONS[mode](layers)


def ontology_of(file_name: str) -> str:
    """Ontology code inferred from a file name, else the name itself."""
    low = file_name.lower()
    for code, marks in (("BP", ("_p_", "bp")), ("MF", ("_f_", "mf")), ("CC", ("_c_", "cc"))):
        if any(m in low for m in marks):
            return code
    return low


def go_concat(ontology_vectors: DataFrame, accessions: DataFrame, order_col: str | None = None) -> DataFrame:
    """Per accession the vectors of all ontologies in name order, zero where one is missing.

    Of repeated (ontology, accession) rows the last by ``order_col`` counts.
    """
    width = {r["ontology"]: r["dim"] for r in ontology_vectors.groupBy("ontology").agg(F.max(F.size("vec")).alias("dim")).orderBy("ontology").collect()}
    wanted = ontology_vectors.join(accessions.select("accession"), "accession", "left_semi")
    order = F.col(order_col) if order_col else F.lit(0)
    have = wanted.groupBy("accession").agg(F.collect_list(F.struct("ontology", order.alias("o"), F.col("vec").cast("array<double>").alias("v"))).alias("_l"))

    def part(name: str) -> Column:
        return F.coalesce(F.array_max(F.filter("_l", lambda x: x["ontology"] == F.lit(name)))["v"], F.array_repeat(F.lit(0.0), width[name]))

    parts = [part(name) for name in width]
    return accessions.select("accession").distinct().join(have, "accession", "left").select("accession", F.concat(*parts).alias("vec"))


def go_missing_report(ontology_vectors: DataFrame, accessions: DataFrame) -> DataFrame:
    """(ontology, accession) pairs that are zero-filled by ``go_concat``."""
    names = ontology_vectors.agg(F.collect_set("ontology").alias("_names"))
    every = attach(accessions.select("accession").distinct(), names, (), ["_names"]).select(
        F.explode("_names").alias("ontology"), "accession"
    )
    return every.join(ontology_vectors.select("ontology", "accession"), ["ontology", "accession"], "left_anti")


def _on_views(samples: DataFrame, views: DataFrame) -> DataFrame:
    """Each sample once per view; the list of views is read from the vectors."""
    names = views.select("view").distinct().agg(F.collect_list("view").alias("_views"))
    return attach(samples, names, (), ["_views"]).withColumn("view", F.explode("_views")).drop("_views")


def features_missing_report(samples: DataFrame, views: DataFrame) -> DataFrame:
    """Sample accessions without a vector, per view."""
    return _on_views(samples.select("accession").distinct(), views).join(
        views.select("view", "accession"), ["view", "accession"], "left_anti"
    ).select("view", "accession").orderBy("view", "accession")


def features_join(samples: DataFrame, views: DataFrame, allow_missing: Sequence[str] = ()) -> DataFrame:
    """Attach each view's vector to each sample.

    A view on the allow-list gets zero vectors where one is missing; elsewhere a missing vector is an
    error naming up to ten accessions.
    """
    strict = features_missing_report(samples, views.where(~F.col("view").isin(list(allow_missing))))
    lost = strict.limit(10).collect()
    if lost:
        raise ValueError(f"missing embeddings: {[(r['view'], r['accession']) for r in lost]}")
    joined = _on_views(samples, views).join(
        views.select("view", "accession", F.col("vec").cast("array<double>").alias("vec")), ["view", "accession"], "left"
    )
    if not allow_missing:
        return joined
    dims = views.groupBy("view").agg(F.max(F.size("vec")).alias("_dim")).agg(
        F.map_from_entries(F.collect_list(F.struct("view", "_dim"))).alias("_dims")
    )
    filled = attach(joined, dims, (), ["_dims"])
    zero = F.array_repeat(F.lit(0.0), F.element_at("_dims", F.col("view")))
    return filled.withColumn("vec", F.coalesce("vec", zero)).drop("_dims")


def l2_normalize(df: DataFrame, col: str = "vec") -> DataFrame:
    return df.withColumn(col, l2_unit(F.col(col)))


def fit_scaler(features: DataFrame, fit_split: str = "train") -> DataFrame:
    """(view, mean, std) from one split: population deviation, zero replaced by 1."""
    stats = features.where(F.col("split") == fit_split).groupBy("view").agg(
        Summarizer.metrics("mean", "variance", "count").summary(_ml("vec")).alias("_s")
    )
    n = F.col("_s.count")
    to_std = F.transform(vector_to_array(F.col("_s.variance")), lambda v: F.sqrt(v * (n - 1) / n))
    return stats.select(
        "view", vector_to_array(F.col("_s.mean")).alias("mean"),
        F.transform(to_std, lambda s: F.when(s == 0.0, 1.0).otherwise(s)).alias("std"),
    )


def standard_scale(features: DataFrame, fit_split: str = "train") -> DataFrame:
    """Every split scaled with the statistics of the fitting split."""
    scaler = fit_scaler(features, fit_split)
    centred = F.zip_with("vec", "mean", lambda x, m: x.cast("double") - m)
    return attach(features, scaler, ["view"], ["mean", "std"]).withColumn(
        "vec", F.zip_with(centred, "std", lambda x, s: x / s)
    ).drop("mean", "std")


def layer_sweep(layers: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None,
                aggregates: Sequence[Column] = ()) -> DataFrame:
    """A result per layer: SQL aggregates by layer, or a DataFrame function given the layer as a column."""
    if fn is not None:
        return fn(layers)
    return layers.groupBy("layer_index").agg(*aggregates)


def view_select(df: DataFrame, column: str, names: Sequence[str] | None = None, group: str | None = None,
                groups: Mapping[str, Sequence[str]] | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Keep views or classifiers by name or named group, ignoring case and punctuation."""
    aliases = {"rt": "RF"} if aliases is None else aliases

    def plain(text: str) -> str:
        text = aliases.get("".join(ch for ch in text.lower() if ch.isalnum()), text)
        return "".join(ch for ch in text.lower() if ch.isalnum())

    out = df
    if group is not None:
        if not groups or group not in groups:
            raise ValueError(f"unknown group: {group}")
        out = out.where(normalize_name(F.col(column)).isin([plain(g) for g in groups[group]]))
    if names is not None:
        out = out.where(normalize_name(F.col(column)).isin([plain(n) for n in names]))
    return out


def enabled_views(config_rows: DataFrame) -> DataFrame:
    """Names switched on in any section, sorted."""
    return config_rows.where("enabled").select(F.col("name").alias("view")).distinct().orderBy("view")
