"""One run from triples to shapes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..operators import examples as X
from ..operators import profile as P
from ..operators import prune, shapes, statistics
from ..operators import sampling as R
from ..sources.files import read_lines
from ..storage import stored

KEYS = ["conf_thr", "supp_thr"]


@dataclass
class ShapeSet:
    """The tables of a run; pruned ones are keyed by conf_thr and supp_thr."""

    class_count: DataFrame
    shape_stats: DataFrame
    node_shapes: DataFrame
    property_shapes: DataFrame
    pruned_stats: DataFrame
    pruned_node_shapes: DataFrame
    pruned_property_shapes: DataFrame
    negative_shapes: DataFrame | None
    statistics: DataFrame
    rejected: DataFrame
    sample: DataFrame | None = None
    examples: dict[str, DataFrame] = field(default_factory=dict)


def profile(triples: DataFrame, config: ProfileConfig | None = None) -> ShapeSet:
    """The shapes of a graph, in any mode. The passes over the graph are run and their tables, as small as the schema, stored; the
    other tables are lazy and made of those."""
    cfg = config or ProfileConfig()
    spark, tp, pairs = triples.sparkSession, cfg.type_predicate, list(cfg.thresholds)
    typed = triples.where(F.col("p") == tp)
    known = stored(P.hashed_types(typed), "types")
    counts = known.groupBy("c").agg(F.count("*").alias("n")) if cfg.mode.startswith("query") else P.class_sizes(known)
    counts = stored(counts, "class-sizes")
    literals = triples.where("o_kind = 'literal'")
    links = triples.where((F.col("o_kind") != "literal") & (F.col("p") != tp))
    sample = None
    if cfg.mode.endswith("sampled"):
        classes = P.types(typed, tp)
        sample = R.sample_entities(classes, counts, cfg.sample_strategy, cfg.sample_max, cfg.sample_pct, cfg.seed, cfg.compat_capacity)
        sample = stored(sample, "sample")
        untyped = P.UNDEFINED if cfg.mode == "query_sampled" else None
        stats = R.sampled_stats(literals, links, sample, known, tp, untyped).join(
            counts.select("c", F.col("n").alias("_n")), "c"
        ).withColumn("n", F.col("_n")).drop("_n")
    else:
        every = links.select(*P.term_hash(F.col("s"), *P.KEY), "p", "o").withColumn("k", F.lit(1).cast("long"))
        props = P.typed_properties(literals, every.unionByName(P.type_links(known, tp)), known)
        stats = stored(P.with_confidence(P.shape_table(props, known), counts), "shape-table")
    if cfg.mode == "query_exact" or cfg.mixed_as_literal:
        stats = P.mixed_literal(stats)
    wanted = [(c,) for c in cfg.specific_classes]
    if wanted or cfg.classes_file:
        listed = spark.createDataFrame(wanted, "c string")
        if cfg.classes_file:
            listed = listed.union(read_lines(spark, cfg.classes_file))
        stats, counts = prune.only_classes(stats, listed), prune.only_classes(counts, listed)
    ones = None
    if cfg.max_cardinality:
        ones = P.strict_max_one(triples, known) if cfg.strict_cardinality else P.max_one_of(stats)
    pruned = prune.prune_positive(stats, pairs, tp)
    nodes = prune.prune_nodes(counts, pairs)
    kept = pruned.join(nodes.select("c", *KEYS), ["c", *KEYS], "left_semi")
    negative = None
    if cfg.sh_not:
        negative = shapes.property_shapes(prune.prune_negative(stats, pairs, tp), None, tp, KEYS, "not")
    pruned_nodes = shapes.node_shapes(nodes, KEYS).drop("support")
    pruned_shapes = shapes.property_shapes(kept, ones, tp, KEYS)
    if negative is not None:
        pruned_shapes = shapes.union_shapes(pruned_shapes, negative)
    positive = pruned_shapes.where("polarity = 'positive'")
    found = statistics.counts(pruned_nodes, positive, KEYS).join(statistics.spreads(positive, KEYS), KEYS, "left")
    out = ShapeSet(
        counts, stats, shapes.node_shapes(counts), shapes.property_shapes(stats, ones, tp), kept, pruned_nodes, pruned_shapes,
        negative, found, prune.rejected_classes(counts), sample,
    )
    if cfg.add_examples:
        nodes = X.example_nodes(P.types(typed, tp) if sample is None else sample.select("s", "c"), seed=cfg.seed)
        nodes = stored(nodes, "example-nodes")
        values = stored(X.example_values(triples, nodes, seed=cfg.seed), "example-values")
        known_labels = stored(X.labels(triples, X.wanted_labels(nodes, values), cfg.label_properties), "example-labels")
        out.examples = {
            "nodes": nodes, "labels": known_labels, "properties": X.property_examples(values, known_labels),
            "classes": X.class_examples(nodes, triples, out.property_shapes, known_labels), "registry": X.registry(nodes, values),
        }
        out.property_shapes = X.with_examples(out.property_shapes, out.examples["properties"])
        out.pruned_property_shapes = X.with_examples(out.pruned_property_shapes, out.examples["properties"])
    return out
