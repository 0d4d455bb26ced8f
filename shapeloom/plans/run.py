"""A run as a properties file asks for it, from the graph to all files that it leaves.

Under output_file_path, for each mode that is on: stores (Parquet, a folder for each pair of thresholds), Turtle for the default shapes and
each pair, class frequencies, support, statistics in wide and long form, examples, logs of seconds and of sampling.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..operators import shapes, statistics, validation
from ..sources import files, triples, turtle
from ..storage import clear
from .api import KEYS, ShapeSet, profile


def load(spark: SparkSession, path: str, compat_iri_rule: bool = False) -> DataFrame:
    """Triples of a Parquet folder that to_parquet() wrote, a Turtle file, or N-Triples."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return turtle.read(spark, path) if path.endswith(".ttl") else triples.ntriples(spark, path, compat_iri_rule)


def write_outputs(found: ShapeSet, cfg: ProfileConfig, out: str) -> None:
    """All tables and files of a run."""
    files.write_class_frequency(found.class_count, f"{out}/classFrequency.csv")
    files.write_support(found.shape_stats.where("ot IS NOT NULL"), f"{out}/support.csv")
    wide = found.statistics.withColumn("DATASET", F.lit(cfg.dataset_name))
    files.write_separated(wide, f"{out}/{cfg.dataset_name}.csv")
    files.write_separated(statistics.long_form(found.statistics), f"{out}/{cfg.dataset_name}_long.csv")
    for name, table in (("node_shapes", found.pruned_node_shapes), ("property_shapes", found.pruned_property_shapes)):
        table.write.mode("overwrite").partitionBy(*KEYS).parquet(f"{out}/store/{name}")
    found.node_shapes.write.mode("overwrite").parquet(f"{out}/store/default_node_shapes")
    default = shapes.with_sh_node(found.property_shapes, found.node_shapes)
    default.write.mode("overwrite").parquet(f"{out}/store/default_property_shapes")
    turtle.write_file(turtle.blocks(found.node_shapes, default, annotate=cfg.annotate), f"{out}/{cfg.dataset_name}_FULL.ttl")
    pruned = turtle.blocks(found.pruned_node_shapes, found.pruned_property_shapes, KEYS, cfg.annotate)
    for conf, supp in cfg.thresholds:
        mine = pruned.where((F.col("conf_thr") == float(conf)) & (F.col("supp_thr") == int(supp)))
        turtle.write_file(mine, f"{out}/{cfg.dataset_name}_{conf}_{supp}.ttl")
    if found.examples:
        for name in ("properties", "classes"):
            found.examples[name].write.mode("overwrite").parquet(f"{out}/examples/{name}")


def run(spark: SparkSession, properties: str, keep_tables: bool = False) -> list[ShapeSet]:
    """Runs every mode that the text of a properties file turns on, and validation if it names a folder of shapes files."""
    out = []
    for cfg in ProfileConfig.all_from_properties(properties):
        began, where = time.time(), f"{cfg.output_file_path.rstrip('/')}/{cfg.mode}"
        graph = load(spark, cfg.dataset_path, cfg.compat_iri_rule)
        found = profile(graph, cfg)
        write_outputs(found, cfg, where)
        seconds = time.time() - began
        files.append_row(
            spark, f"{cfg.output_file_path.rstrip('/')}/runtime.csv", Dataset=cfg.dataset_name, Method=cfg.mode, SecondTotal=round(seconds, 3),
            MinuteTotal=round(seconds / 60, 3), MaxCard=str(cfg.max_cardinality), DatasetPath=cfg.dataset_path,
        )
        if found.sample is not None:
            files.append_row(
                spark, f"{cfg.output_file_path.rstrip('/')}/sampling.csv", type=cfg.sample_strategy, percentage=float(cfg.sample_pct),
                minThreshold=1, maxThreshold=cfg.sample_max, sampledEntities=found.sample.select("s").distinct().count(),
            )
        if cfg.validation_input_dir:
            validate(spark, graph, cfg.validation_input_dir, f"{where}/validation", cfg.type_predicate)
        out.append(found)
        if not keep_tables:
            clear(spark)
    return out


def validate(spark: SparkSession, graph: DataFrame, shapes_dir: str, out: str, type_predicate: str) -> None:
    """Violations of each shapes file (*.ttl) of a folder, in a folder of its name under out, separated by |."""
    names = spark.read.text(f"{shapes_dir}/*.ttl", wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("text"))
    for r in names.toLocalIterator():  # one shapes file at a time
        table, closed = turtle.shapes_of(spark, turtle.parse(r["text"]))
        found = validation.violations(table, graph, type_predicate, closed)
        name = r["f"].rstrip("/").rsplit("/", 1)[-1].removesuffix(".ttl")
        files.write_separated(
            found.select(
                F.col("source_shape").alias("SourceShape"), F.col("focus_node").alias("FocusNode"), F.col("result_path").alias("ResultPath"),
                F.col("value").alias("Value"), F.col("component").alias("SourceConstraintComponent"), F.col("message").alias("Message"),
            ),
            f"{out}/{name}", "|",
        )


def compare(truth: ShapeSet, sampled: ShapeSet, out: str, cfg: ProfileConfig) -> DataFrame:
    """Precision and recall of a sampled run's shapes against an exact one's, as one row of separated values."""
    nodes = statistics.precision_recall(truth.class_count.select("c"), sampled.shape_stats.select("c"), "NS")
    props = statistics.precision_recall(truth.shape_stats.select("c", "p"), sampled.shape_stats.select("c", "p"), "PS")
    row = nodes.withColumn("_1", F.lit(1)).join(props.withColumn("_1", F.lit(1)), "_1").drop("_1").withColumn("MaxReservoirSize", F.lit(cfg.sample_max)).withColumn("TargetPercentage", F.lit(float(cfg.sample_pct)))
    files.write_separated(row, out)
    return row
