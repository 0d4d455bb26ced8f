"""Options of a profiling run."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
P31 = "http://www.wikidata.org/prop/direct/P31"
MODES = ("exact", "sampled", "query_exact", "query_sampled")
#: Fixed: the list of classes within the folder that config_dir_path names.
CLASS_LIST = "pruning/classes.txt"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def parse_thresholds(text: str) -> list[tuple[float, int]]:
    """[(confidence, support)] of a text such as {(0.1,100),(0.25,500)}."""
    out = []
    for inside in re.findall(r"\((.*?)\)", text):
        confidence, support = inside.split(",")
        out.append((float(confidence), int(support)))
    return out


@dataclass(frozen=True)
class ProfileConfig:
    """mode: exact, sampled (by sample_*), or the same two as the modes for endpoints define them (query_exact, query_sampled).

    query_exact counts classes by distinct entities, and a property with any literal value by its literals; query_sampled also counts
    classes so, and gives objects without a class the type undefined. Flags named compat_* choose published quirks over the plain
    meaning. classes_file: a file of class IRIs, one on a line, beside specific_classes.
    """

    mode: str = "exact"
    wikidata: bool = False
    thresholds: tuple[tuple[float, int], ...] = ((0.1, 100),)
    max_cardinality: bool = True
    annotate: bool = True
    sh_not: bool = False
    specific_classes: tuple[str, ...] = ()
    classes_file: str = ""
    sample_strategy: str = "dynamic"
    sample_max: int = 1000
    sample_pct: float = 100
    seed: int = 100
    add_examples: bool = False
    example_namespace: str = "http://example.org/"
    label_properties: tuple[str, ...] = (RDFS_LABEL,)
    strict_cardinality: bool = False
    compat_iri_rule: bool = False
    compat_capacity: bool = False
    mixed_as_literal: bool = False
    dataset_path: str = ""
    dataset_name: str = "graph"
    output_file_path: str = ""
    validation_input_dir: str = ""

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")

    @property
    def type_predicate(self) -> str:
        return P31 if self.wikidata else TYPE

    @classmethod
    def from_properties(cls, lines: str) -> ProfileConfig:
        """From key=value lines; unknown keys are ignored, # starts a comment. Of several modes that are on, the first is taken
        (see all_from_properties)."""
        return cls.all_from_properties(lines)[0]

    @classmethod
    def all_from_properties(cls, lines: str) -> list[ProfileConfig]:
        """A configuration for each mode that is on; exact if none is."""
        found: Mapping[str, str] = dict(
            tuple(x.strip() for x in line.split("=", 1)) for line in lines.splitlines() if "=" in line and line[:1] != "#"
        )
        names = {
            "is_wikidata": "wikidata", "annotateSupportConfidence": "annotate", "validation_with_shNot": "sh_not",
            "entity_sampling_threshold": "sample_max", "entity_sampling_target_percentage": "sample_pct",
            "pruning_thresholds": "thresholds", "example_IRI": "example_namespace",
        }
        kinds, out, on = {f.name: f.type for f in fields(cls)}, {}, []

        def yes(value: str) -> bool:
            return value.lower() == "true"

        for key, value in found.items():
            short = key.partition("_")[2]
            name = names.get(key) or names.get(short) or (short if short in kinds else key)  # some keys have a prefix
            if name == "specific_classes":
                if yes(value):
                    out["classes_file"] = found.get("config_dir_path", "config/") + CLASS_LIST
            elif name == "thresholds":
                out[name] = tuple(parse_thresholds(value))
            elif name == "label_properties":
                out[name] = tuple(x.strip() for x in value.split(",") if x.strip())
            elif name == "mode" or name not in kinds:
                continue
            elif kinds[name] == "bool":
                out[name] = yes(value)
            elif kinds[name] in ("int", "float"):
                out[name] = int(value) if kinds[name] == "int" else float(value)
            else:
                out[name] = value
        switches = {
            "exact_file": "exact", "approximate_file": "sampled", "exact_query_based": "query_exact",
            "approximate_query_based": "query_sampled", "approximate_parallel_query_based": "query_sampled",
        }
        for key, value in found.items():
            mode = switches.get(key.partition("_")[2])
            if mode and yes(value) and mode not in on:
                on.append(mode)
        return [cls(**out, mode=m) for m in on or ["exact"]]
