"""Quirks and definitions of the profile on a graph of eleven triples."""

import pytest
from pyspark.sql import functions as F

from shapeloom.config import TYPE, ProfileConfig, parse_thresholds
from shapeloom.functions.terms import LANG_STRING, UNDEFINED, XSD_STRING
from shapeloom.operators import profile as P
from shapeloom.operators import prune, sampling, shapes, statistics, taxonomy
from shapeloom.plans import patterns
from shapeloom.plans.api import profile
from shapeloom.sources import files
from shapeloom.sources import triples as T

E = "http://e.org/"
LINES = f"""
<{E}bob> <{TYPE}> <{E}Person> .
<{E}bob> <{TYPE}> <{E}Person> .
<{E}bob> <{TYPE}> <{E}Student> .
<{E}bob> <{E}name> "Bob" .
<{E}bob> <{E}knows> <{E}alice> .
<{E}bob> <{E}livesIn> <{E}aalborg> .
<{E}alice> <{TYPE}> <{E}Person> .
<{E}alice> <{E}name> "Ali\\"ce"@en .
<{E}alice> <{E}knows> <{E}carl> .
<{E}aalborg> <{TYPE}> <{E}City> .
<{E}aalborg> <{TYPE}> <{E}Capital> .
not a triple
# a comment
""".strip().splitlines()


@pytest.fixture(scope="module")
def graph(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    return T.parse_lines(lines).where("s IS NOT NULL").select(*T.COLUMNS).persist()


@pytest.fixture(scope="module")
def stats(graph):
    return P.profile_table(graph)


def rows(df, *columns):
    return {tuple(x.replace(E, "") if isinstance(x, str) else x for x in r) for r in df.select(*columns).collect()}


def test_counts_keep_repeated_type_triples(graph):
    assert ("Person", 3) in rows(P.class_count(graph), "c", "n")
    assert ("Person", 2) in rows(P.class_count_distinct(graph), "c", "n")


def test_stats_of_the_small_graph(stats):
    found = rows(stats, "c", "p", "ot", "support", "n")
    assert len(found) == 14
    for row in (
        ("Person", "knows", "Person", 1, 3), ("Person", "knows", UNDEFINED, 1, 3), ("Person", "livesIn", "Capital", 1, 3),
        ("Person", "name", LANG_STRING, 1, 3), ("Person", "name", XSD_STRING, 1, 3), ("Person", TYPE, UNDEFINED, 2, 3),
        ("Student", "livesIn", "City", 1, 1),
    ):
        assert row in found


def test_cardinalities(graph, stats):
    ones = rows(P.max_one_of(stats), "p", "c")
    assert ones == {("knows", "Person"), ("knows", "Student"), ("name", "Person"), ("name", "Student"), (TYPE, "Person")}
    known = P.hashed_types(graph.where(F.col("p") == TYPE))
    strict = rows(P.strict_max_one(graph, known), "p", "c")
    assert ("livesIn", "Person") in strict and (TYPE, "Person") not in strict
    least = rows(P.min_count_one(stats), "c", "p")
    assert {p for c, p in least if c == "Student"} >= {"knows", "livesIn", "name"}
    assert not [p for c, p in least if c == "Person" and p != TYPE]


def test_pruning_is_strict_but_for_support_one(stats):
    def kept(c, s):
        return rows(prune.prune_positive(stats, [(c, s)]), "c", "p", "ot")

    assert ("Person", TYPE, UNDEFINED) in kept(0.99, 1000)
    assert ("Student", "knows", "Person") in kept(0.5, 1)
    assert ("Student", "knows", "Person") not in kept(1.0, 1)
    assert kept(0.5, 1) <= kept(0.1, 1) <= kept(0.0, 0)
    assert not rows(prune.prune_negative(stats, [(0.5, 1)]), "c")
    assert ("Person", "knows", "Person") in rows(prune.prune_negative(stats, [(0.5, 2)]), "c", "p", "ot")


def test_shapes(graph, stats):
    found = shapes.property_shapes(stats)
    kinds = {(c, p): k for c, p, k in rows(found, "c", "p", "kind")}
    assert kinds["Person", "knows"] == "or" and kinds["Student", "knows"] == "single" and kinds["Person", TYPE] == "in"
    nodes = shapes.node_shapes(P.class_count(graph))
    links = rows(shapes.sh_node_links(found, nodes), "class", "node")
    assert ("Person", "http://shaclshapes.org/PersonShape") in links
    twins = shapes.property_names(stats.sparkSession.createDataFrame([("c:/A", "x:/a#p"), ("c:/A", "x:/b#p")], "c string, p string"))
    assert {r.name for r in twins.collect()} == {"http://shaclshapes.org/pAShapeProperty", "http://shaclshapes.org/p_1AShapeProperty"}


def test_lines_round_trip_and_bad_lines(spark, graph, tmp_path):
    back = T.parse_lines(T.to_lines(graph)).select(*T.COLUMNS)
    assert sorted(map(str, back.collect())) == sorted(map(str, graph.collect()))
    (tmp_path / "g.nt").write_text("\n".join(LINES))
    assert [r.value for r in T.bad_lines(spark, str(tmp_path / "g.nt")).collect()] == ["not a triple"]
    odd = spark.createDataFrame([('<a:s> <a:p> "x: y" .',), ("_:b <a:p> _:c .",)], "value string")
    assert [r.o_kind for r in T.parse_lines(odd).collect()] == ["literal", "bnode"]
    assert [r.o_kind for r in T.parse_lines(odd, True).collect()] == ["iri", "iri"]


def test_terms_of_any_length_and_all_escapes(spark):
    n = 1_000_000
    lines = [
        f'<a:s> <a:p> "{"x" * n}"@en .', f'<a:s> <a:p> "{chr(92) + "t"}{(chr(92) + chr(34)) * n}" .',
        r'<a:\u00e9> <a:p> "\u00e9\U0001F600\uD83D\uDE00\b\f\'\"\\n\n"^^<a:t> .',
    ]
    got = T.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (len(got[0].o), got[0].o_lang) == (n, "en") and got[1].o == "\t" + '"' * n
    assert got[2].s == "a:\u00e9" and got[2].o == "\u00e9\U0001F600\U0001F600\b\f'\"\\n\n"


def test_capacity_by_brute_force(spark):
    def brute(n, pct, largest):
        fill, cap = 0, 1
        for k in range(1, n + 1):
            fill += fill < cap
            if fill * pct < largest and fill * 100 / k <= pct:
                cap = fill * pct
        return cap

    cases = [(n, pct, largest) for n in (1, 2, 7, 60, 999, 5000) for pct in (1, 2, 25, 75, 100) for largest in (1, 100, 500, 1000)]
    for pct, largest in {(p, m) for _, p, m in cases}:
        counts = spark.createDataFrame([(str(n), n) for n, p, m in cases if (p, m) == (pct, largest)], "c string, n long")
        for r in sampling.capacity(counts, largest, pct, True).collect():
            assert r.cap == brute(int(r.c), pct, largest), (r, pct, largest)
    assert sampling.capacity(spark.createDataFrame([("c", 10**12)], "c string, n long"), 1000, 100, True).first().cap == 900


def test_full_sample_is_the_exact_profile(graph, stats):
    known = P.hashed_types(graph.where(F.col("p") == TYPE))
    every = sampling.reservoir(P.types(graph), 1000)
    others = graph.where(F.col("p") != TYPE)
    table = sampling.sampled_stats(others.where("o_kind = 'literal'"), others.where("o_kind <> 'literal'"), every, known, TYPE)
    found = rows(table.where("ot IS NOT NULL"), "c", "p", "ot", "support")
    exact = rows(stats.where((F.col("p") != TYPE) & (F.col("ot") != UNDEFINED)), "c", "p", "ot", "support")
    assert found == exact


def test_dictionary_and_taxonomy_reader(spark, graph):
    known = T.dictionary(graph)
    back = T.decode(T.encode(graph, known), known)
    assert sorted(map(str, back.collect())) == sorted(map(str, graph.collect()))
    lines = ["<a:b> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <a:c> .", '<a:b> <http://yago.com/noi> "7"^^<x:integer> .', '<a:c> <http://yago.com/noi> "many" .']
    edges, counts = T.taxonomy(T.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).select(*T.COLUMNS))
    assert rows(edges, "child", "parent") == {("a:b", "a:c")} and rows(counts, "c", "n") == {("a:b", 7)}


def test_a_properties_file_runs_to_all_outputs(spark, tmp_path):
    import glob

    from shapeloom.plans import run

    (tmp_path / "g.nt").write_text("\n".join(LINES))
    (tmp_path / "shapes").mkdir()
    (tmp_path / "shapes" / "one.ttl").write_text(
        f"@prefix sh: <http://www.w3.org/ns/shacl#> . <{E}S> a sh:NodeShape ; sh:targetClass <{E}Person> ; sh:property [ sh:path <{E}livesIn> ; sh:minCount 1 ] ."
    )
    (tmp_path / "pruning").mkdir()
    (tmp_path / "pruning" / "classes.txt").write_text(f"{E}Person\n{E}City\n")
    text = (
        f"x_exact_file=true\nx_approximate_file=true\nx_exact_query_based=true\nx_specific_classes=true\nconfig_dir_path={tmp_path}/\n"
        f"dataset_path={tmp_path}/g.nt\ndataset_name=small\noutput_file_path={tmp_path}/out\nvalidation_input_dir={tmp_path}/shapes\n"
        "pruning_thresholds={(0.1,1),(0.9,1)}\nx_validation_with_shNot=true\nadd_examples=true\nmax_cardinality=true\nentity_sampling_threshold=10"
    )
    found = run.run(spark, text, keep_tables=True)
    assert [x.class_count.count() for x in found] == [2, 2, 2]
    by_mode = {m: {r.Class.replace(E, ""): int(r.Frequency) for r in spark.read.csv(f"{tmp_path}/out/{m}/classFrequency.csv", header=True).collect()} for m in ("exact", "query_exact")}
    assert by_mode == {"exact": {"Person": 3, "City": 1}, "query_exact": {"Person": 2, "City": 1}}
    assert spark.read.csv(f"{tmp_path}/out/exact/small.csv", header=True).count() == 2
    assert spark.read.csv(f"{tmp_path}/out/exact/validation/one", header=True, sep="|").first().FocusNode == f"{E}alice"
    assert spark.read.csv(f"{tmp_path}/out/runtime.csv", header=True).count() == 3 and spark.read.csv(f"{tmp_path}/out/sampling.csv", header=True).count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/exact/store/property_shapes").where("conf_thr = 0.9").count()
    assert any("sh:targetClass" in open(f).read() for f in glob.glob(f"{tmp_path}/out/exact/small_FULL.ttl/part*"))
    support = files.read_separated(spark, f"{tmp_path}/out/exact/support.csv")
    assert support.count() == found[0].shape_stats.count()
    row = run.compare(found[0], found[1], f"{tmp_path}/out/pr.csv", ProfileConfig()).first()
    assert row.NS_truth == 2 and 0 <= row.recall_PS <= 1
    with pytest.raises(ValueError):
        ProfileConfig(mode="other")


def test_patterns_refuse_what_they_cannot_do(graph):
    assert patterns.ask(graph, f"ASK {{ ?x a <{E}City> . ?y <{E}livesIn> ?x }}") and not patterns.ask(graph, f"ASK {{ ?x a <{E}Town> }}")
    for text in ("SELECT ?a WHERE { ?a ?b ?c . ?d ?e ?f }", "DELETE { ?a ?b ?c }", "SELECT ?a WHERE { ?a x:y ?c }"):
        with pytest.raises(ValueError):
            patterns.select(graph, text)


def test_profile_runs_in_all_modes(graph):
    for mode in ("exact", "sampled", "query_exact", "query_sampled"):
        out = profile(graph, ProfileConfig(mode=mode, thresholds=((0.1, 1), (0.9, 1)), sh_not=True, add_examples=True))
        assert out.property_shapes.count() and out.statistics.count() == 2 and out.examples["classes"].count()


def test_precision_and_recall(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "c string") for s in ("abcd", "abx"))
    r = statistics.precision_recall(a, b, "NS").first()
    assert (r.precision_NS, r.recall_NS) == (0.67, 0.5)


def test_taxonomy_counts_a_descendant_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "child string, parent string")
    counts = spark.createDataFrame([("a", 5), ("b", 1), ("d", 2)], "c string, n long")
    assert rows(taxonomy.roll_up(edges, counts), "c", "total") == {("a", 5), ("b", 6), ("c", 5), ("d", 8)}


def test_options():
    assert parse_thresholds("{(0.1,100),(0.25,500)}") == [(0.1, 100), (0.25, 500)]
    cfg = ProfileConfig.from_properties("is_wikidata=true\npruning_thresholds={(0.5,1)}\n#x=1\nlabel_properties=a, b")
    assert cfg.wikidata and cfg.thresholds == ((0.5, 1),) and cfg.label_properties == ("a", "b")
