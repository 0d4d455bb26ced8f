"""Validation of a small library against shapes written by hand, Turtle out and in, and counts over a stream."""

import pytest
from pyspark.sql import functions as F

from shapeloom.config import TYPE
from shapeloom.functions.terms import XSD, XSD_STRING
from shapeloom.operators import profile as P
from shapeloom.operators import shapes, validation
from shapeloom.sources import triples as T
from shapeloom.sources import turtle

L = "http://lib.org/"
SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix l: <http://lib.org/> .
l:LoanShape a sh:NodeShape ; sh:targetClass l:Loan ;
  sh:property [ sh:path l:copy ; sh:minCount 1 ; sh:maxCount 1 ; sh:node l:CopyShape ] ,
              [ sh:path l:lent ; sh:lessThan l:due ] ,
              [ sh:path l:state ; sh:in ( "out" l:lost 3 ) ] .
l:CopyShape a sh:NodeShape ; sh:closed true ; sh:ignoredProperties ( l:note ) ;
  sh:property [ sh:path l:pages ; sh:datatype xsd:short ; sh:minInclusive 1 ; sh:maxInclusive 900 ] ,
              [ sh:path l:shelf ; sh:or ( [ sh:datatype xsd:integer ] [ sh:class l:Room ] ) ] ,
              [ sh:path l:of ; sh:nodeKind sh:IRI ; sh:node l:WorkShape ] ,
              [ sh:path l:first ; sh:lessThan l:last ] ; sh:property [ sh:path l:last ] .
l:WorkShape a sh:NodeShape ; sh:property [ sh:path l:isbn ; sh:minCount 1 ] , [ sh:path l:partOf ; sh:node l:WorkShape ] .
"""
DATA = r"""
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix l: <http://lib.org/> .
l:n1 a l:Loan ; l:copy l:c1 ; l:lent "2024-03-01T23:00:00-05:00"^^xsd:dateTime ; l:due "2024-03-02"^^xsd:date ; l:state "out" .
l:n2 a l:Loan ; l:copy l:c2 ; l:state l:lost , "lost" , 3 , "3" .
l:n3 a l:Loan ; l:lent "2024-01-01"^^xsd:date ; l:due "2024-02-01"^^xsd:date .
l:n4 a l:Loan ; l:copy l:c3 , l:c4 .
l:n5 a l:Loan ; l:copy l:c5 .
l:c1 l:pages "120"^^xsd:short ; l:shelf 4 ; l:of l:w1 ; l:first 1 ; l:last 2 ; l:note "a\u00e9\U0001F600\tb" .
l:c2 l:pages "99999"^^xsd:short ; l:shelf l:r1 ; l:of l:w1 .
l:c3 l:shelf l:w1 ; l:of l:w1 .
l:c4 l:of l:w2 ; l:colour "red" .
l:c5 l:of l:w3 .
l:r1 a l:Room .
l:w1 l:isbn "1" .
l:w2 l:isbn "2" .
l:w3 l:isbn "3" ; l:partOf l:w4 .
l:w4 l:isbn "4" ; l:partOf l:w5 .
l:w5 l:partOf l:w3 .
"""


def of(df):
    return {(r.focus_node.removeprefix(L), r.result_path.removeprefix(L), r.component, (r.value or "").removeprefix(L)) for r in df.collect()}


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(turtle.parse(DATA), turtle.SCHEMA)


def test_handwritten_shapes(spark, data):
    table, closed = turtle.shapes_of(spark, turtle.parse(SHAPES))
    assert closed.count() == 1
    found = of(validation.violations(table, data, closed=closed))
    assert found == {
        ("n3", "copy", "minCount", ""), ("n4", "copy", "maxCount", ""),
        ("n1", "lent", "lessThan", "2024-03-01T23:00:00-05:00"),  # 4 o'clock on the next day, after midnight
        ("n2", "state", "in", "lost"), ("n2", "state", "in", "3"),  # the texts, not the IRI and the number
        ("n2", "copy", "node", "c2"),  # no such short
        ("n4", "copy", "node", "c3"),  # shelf is neither a number nor a room
        ("n4", "copy", "node", "c4"),  # closed
        ("n5", "copy", "node", "c5"),  # w5, part of a circle, has no isbn
    }


def test_well_formed(spark):
    cases = {
        "integer": (["1", "-07"], ["1.0", "", "x"]), "byte": (["127"], ["128"]), "unsignedLong": ([str(2**64 - 1)], ["-1", str(2**64)]),
        "decimal": (["1.", ".5"], ["1e3"]), "double": (["1e3", "INF"], ["one"]), "boolean": (["true", "0"], ["yes"]),
        "date": (["2024-01-01Z"], ["2024-1-1"]), "other": (["whatever"], []),
    }
    rows = [(x, f"<{XSD}{k}>", good) for k, both in cases.items() for good, xs in zip((True, False), both) for x in xs]
    table = spark.createDataFrame(rows, "v string, d string, good boolean")
    assert table.where(validation.well_formed(F.col("v"), F.col("d")) != F.col("good")).count() == 0


def test_mined_shapes_hold_on_their_own_data(spark, data):
    stats = P.profile_table(data).where(f"p <> '{TYPE}'")
    mined = shapes.with_sh_node(shapes.property_shapes(stats), shapes.node_shapes(P.class_count(data)))
    text = turtle.text_of(turtle.blocks(shapes.node_shapes(P.class_count(data)), mined.drop("node")))
    back, _ = turtle.shapes_of(spark, turtle.parse(text))
    assert {r.path for r in back.collect()} == {r.path for r in mined.collect()}
    # a property whose only type is undefined is asked of all, whatever its support
    assert of(validation.violations(back, data)) == {("n3", "copy", "minCount", "")}
    negative = stats.selectExpr("'n' AS shape", "c AS target_class", "p AS path", "ot", "support", "confidence").where(
        f"path LIKE '%state' AND ot = '{XSD_STRING}'"
    )
    assert {r.focus_node for r in validation.not_violations(negative, data).collect()} == {L + "n1", L + "n2"}


def test_negative_shapes_and_unions(data):
    stats = P.profile_table(data)
    good = shapes.property_shapes(stats)
    bad = shapes.property_shapes(stats.where("confidence < 0.5"), polarity="not")
    both = shapes.union_shapes(good, bad, good)
    assert both.count() == good.count() + bad.count() == both.select("name").distinct().count()
    text = turtle.text_of(turtle.blocks(shapes.node_shapes(P.class_count(data)), bad))
    assert "sh:not [ " in text and "_PS_NotShape>" in text


def test_turtle_files_are_read_in_tasks(spark, tmp_path, data):
    (tmp_path / "a.ttl").write_text(DATA)
    (tmp_path / "b.ttl").write_text("@prefix l: <http://lib.org/> . l:x l:y [ l:z 1 ] .")
    back = turtle.read(spark, str(tmp_path))
    assert back.where(F.col("s") != L + "x").where(~F.col("s").startswith("_:")).count() == data.count()
    assert back.where(F.col("p") == L + "note").first().o == "a\u00e9\U0001F600\tb"
    assert back.where(F.col("p") == L + "y").first().o == back.where(F.col("p") == L + "z").first().s


def test_streaming_counts(spark, tmp_path, data):
    from shapeloom.streaming.incremental import keep_counts, stream_class_count, stream_support

    data = data.select(*T.COLUMNS)
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, df in (("cc", stream_class_count(stream)), ("sup", stream_support(stream, data))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {r.c: r.n for r in spark.table("cc").collect()} == {L + "Loan": 5, L + "Room": 1}
    assert {(r.p, r.support) for r in spark.table("sup").where(F.col("p") == L + "copy").collect()} == {(L + "copy", 4)}
    keep = keep_counts(P.class_count, str(tmp_path / "kept"), ["c"], "n")
    for i in (0, 1, 1):  # the second batch is run twice, and counts once
        keep(data, i)
    assert {r.c: r.n for r in spark.read.parquet(str(tmp_path / "kept" / "1")).collect()} == {L + "Loan": 10, L + "Room": 2}
