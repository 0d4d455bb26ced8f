"""DuckDB SQL of the queries, over the same tables. CTES holds the steps that queries share, in order."""

from __future__ import annotations

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = f"<{XSD}string>"
LANG_STRING = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>"
UNDEFINED = "http://shaclshapes.org/object-type/undefined"
SHAPES = "http://shaclshapes.org/"
EX = "http://ex.org/"
THRESHOLDS = [(0.1, 100), (0.5, 1), (0.25, 500)]
#: For negative shapes: pairs that leave some on the test tables.
NEGATIVE = [(0.25, 100_000), (0.9, 1_000_000)]
LABELS = ("c_name", "n_name", "p_name")

#: What each table says, apart from the engine's own mapping: subject, classes (parted by ;), and properties as column type, with @table for
#: a reference and ^column for the column of the language.
_TABLES = """
region        | 'region/' || r_regionkey | | r_name string
nation        | 'nation/' || n_nationkey | 'Nation' | n_name string, n_regionkey @region
customer      | 'customer/' || c_custkey | 'Customer'; 'Customer_' || translate(c_mktsegment, ' #', '__') | c_name string, c_nationkey @nation, c_acctbal double
supplier      | 'supplier/' || s_suppkey | 'Supplier' | s_name string, s_nationkey @nation, s_acctbal double
part          | 'part/' || p_partkey | 'Part'; 'Part_' || translate(p_brand, ' #', '__') | p_name string, p_type string, p_size integer, p_retailprice double
orders        | 'orders/' || o_orderkey | 'Order'; 'Order_' || o_orderstatus | o_custkey @customer, o_totalprice double, o_orderdate dateTime, o_orderpriority string
lineitem      | 'lineitem/' || l_orderkey || '-' || l_linenumber | 'LineItem'; 'LineItem_' || l_returnflag | l_orderkey @orders, l_partkey @part, l_suppkey @supplier, l_linenumber integer, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate dateTime, l_linestatus string
events        | 'events/' || event_id | 'Event'; 'Event_' || translate(event_type, ' #', '__') | user_id @user, value double, ts dateTime, props string
documents     | 'documents/' || doc_id | 'Document'; 'Document_' || translate(lang, ' #', '__') | text ^lang, source string, n_chars integer
labels        | 'documents/' || doc_id | | quality integer, toxic integer
pages         | 'pages/' || page_id | 'Page' | url string, html string
benchmark     | 'benchmark/' || item_id | 'BenchmarkItem' | text string
conversations | 'conversations/' || conv_id || '-' || turn | 'Turn'; 'Turn_' || translate(role, ' #', '__') | conv_id @conversation, turn integer, text string
embeddings    | 'embeddings/' || vec_id | 'Embedding' | label integer
"""


def _triples() -> str:
    rows = []
    for line in _TABLES.strip().splitlines():
        table, subject, classes, columns = (x.strip() for x in line.replace("||", "\0").split("|"))
        head = f"SELECT '{EX}' || {subject} AS s, ".replace("\0", "||")
        for c in filter(None, classes.replace("\0", "||").split("; ")):
            rows.append(f"{head}'{TYPE}' AS p, '{EX}' || {c} AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_datatype, NULL::VARCHAR AS o_lang FROM {table}")
        for column in columns.split(", "):
            name, kind = column.split(" ")
            o, k, datatype, lang = f"{name}::VARCHAR", "literal", f"'<{XSD}{kind}>'", "NULL"
            if kind[0] == "@":
                o, k, datatype = f"'{EX}{kind[1:]}/' || {name}::VARCHAR", "iri", "NULL"
            elif kind[0] == "^":
                datatype, lang = f"'{LANG_STRING}'", kind[1:]
            rows.append(f"{head}'{EX}{name}' AS p, {o} AS o, '{k}' AS o_kind, {datatype}::VARCHAR AS o_datatype, {lang}::VARCHAR AS o_lang FROM {table}")
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE o IS NOT NULL"


_LOCAL = (
    "CASE WHEN {0} LIKE '%#%' THEN regexp_extract({0}, '([^#]*)$', 1) WHEN {0} LIKE '%/%' THEN regexp_extract({0}, '([^/]*)$', 1) "
    "ELSE regexp_extract({0}, '([^:]*)$', 1) END"
)
_CONSTRAINT = (
    "CASE WHEN ot IS NULL OR ot LIKE '<%' THEN 'Literal' ELSE 'IRI' END AS node_kind, "
    f"CASE WHEN ot IS NULL THEN '{XSD_STRING}' WHEN ot LIKE '<%' THEN ot END AS datatype, "
    f"CASE WHEN ot NOT LIKE '<%' AND ot <> '{UNDEFINED}' THEN ot END AS class"
)


def _shapes(stats: str, keys: str = "", suffix: str = "ShapeProperty", max1: str = "max1") -> str:
    k = f"{keys}, " if keys else ""
    using = f"({k}c, p)"
    return f"""
  SELECT {k}c, p, '{SHAPES}' || base || CASE WHEN r = 1 THEN '' ELSE '_' || (r - 1)::VARCHAR END || {_LOCAL.format("c")} || '{suffix}' AS name,
    CASE WHEN p = '{TYPE}' THEN 'in' WHEN k = 1 THEN 'single' ELSE 'or' END AS kind,
    CASE WHEN p <> '{TYPE}' AND k = 1 THEN node_kind END AS node_kind,
    CASE WHEN p <> '{TYPE}' AND k = 1 THEN datatype END AS datatype,
    CASE WHEN p <> '{TYPE}' AND k = 1 THEN class END AS class,
    CASE WHEN p <> '{TYPE}' AND (is_full OR (k = 1 AND ot = '{UNDEFINED}')) THEN 1 END::INTEGER AS min_count,
    CASE WHEN p <> '{TYPE}' AND m.p1 IS NOT NULL THEN 1 END::INTEGER AS max_count,
    CASE WHEN p = '{TYPE}' OR k = 1 THEN support END AS support,
    CASE WHEN p = '{TYPE}' OR k = 1 THEN confidence END AS confidence,
    CASE WHEN p <> '{TYPE}' AND k > 1 THEN k ELSE 0 END::BIGINT AS n_or, CASE WHEN p <> '{TYPE}' AND k > 1 THEN ots END AS or_types
  FROM (
    SELECT *, row_number() OVER (PARTITION BY {k}c, base ORDER BY p) AS r FROM (
      SELECT {k}c, p, CASE WHEN p = '{TYPE}' THEN 'instanceType' ELSE {_LOCAL.format("p")} END AS base,
        count(*) AS k, bool_or(support = n) AS is_full, string_agg(ot, ' ' ORDER BY ot) AS ots, min(ot) AS ot, min(support) AS support, min(confidence) AS confidence
      FROM {stats} GROUP BY {k}c, p)) g
  JOIN (SELECT {k}c, p, min_by(node_kind, ot) AS node_kind, min_by(datatype, ot) AS datatype, arg_min_null(class, ot) AS class
        FROM (SELECT *, {_CONSTRAINT} FROM {stats}) GROUP BY {k}c, p) d USING {using}
  LEFT JOIN (SELECT p AS p1, c AS c1 FROM {max1}) m ON m.p1 = g.p AND m.c1 = g.c"""


def _pairs(thresholds: list) -> str:
    return "(VALUES " + ", ".join(f"({c}::DOUBLE, {s}::INTEGER)" for c, s in thresholds) + ") t(conf_thr, supp_thr)"


_PAIRS = _pairs(THRESHOLDS)
CTES = {
    "triples": _triples(),
    "types": f"SELECT DISTINCT s, o AS c FROM triples WHERE p = '{TYPE}'",
    "cc": f"SELECT o AS c, count(*) AS n FROM triples WHERE p = '{TYPE}' GROUP BY 1",
    "ot": f"""SELECT s, p, o_datatype AS ot FROM triples WHERE o_kind = 'literal' UNION ALL
              SELECT t.s, t.p, coalesce(y.c, '{UNDEFINED}') FROM triples t LEFT JOIN types y ON t.o = y.s WHERE t.o_kind <> 'literal'""",
    "ep": "SELECT s, p, ot, count(*) AS cnt FROM ot GROUP BY ALL",
    "sup": "SELECT c, p, ot, count(*) AS support FROM ep JOIN types USING (s) GROUP BY ALL",
    "stats": "SELECT c, p, ot, support, n, support::DOUBLE / n AS confidence FROM sup JOIN cc USING (c)",
    "card": "SELECT s, p, sum(cnt)::BIGINT AS cnt FROM ep GROUP BY ALL",
    "max1": "SELECT p, c FROM card JOIN types USING (s) GROUP BY p, c HAVING min(cnt) <= 1",
    "pos": f"""SELECT * FROM stats, {_PAIRS} WHERE p = '{TYPE}' OR (confidence > conf_thr AND
               CASE WHEN supp_thr = 1 THEN support >= 1 ELSE support > supp_thr END)""",
    "nodes": f"SELECT * FROM cc, {_PAIRS} WHERE CASE WHEN supp_thr = 1 THEN n >= 1 ELSE n > supp_thr END",
    "kept": "SELECT * FROM pos SEMI JOIN nodes USING (c, conf_thr, supp_thr)",
    "shapes": _shapes("stats"),
    "kept_shapes": _shapes("kept", "conf_thr, supp_thr"),
    "none1": "SELECT p, c FROM max1 WHERE false",
    "neg": f"SELECT * FROM stats, {_pairs(NEGATIVE)} WHERE p <> '{TYPE}' AND confidence <= conf_thr AND support < supp_thr",
    "neg_shapes": _shapes("neg", "conf_thr, supp_thr", "_PS_NotShape", "none1"),
    "members": f"SELECT c, p, ot, support, confidence, {_CONSTRAINT} FROM stats WHERE p <> '{TYPE}' QUALIFY count(*) OVER (PARTITION BY c, p) > 1",
    "scope": "SELECT s, count(*) AS scope FROM types GROUP BY 1",
    "res": "SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY md5('100|' || s), s)::INTEGER AS slot FROM types",
    "nbr": "SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY scope DESC, md5('100|' || s), s)::INTEGER AS slot FROM types JOIN scope USING (s)",
    "cap": "SELECT c, greatest(1, least(200, ceil(n * 25 / 100.0)))::INTEGER AS cap FROM cc",
    "dyn": "SELECT c, s, slot FROM nbr JOIN cap USING (c) WHERE slot <= cap",
    "sot": f"""SELECT DISTINCT t.s, t.p, coalesce(t.o_datatype, y.c) AS ot FROM triples t LEFT JOIN types y ON t.o = y.s AND t.o_kind <> 'literal'
               WHERE t.p <> '{TYPE}' AND t.s IN (SELECT s FROM dyn)""",
    "ssup": "SELECT c, p, ot, count(*) AS support FROM sot JOIN (SELECT DISTINCT s, c FROM dyn) d USING (s) WHERE ot IS NOT NULL GROUP BY ALL",
    "sstats": """SELECT c, p, ot, support, reservoir, n, support::DOUBLE / reservoir AS confidence
                 FROM ssup JOIN (SELECT c, count(*) AS reservoir FROM dyn GROUP BY 1) USING (c) JOIN cc USING (c)""",
    "xnode": "SELECT c, s FROM res WHERE slot <= 5",
    "xval": """SELECT DISTINCT c, p, o AS actual, o_kind, CASE WHEN o_kind = 'literal' THEN '"' || replace(replace(replace(replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' ||
               CASE WHEN o_lang IS NOT NULL THEN '@' || o_lang WHEN o_datatype = '%s' THEN '' ELSE '^^' || o_datatype END ELSE o END AS raw
               FROM triples JOIN xnode USING (s)""" % XSD_STRING,
    "xval5": "SELECT * FROM xval QUALIFY row_number() OVER (PARTITION BY c, p ORDER BY md5('100|' || raw), raw) <= 5",
    "want": """SELECT c AS iri FROM xnode UNION SELECT s FROM xnode UNION SELECT p FROM xval5 UNION SELECT actual FROM xval5 WHERE o_kind <> 'literal'""",
    "lab": "SELECT s AS iri, min(o) AS label FROM triples WHERE p IN (%s) AND s IN (SELECT iri FROM want) GROUP BY 1"
    % ", ".join(f"'{EX}{x}'" for x in LABELS),
    "edges": f"""SELECT DISTINCT a.c AS child, regexp_replace(a.c, '_[^/]*$', '') AS parent FROM cc a WHERE a.c LIKE '{EX}%\\_%' ESCAPE '\\'
                 UNION SELECT DISTINCT regexp_replace(c, '_[^/]*$', ''), '{EX}Thing' FROM cc""",
    "val": "SELECT DISTINCT s, p, o, o_kind, o_datatype, o_lang FROM triples",
}


def _is(cls: str) -> str:
    return f"s IN (SELECT s FROM types WHERE c = '{EX}{cls}')"


def _bad(shape: str, path: str, component: str, message: str, where: str, value: str = "o", source: str = "val") -> str:
    return (
        f"SELECT '{shape}' AS source_shape, s AS focus_node, '{EX}{path}' AS result_path, {value}::VARCHAR AS value, "
        f"'{component}' AS component, {message} AS message FROM {source} WHERE {where}"
    )


_SPREADS = ", ".join(
    f"coalesce(avg({x}) FILTER ({x} > 0), -999)::DOUBLE AS AVG_{x}, coalesce(min({x}) FILTER ({x} > 0), -999)::BIGINT AS MIN_{x}, "
    f"coalesce(max({x}) FILTER ({x} > 0), -999)::BIGINT AS MAX_{x}"
    for x in ("PS", "CC", "LC", "MCC")
)
_COUNTS = f"""SELECT conf_thr, supp_thr, COUNT_NS, coalesce(COUNT_PS, 0) AS COUNT_PS, coalesce(COUNT_CC, 0) AS COUNT_CC, coalesce(COUNT_LC, 0) AS COUNT_LC, coalesce(COUNT_MCC, 0) AS COUNT_MCC FROM
  (SELECT conf_thr, supp_thr, count(DISTINCT {_LOCAL.format("c")}) AS COUNT_NS FROM nodes GROUP BY ALL) LEFT JOIN
  (SELECT conf_thr, supp_thr, count(*) AS COUNT_PS, count(class) AS COUNT_CC, count(*) FILTER (node_kind = 'Literal') AS COUNT_LC,
          count(min_count) AS COUNT_MCC FROM kept_shapes GROUP BY ALL) USING (conf_thr, supp_thr)"""
_PR = """SELECT a AS {0}_truth, b AS {0}_found, ab AS {0}_both, round(ab / b, 2) AS precision_{0}, round(ab / a, 2) AS recall_{0} FROM (SELECT
  (SELECT count(*) FROM ({1})) AS a, (SELECT count(*) FROM ({2})) AS b, (SELECT count(*) FROM ({1} INTERSECT {2})) AS ab)"""
_SHAPE_COLUMNS = "c, p, name, kind, node_kind, datatype, class, min_count, max_count, support, confidence, n_or, or_types"
BODIES = {
    "class_count": "SELECT c, n FROM cc",
    "class_count_distinct": "SELECT c, count(*) AS n FROM types GROUP BY 1",
    "entity_classes": "SELECT s, string_agg(c, ' ' ORDER BY c) AS classes FROM types GROUP BY 1",
    "class_properties": "SELECT DISTINCT c, p FROM triples JOIN types USING (s)",
    "class_prop_types": "SELECT c, p, string_agg(ot, ' ' ORDER BY ot) AS ots FROM sup GROUP BY ALL",
    "shape_support": "SELECT c, p, ot, support FROM sup",
    "shape_confidence": "SELECT c, p, ot, support, n, confidence FROM stats",
    "literal_datatypes": "SELECT c, p, ot FROM sup WHERE ot LIKE '<%'",
    "iri_object_classes": f"SELECT c, p, ot FROM sup WHERE ot NOT LIKE '<%' AND ot <> '{UNDEFINED}'",
    "undefined_objects": f"SELECT c, p, support FROM sup WHERE ot = '{UNDEFINED}'",
    "entity_cardinality": "SELECT p, cnt, count(*) AS entities FROM card GROUP BY ALL",
    "strict_cardinality": "SELECT p, cnt, count(*) AS entities FROM (SELECT s, p, count(*) AS cnt FROM triples GROUP BY ALL) GROUP BY ALL",
    "max_count_one": "SELECT p, c FROM max1",
    "min_count_one": f"SELECT c, p FROM stats GROUP BY ALL HAVING bool_or(support = n) OR (count(*) = 1 AND min(ot) = '{UNDEFINED}')",
    "predicate_frequency": f"SELECT p, count(*) AS n FROM triples WHERE p <> '{TYPE}' GROUP BY 1",
    "prune_nodes": "SELECT c, n, conf_thr, supp_thr FROM nodes",
    "prune_positive": "SELECT c, p, ot, support, n, confidence, conf_thr, supp_thr FROM pos",
    "prune_negative": "SELECT c, p, ot, support, n, confidence, conf_thr, supp_thr FROM neg",
    "prune_grid": "SELECT conf_thr, supp_thr, count(*) AS kept, count(DISTINCT c) AS classes FROM kept GROUP BY ALL",
    "specific_classes": f"SELECT c, p, ot, support, n, confidence FROM stats WHERE c IN ('{EX}Order', '{EX}Customer', '{EX}Nobody')",
    "node_shapes": f"SELECT '{SHAPES}' || {_LOCAL.format('c')} || 'Shape' AS name, c AS target_class, n AS support FROM cc",
    "property_shapes": f"SELECT {_SHAPE_COLUMNS} FROM shapes",
    "pruned_property_shapes": f"SELECT conf_thr, supp_thr, {_SHAPE_COLUMNS} FROM kept_shapes",
    "or_members": "SELECT c, p, ot, node_kind, datatype, class, support, confidence FROM members",
    "shape_names_dedup": f"""SELECT c, p, '{SHAPES}' || base || CASE WHEN r = 1 THEN '' ELSE '_' || (r - 1)::VARCHAR END || {_LOCAL.format("c")} || 'ShapeProperty' AS name FROM (
        SELECT c, p, base, row_number() OVER (PARTITION BY c, base ORDER BY p) AS r FROM (
          SELECT DISTINCT c, p, {_LOCAL.format("p")} AS base FROM (SELECT c, p FROM sup WHERE p <> '{TYPE}' UNION ALL SELECT c, 'http://other.org/#' || {_LOCAL.format("p")} FROM sup WHERE p <> '{TYPE}')))""",
    "sh_node_links": f"""SELECT name, class, node FROM (
        SELECT name, class FROM shapes WHERE class IS NOT NULL UNION
        SELECT s.name, m.class FROM shapes s JOIN (SELECT c, p, class FROM members WHERE class IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY c, p ORDER BY support DESC, class DESC) = 1) m USING (c, p))
        JOIN (SELECT c AS class, '{SHAPES}' || {_LOCAL.format("c")} || 'Shape' AS node FROM cc) USING (class)""",
    "stats_counts": _COUNTS,
    "stats_avg_min_max": f"""SELECT conf_thr, supp_thr, {_SPREADS} FROM (SELECT conf_thr, supp_thr, c, count(*) AS PS, count(class) AS CC,
        count(*) FILTER (node_kind = 'Literal') AS LC, count(min_count) AS MCC FROM kept_shapes GROUP BY ALL) GROUP BY ALL""",
    "stats_unpivot": f"""SELECT conf_thr AS "Confidence", supp_thr AS "Support", "TYPE", "COUNT" FROM (
        SELECT conf_thr, supp_thr, 'NonLiteral' AS "TYPE", COUNT_CC AS "COUNT" FROM ({_COUNTS}) UNION ALL
        SELECT conf_thr, supp_thr, 'Literal', COUNT_LC FROM ({_COUNTS}))""",
    "stats_nested": """SELECT count(class) AS COUNT_CC_NESTED, count(*) FILTER (node_kind = 'Literal') AS COUNT_LC_NESTED FROM members""",
    "negative_shapes": f"SELECT conf_thr, supp_thr, {_SHAPE_COLUMNS} FROM neg_shapes",
    "untyped_property_shapes": f"""SELECT c, p, CASE WHEN p = '{TYPE}' THEN 'in' WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'single' ELSE 'or' END AS kind
        FROM (SELECT c, p, count(DISTINCT CASE WHEN ot <> '{UNDEFINED}' THEN ot END) AS k FROM sup GROUP BY ALL)""",
    "invalid_classes": "SELECT * FROM (VALUES ('no_iri', 5::BIGINT), (':x', 2::BIGINT)) t(c, n)",
    "class_totals": "SELECT count(*) AS classes, sum(n)::BIGINT AS total FROM cc",
    "sampled_class_totals": "SELECT count(DISTINCT c) AS classes, count(*) AS total FROM dyn",
    "predicate_frequency_by_class": f"SELECT p, count(*) AS n FROM triples JOIN types USING (s) WHERE p <> '{TYPE}' GROUP BY 1",
    "example_registry": """SELECT 'class' AS kind, c AS iri FROM xnode UNION SELECT 'node', s FROM xnode UNION SELECT 'property', p FROM xval5
        UNION SELECT 'value', actual FROM xval5 WHERE o_kind <> 'literal'""",
    "pattern_classes": "SELECT c, count(*) AS n FROM types GROUP BY 1",
    "pattern_properties": f"SELECT DISTINCT p FROM triples WHERE p <> '{TYPE}' AND s IN (SELECT s FROM types WHERE c = '{EX}Order')",
    "pattern_filter": f"SELECT s, o AS v FROM triples WHERE p = '{EX}p_size' AND TRY_CAST(o AS DOUBLE) > 45 AND s IN (SELECT s FROM types WHERE c = '{EX}Part')",
    "pattern_optional": f"SELECT y.s AS d, t.o AS q FROM triples y LEFT JOIN (SELECT s, o FROM triples WHERE p = '{EX}quality') t ON t.s = y.s WHERE y.p = '{TYPE}' AND y.o = '{EX}Document'",
    "pattern_values": "SELECT 'http://ex.org/nation/' || n_nationkey AS s, n_name AS n FROM nation WHERE n_nationkey IN (1, 3)",
    "pattern_top": "SELECT c, n FROM cc ORDER BY n DESC, c LIMIT 5",
    "pattern_construct": """SELECT DISTINCT 'http://ex.org/orders/' || o_orderkey AS s, 'http://ex.org/orderedFrom' AS p, n_name AS o, 'literal' AS o_kind
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "pattern_ask": "SELECT * FROM (VALUES ('ASK { ?s a ex:Order }', true), ('ASK { ?s a ex:Nobody }', false)) t(ask, met)",
    "entity_stars": "SELECT s, count(*) AS n FROM triples WHERE s IN (SELECT s FROM xnode) GROUP BY 1",
    "ntriples_roundtrip": "SELECT p, o_kind, o_datatype, count(*) AS n FROM triples GROUP BY ALL",
    "sample_bernoulli": "SELECT s, c FROM types WHERE ('0x' || substr(md5('100|' || s || c), 1, 8))::BIGINT % 100 < 20",
    "sample_reservoir": "SELECT c, s, slot FROM res WHERE slot <= 50",
    "sample_neighbor": "SELECT c, s, slot FROM nbr WHERE slot <= 50",
    "sample_dynamic": "SELECT c, s, slot FROM dyn",
    "sample_capacity": "SELECT c, cap FROM cap",
    "sampled_support": "SELECT c, p, ot, support, reservoir, n, confidence FROM sstats",
    "sampled_predicate_frequency": f"SELECT p, count(*) AS n FROM triples WHERE p <> '{TYPE}' AND s IN (SELECT s FROM dyn) GROUP BY 1",
    "relative_support_prune": f"""SELECT c, p, ot, support, reservoir, n, confidence, conf_thr, supp_thr FROM sstats, {_PAIRS} WHERE confidence > conf_thr AND
        CASE WHEN supp_thr = 1 THEN support >= 1 ELSE support > supp_thr * least(1.0, reservoir / n) END""",
    "precision_recall": _PR.format("PS", "SELECT DISTINCT c, p FROM stats WHERE p <> '%s'" % TYPE, "SELECT DISTINCT c, p FROM sstats"),
    "precision_recall_nodes": _PR.format("NS", "SELECT DISTINCT c FROM cc", "SELECT DISTINCT c FROM dyn"),
    "wrongly_pruned": f"SELECT c, p FROM stats WHERE p <> '{TYPE}' EXCEPT SELECT c, p FROM sstats",
    "type_set_groups": "SELECT type_set, count(*) AS n FROM (SELECT string_agg(c, ' ' ORDER BY c) AS type_set FROM types GROUP BY s) GROUP BY 1",
    "mixed_property_ask": """SELECT c, p, ot, support FROM sup QUALIFY NOT bool_or(ot LIKE '<%') OVER (PARTITION BY c, p) OR ot LIKE '<%'""",
    "support_recount": f"""SELECT k.c, k.p, k.ot, coalesce(support, 0) AS support FROM (SELECT DISTINCT c, p, ot FROM stats WHERE confidence > 0.9
        UNION SELECT '{EX}Nobody', '{EX}nothing', '{UNDEFINED}') k LEFT JOIN sup USING (c, p, ot)""",
    "labels_for_examples": "SELECT iri, label FROM lab",
    "property_examples": """SELECT c, p, string_agg(shown, ' ' ORDER BY shown) AS examples FROM (SELECT DISTINCT c, p,
        CASE WHEN o_kind = 'literal' THEN raw ELSE raw || '(' || coalesce(label, ' ') || ')' END AS shown FROM xval5 LEFT JOIN lab ON raw = iri) GROUP BY ALL""",
    "property_kinds": "SELECT p, bool_or(o_kind = 'literal') AS is_literal FROM triples GROUP BY 1",
    "class_examples": """SELECT c, s, concat_ws('; ', s || '(' || coalesce(ls.label, ' ') || ') is a ' || c || '(' || coalesce(lc.label, ' ') || ')', parts) AS sentence
        FROM xnode LEFT JOIN lab ls ON ls.iri = s LEFT JOIN lab lc ON lc.iri = c LEFT JOIN (
          SELECT c, s, string_agg('has ' || CASE WHEN min_count > 0 THEN 'at least 1 ' ELSE '' END || CASE WHEN max_count = 1 THEN 'at most 1 ' ELSE '' END || p || '(' || coalesce(label, ' ') || ')', '; ' ORDER BY p) AS parts
          FROM (SELECT DISTINCT c, s, p FROM triples JOIN xnode USING (s)) JOIN shapes USING (c, p) LEFT JOIN lab ON iri = p GROUP BY ALL) USING (c, s)""",
    "validate_min_count": f"""SELECT 'min' AS source_shape, s AS focus_node, '{EX}quality' AS result_path, NULL::VARCHAR AS value, 'minCount' AS component,
        'fewer values than 1' AS message FROM types WHERE c = '{EX}Document' AND s NOT IN (SELECT s FROM triples WHERE p = '{EX}quality')""",
    "validate_max_count": f"""SELECT 'max' AS source_shape, s AS focus_node, '{EX}l_partkey' AS result_path, NULL::VARCHAR AS value, 'maxCount' AS component,
        'more values than 1' AS message FROM val WHERE p = '{EX}l_partkey' AND {_is("LineItem")} GROUP BY s HAVING count(*) > 1""",
    "validate_datatype": _bad("dt", "n_chars", "datatype", f"'not of datatype {XSD_STRING}'", f"p = '{EX}n_chars' AND o_datatype <> '{XSD_STRING}' AND {_is('Document')}"),
    "validate_class": _bad("cls", "n_regionkey", "class", f"'not an instance of {EX}Region'", f"p = '{EX}n_regionkey' AND {_is('Nation')}"),
    "validate_node_kind": _bad("kind", "n_name", "nodeKind", "'not of kind IRI'", f"p = '{EX}n_name' AND o_kind <> 'iri' AND {_is('Nation')}"),
    "validate_in": _bad("in", "o_orderpriority", "in", "'not in the list'", f"p = '{EX}o_orderpriority' AND o NOT IN ('1-URGENT', '2-HIGH') AND {_is('Order')}"),
    "validate_or": _bad("or", "l_orderkey", "or", "'meets none of the alternatives'", f"p = '{EX}l_orderkey' AND {_is('LineItem')} AND o NOT IN (SELECT s FROM types WHERE c IN ('{EX}Order_O', '{EX}Order_F'))"),
    "validate_range": _bad("range", "p_size", "minInclusive", "'too small'", f"p = '{EX}p_size' AND o::DOUBLE < 10 AND {_is('Part')}") + " UNION ALL "
    + _bad("range", "p_size", "maxInclusive", "'too large'", f"p = '{EX}p_size' AND o::DOUBLE > 40 AND {_is('Part')}"),
    "validate_less_than": f"""SELECT 'less' AS source_shape, a.s AS focus_node, '{EX}quality' AS result_path, a.o AS value, 'lessThan' AS component, 'not less than ' || b.o AS message
        FROM val a JOIN val b ON a.s = b.s AND a.p = '{EX}quality' AND b.p = '{EX}toxic' WHERE a.o::DOUBLE >= b.o::DOUBLE AND a.{_is("Document")}""",
    "validate_closed": f"""SELECT 'closed' AS source_shape, s AS focus_node, p AS result_path, o AS value, 'closed' AS component, 'a property that is not allowed' AS message
        FROM val WHERE {_is("Nation")} AND p NOT IN ('{TYPE}', '{EX}n_name')""",
    "validate_not": f"""SELECT source_shape, focus_node, result_path, component, property, support, confidence, class FROM (
        SELECT DISTINCT 'not' AS source_shape, o.s AS focus_node, n.p AS result_path, 'not' AS component, n.p AS property, n.ot, n.support, n.confidence, n.c AS class
        FROM (SELECT * FROM neg WHERE conf_thr = {NEGATIVE[0][0]}) n JOIN types y USING (c) JOIN ot o ON o.s = y.s AND o.p = n.p AND o.ot = n.ot)""",
    "validate_node": """WITH bad_part AS (SELECT p_partkey FROM part WHERE p_size > 45 OR NOT p_name < p_type),
        bad_order AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0),
        line AS (SELECT DISTINCT 'http://ex.org/lineitem/' || l_orderkey || '-' || l_linenumber AS s, l_partkey, l_orderkey FROM lineitem)
        SELECT DISTINCT 'lp' AS source_shape, s AS focus_node, 'http://ex.org/l_partkey' AS result_path, 'http://ex.org/part/' || l_partkey AS value,
          'node' AS component, 'not a part' AS message FROM line WHERE l_partkey IN (SELECT p_partkey FROM bad_part) UNION ALL
        SELECT DISTINCT 'lo', s, 'http://ex.org/l_orderkey', 'http://ex.org/orders/' || l_orderkey, 'node', 'not a order' FROM line
        WHERE l_orderkey IN (SELECT o_orderkey FROM bad_order)""",
    "taxonomy_rollup": """SELECT c, own, total FROM (WITH RECURSIVE up AS (SELECT child, parent FROM edges WHERE child <> parent UNION SELECT up.child, e.parent FROM up JOIN edges e ON up.parent = e.child WHERE up.child <> e.parent)
        SELECT k.c, coalesce(cc.n, 0)::BIGINT AS own, (coalesce(cc.n, 0) + coalesce(b.n, 0))::BIGINT AS total FROM (SELECT c FROM cc UNION SELECT child FROM edges UNION SELECT parent FROM edges) k
        LEFT JOIN cc ON cc.c = k.c LEFT JOIN (SELECT parent, sum(cc.n) AS n FROM (SELECT DISTINCT * FROM up) u JOIN cc ON cc.c = u.child GROUP BY 1) b ON b.parent = k.c)""",
    "taxonomy_levels": """SELECT coalesce(cc.c, b.parent) AS c, (coalesce(cc.n, 0) + coalesce(b.n, 0))::BIGINT AS total FROM cc FULL JOIN
        (SELECT parent, sum(n) AS n FROM edges JOIN cc ON cc.c = child GROUP BY 1) b ON b.parent = cc.c""",
    "taxonomy_prune": "SELECT child, parent FROM edges WHERE child IN (SELECT c FROM cc WHERE n > 100) AND parent IN (SELECT c FROM cc WHERE n > 100)",
    "min_cardinality_experiment": f"""SELECT conf_thr, supp_thr, c, p, count(*) AS n_types, max((support > supp_thr AND confidence > conf_thr)::INTEGER) AS min_count
        FROM stats, (VALUES (0.75::DOUBLE, 1), (0.75::DOUBLE, 100), (0.99::DOUBLE, 50)) t(conf_thr, supp_thr) WHERE p <> '{TYPE}' GROUP BY ALL""",
    "low_support_high_conf": f"SELECT c, p, ot, support, n, confidence FROM stats WHERE ot NOT LIKE '<%' AND ot <> '{UNDEFINED}' AND support < 5000 AND confidence > 0.05",
    "corpus_filter": f"SELECT p, count(*) AS n FROM triples WHERE p <> '{EX}c_name' AND (o_lang IS NULL OR o_lang = 'en') GROUP BY 1",
    "turtle_export": "SELECT conf_thr, supp_thr, name, block FROM ttl",
}


def _blocks(nodes: str, found: str, members: str, conf: str, supp: str, support: str) -> str:
    """The Turtle text of each shape. support: an aggregate for node shapes."""
    by, line = "conf_thr, supp_thr, ", "' ;' || chr(10) || '    '"
    constraint = "'sh:nodeKind sh:' || node_kind, 'sh:datatype ' || datatype, 'sh:class <' || class || '>'"
    notes = f"'<{SHAPES}support> ' || support::VARCHAR, '<{SHAPES}confidence> ' || format('{{:e}}', confidence)"
    thr = f"{conf}::DOUBLE AS conf_thr, {supp}::INTEGER AS supp_thr"
    return f"""
  SELECT conf_thr, supp_thr, name, '<' || name || '>' || chr(10) || '    ' || concat_ws({line}, 'a sh:PropertyShape', 'sh:path <' || f.p || '>',
    CASE WHEN kind = 'in' THEN 'sh:in ( <' || f.c || '> )' END, {constraint}, 'sh:minCount ' || min_count, 'sh:maxCount ' || max_count,
    'sh:or ( ' || ors || ' )', {notes}) || ' .' AS block
  FROM (SELECT {thr}, c, p, name, kind, node_kind, datatype, class, min_count, max_count, support, confidence FROM {found}) f
  LEFT JOIN (SELECT {thr}, c, p, string_agg('[ ' || concat_ws(' ; ', {constraint}, {notes}) || ' ]', ' ' ORDER BY ot) AS ors
    FROM (SELECT *, {_CONSTRAINT} FROM {members}) WHERE p <> '{TYPE}' GROUP BY ALL HAVING count(*) > 1) m USING ({by}c, p)
  UNION ALL
  SELECT t.conf_thr, t.supp_thr, name, '<' || name || '>' || chr(10) || '    ' || concat_ws({line}, 'a sh:NodeShape', 'sh:targetClass ' || targets,
    'sh:property ' || names, '<{SHAPES}support> ' || support::VARCHAR) || ' .'
  FROM (SELECT {thr}, '{SHAPES}' || {_LOCAL.format("c")} || 'Shape' AS name, string_agg('<' || c || '>', ', ' ORDER BY c) AS targets, {support} AS support
        FROM {nodes} GROUP BY ALL) t
  LEFT JOIN (SELECT {thr}, '{SHAPES}' || {_LOCAL.format("c")} || 'Shape' AS nn, string_agg('<' || x.name || '>', ', ' ORDER BY x.name) AS names
        FROM {found} x GROUP BY ALL) z ON z.nn = t.name AND z.conf_thr = t.conf_thr AND z.supp_thr = t.supp_thr"""


CTES["ttl"] = _blocks("nodes", "kept_shapes", "kept", "conf_thr", "supp_thr", "NULL::BIGINT") + " UNION ALL " + _blocks(
    "cc", "shapes", "stats", "-1", "-1", "sum(n)"
)


def sql(name: str) -> str:
    """The query's body behind the steps that it needs, directly or through others."""
    import re

    body, need = BODIES[name], set()

    def look(text: str) -> None:
        for k, step in CTES.items():
            if k not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{k}\b", text):
                need.add(k)
                look(step)

    look(body)
    text = ", ".join(f"{k} AS ({v})" for k, v in CTES.items() if k in need)
    head = f"WITH {text} " if text else ""
    return (head + body).replace("arg_min_null(class, ot)", "min(class)")


ORACLES = {name: sql(name) for name in BODIES}
