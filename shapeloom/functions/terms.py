"""Terms of RDF: parsing, kinds, datatypes and names, all as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = f"<{XSD}string>"
LANG_STRING = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>"
#: Type of an object that is an IRI without a class.
UNDEFINED = "http://shaclshapes.org/object-type/undefined"
SHAPES = "http://shaclshapes.org/"
#: A line of N-Triples: subject, predicate, object. The possessive body of a string takes no stack, however long the string.
LINE = (
    r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+"
    r'(<[^>]*>|_:\S+|"(?:[^"\\]++|\\.)*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'
)
#: Pieces of an escaped text: a pair of surrogates, a code point of 4 or 8 digits, another escape, plain characters.
_PIECE = (
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|(?s)\\.|[^\\]++|\\"
)
#: Fixed: what the letter after a backslash stands for; any other character stands for itself.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def strip_brackets(term: Column) -> Column:
    return F.translate(term, "<>", "")


def is_valid_iri(term: Column) -> Column:
    """A colon after the first character."""
    return F.instr(term, ":") > 1


def term_kind(raw: Column, compat: bool = False) -> Column:
    """iri, bnode or literal, by grammar; compat: whatever has a colon after its first character and no datatype is an IRI."""
    by_grammar = F.when(raw.startswith("<"), "iri").when(raw.startswith("_:"), "bnode").otherwise("literal")
    if not compat:
        return by_grammar
    plain = ~raw.contains('"^^') & ~raw.rlike('"@[A-Za-z0-9-]+$')
    return F.when(raw.startswith("<"), "iri").when(plain & is_valid_iri(raw), "iri").otherwise("literal")


def literal_datatype(raw: Column) -> Column:
    """In angle brackets, as written; of a plain literal that of strings; null for other terms."""
    marked = F.regexp_extract(raw, r'"\^\^(<[^>]*>)$', 1)
    return F.when(
        raw.startswith('"'),
        F.when(marked != "", marked).when(raw.rlike('"@[A-Za-z0-9-]+$'), LANG_STRING).otherwise(XSD_STRING),
    )


def literal_lang(raw: Column) -> Column:
    found = F.regexp_extract(raw, r'(?s)^"(?:[^"\\]++|\\.)*+"@([A-Za-z0-9-]+)$', 1)
    return F.when(found != "", found)


def unescape(text: Column) -> Column:
    r"""A text with its escapes read: \n, \r, \t, \b, \f, \uXXXX (pairs of surrogates too), \UXXXXXXXX; \ before others is dropped."""

    def code_points(hex_digits: Column, charset: str) -> Column:
        return F.decode(F.unhex(hex_digits), charset)

    def one(x: Column) -> Column:
        letter = F.substring(x, 2, 1)
        out = F.when(F.length(x) == 12, code_points(F.replace(F.substring(x, 3, 10), F.lit("\\u"), F.lit("")), "UTF-16BE"))
        out = out.when((letter == "u") & (F.length(x) == 6), code_points(F.substring(x, 3, 4), "UTF-16BE"))
        out = out.when((letter == "U") & (F.length(x) == 10), code_points(F.substring(x, 3, 8), "UTF-32"))
        for k, v in _ESCAPES.items():
            out = out.when(letter == k, F.lit(v))
        return F.when(x.startswith("\\"), out.otherwise(letter)).otherwise(x)

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def term_value(raw: Column) -> Column:
    """An IRI without brackets, a literal's text, both with escapes read; a blank node as it is."""
    inside = F.regexp_extract(raw, r'(?s)^"((?:[^"\\]++|\\.)*+)"', 1)
    return (
        F.when(raw.startswith("<"), unescape(strip_brackets(raw))).when(raw.startswith('"'), unescape(inside)).otherwise(raw)
    )


def escape(text: Column) -> Column:
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def raw_literal(value: Column, datatype: Column, lang: Column) -> Column:
    """The N-Triples form of a literal."""
    quoted = F.concat(F.lit('"'), escape(value), F.lit('"'))
    return (
        F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(datatype == XSD_STRING, quoted)
        .otherwise(F.concat(quoted, F.lit("^^"), datatype))
    )


def local_name(iri: Column) -> Column:
    """After the last #, else after the last /, else after the last colon."""
    return (
        F.when(iri.contains("#"), F.substring_index(iri, "#", -1))
        .when(iri.contains("/"), F.substring_index(iri, "/", -1))
        .otherwise(F.substring_index(iri, ":", -1))
    )


def term_hash(term: Column, a: str, b: str) -> list[Column]:
    """128 bits that stand for a term in joins and groups, as two longs."""
    return [F.xxhash64(term).alias(a), F.xxhash64(F.lit(7), term).alias(b)]


def shape_of_message(message: Column) -> Column:
    """The shape's IRI that a validation message names, null if it names none."""
    found = F.regexp_extract(message, f"({SHAPES}[^\\s>\\]]+)", 1)
    return F.when(found != "", found)
