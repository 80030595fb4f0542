"""Line-based RDF (N-Triples, N-Quads) as a table of typed triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions.numbers import literal_number
from itemloom.runtime import materialize, number_rows

# The N-Triples / N-Quads line grammar.
_IRI = r"<([^<>\"{}|^`\x00-\x20]*)>"
_LITERAL = r"\"((?:[^\"\\\r\n]|\\.)*)\"(?:\^\^<[^<>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
_GRAPH = r"(?:<[^<>]*>|_:\S+)"
_LINE = rf"^\s*{_IRI}\s*{_IRI}\s*(?:{_IRI}|{_LITERAL})\s*{_GRAPH}?\s*\.\s*(?:#.*)?$"

# Escapes of one character.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: Column) -> Column:
    pieces = F.regexp_extract_all(
        text, F.lit(r"(?s)(\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+)"), F.lit(1)
    )

    def decoded(piece: Column) -> Column:
        code = F.substring(piece, 2, 1)
        result = F.when(~piece.startswith("\\"), piece)
        result = result.when(
            code == "u", F.decode(F.unhex(F.substring(piece, 3, 4)), "UTF-16BE")
        ).when(code == "U", F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32"))
        for letter, character in _ESCAPES.items():
            result = result.when(code == letter, F.lit(character))
        return result.otherwise(code)

    plain = F.array_join(F.transform(pieces, decoded), "")
    return F.when(text.contains("\\"), plain).otherwise(text)


def parse_triples(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Triples of a ``value`` column of lines; blank and comment lines are skipped.

    A line that is no triple, or whose subject or object is a blank node, stops the
    job under ``FAILFAST`` and is left out under ``DROPMALFORMED``.
    """
    line = F.col("value")
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    valid = line.rlike(_LINE)
    if mode == "DROPMALFORMED":
        rows = rows.where(valid)
    else:
        fault = F.raise_error(F.concat(F.lit("not a triple: "), line)).cast("string")
        rows = rows.select(F.when(valid, line).otherwise(fault).alias("value"))
    part = [F.regexp_extract("value", _LINE, i) for i in range(1, 5)]
    # the object is a literal when the line has a quote right where the object starts
    is_literal = F.regexp_extract("value", rf"^\s*{_IRI}\s*{_IRI}\s*(.)", 3) == '"'
    parsed = rows.select(
        _unescaped(part[0]).alias("subject"),
        _unescaped(part[1]).alias("predicate"),
        F.when(is_literal, _unescaped(part[3])).otherwise(_unescaped(part[2])).alias("value_nominal"),
        is_literal.alias("_literal"),
    )
    number = F.when(F.col("_literal"), literal_number(F.col("value_nominal")))
    return parsed.select(
        "subject", "predicate", "value_nominal", number.alias("value_numeric")
    ).withColumn("is_nominal", F.col("value_numeric").isNull())


def read_triples(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_triples(spark.read.text(path), mode)


def triples_fields(triples: DataFrame) -> DataFrame:
    """One field per predicate: nominal when any of its objects is nominal."""
    found = triples.groupBy("predicate").agg(F.bool_or("is_nominal").alias("_nominal"))
    typed = found.select(
        F.col("predicate").alias("name"),
        F.when(F.col("_nominal"), F.lit("NOMINAL")).otherwise(F.lit("NUMERIC")).alias("type"),
    )
    return number_rows(typed, ["name"], "field").withColumn("field", F.col("field").cast("int"))


def triples_instances(triples: DataFrame, fields: DataFrame) -> DataFrame:
    """One transaction per subject, numbered by subject: the set of its (field, value) pairs.

    Equal triples collapse first, map-side, so a subject that holds a large share
    of the triples is small before it is joined with its number.
    """
    cells = materialize(
        triples.select("subject", "predicate", "value_nominal", "value_numeric").distinct(), "cells"
    )
    ids = number_rows(cells.select("subject").distinct(), ["subject"], "id")
    names = fields.select("field", F.col("name").alias("predicate"))
    return (
        cells.join(names, "predicate").join(ids, "subject")
        .select("id", "field", "value_nominal", "value_numeric")
    )
