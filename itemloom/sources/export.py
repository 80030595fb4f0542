"""Rule sets as XML elements and Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.model import StageNote
from itemloom.operators.rules import four_fold
from itemloom.operators.wording import cedent_id, rule_cedents, rule_items, rule_text, side_texts
from itemloom.runtime import materialize, union_all
from itemloom.sources.streams import write_joined

# Fixed names of the result document.
DOCUMENT_START = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<PMML version="4.0" xmlns="http://www.dmg.org/PMML-4_0">\n'
)
MODEL_START = (
    '<guha:AssociationModel xmlns="" xmlns:guha="urn:guha:0.1" '
    'functionName="associationRules" algorithmName="Apriori" numberOfRules="{rules}">\n<AssociationRules>\n'
)
DOCUMENT_END = "</AssociationRules>\n</guha:AssociationModel>\n</PMML>\n"
ELEMENTS = ("BBA", "DBA", "AssociationRule")


def rule_elements(rules: DataFrame, item_values: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """The three element lists of an exported rule set, shaped for the XML writer.

    Columns that start with an underscore become attributes.
    """
    basic = rule_items(rules, item_values, names).select(
        F.concat(F.lit("BBA"), F.col("item").cast("string")).alias("_id"),
        F.lit(False).alias("_literal"),
        F.col("text").alias("Text"),
        F.col("name").alias("FieldRef"),
        F.col("value").alias("CatRef"),
    )
    cedents = rule_cedents(rules)
    prefixes = cedents.select(F.col("items").alias("antecedent"), F.array().cast("array<bigint>").alias("consequent"))
    compound = cedents.join(
        side_texts(prefixes, item_values, names).withColumnRenamed("side", "items"), "items"
    ).select(
        F.col("cedent").alias("_id"),
        F.lit("Conjunction").alias("_connective"),
        F.lit(True).alias("_literal"),
        F.col("text").alias("Text"),
        F.array("first_child", "second_child").alias("BARef"),
    )
    table = F.struct(*[F.col(x).alias(f"_{x}") for x in "abcd"])
    sides = F.concat("antecedent", "consequent").cast("array<string>")
    listed = rule_text(four_fold(rules), item_values, names).select(
        F.concat(F.lit("AR"), F.array_join(sides, "_")).alias("_id"),
        F.when(F.size("antecedent") > 0, cedent_id(F.col("antecedent"))).alias("_antecedent"),
        cedent_id(F.col("consequent")).alias("_consequent"),
        F.col("text").alias("Text"),
        table.alias("FourFtTable"),
    )
    return {"BBA": basic, "DBA": compound, "AssociationRule": listed}


def headers(notes: Sequence[StageNote], rule_count: int) -> list[tuple[str, int]]:
    """Name/value pairs that describe the run."""
    pairs = [("number-of-rules", rule_count)]
    for note in notes:
        pairs += [(f"{note.kind}-with-rulelength", note.rule_length), (f"{note.kind}-with-size", note.size)]
    return pairs


def header_elements(spark, notes: Sequence[StageNote], rule_count: int) -> DataFrame:
    return spark.createDataFrame(headers(notes, rule_count), "_name string, _value long")


def write_rules_document(
    rules: DataFrame,
    item_values: DataFrame,
    names: DataFrame,
    folder: str,
    notes: Sequence[StageNote] = (),
    file: str = "rules.xml",
) -> str:
    """One well-formed document: headers, basic items, compound cedents and rules; gives its path.

    Every element is written by the task that has it, in the order of kinds and ids; the commit
    joins the parts.  Nothing but counts comes to the driver.
    """
    rules = materialize(rules, "rules")
    parts = rule_elements(rules, item_values, names)
    elements = union_all(
        [
            parts[tag].select(F.lit(place).alias("place"), F.col("_id").alias("id"), F.to_xml(F.struct("*"), {"rowTag": tag}).alias("line"))
            for place, tag in enumerate(ELEMENTS)
        ]
    )
    count = rules.count()
    pairs = "".join(f"<Extension name={quoteattr(name)} value={quoteattr(str(value))}/>\n" for name, value in headers(notes, count))
    head = f"{DOCUMENT_START}<Header>\n{pairs}</Header>\n{MODEL_START.format(rules=count)}"
    ordered = elements.repartitionByRange("place", "id").sortWithinPartitions("place", "id")
    return write_joined(ordered.select("line"), folder, file, head, DOCUMENT_END)


def write_rules_xml(
    rules: DataFrame,
    item_values: DataFrame,
    names: DataFrame,
    path: str,
    notes: Sequence[StageNote] = (),
) -> None:
    """One folder each for basic items, compound cedents, rules and headers."""
    rules = materialize(rules, "rules")
    parts = rule_elements(rules, item_values, names)
    parts["Extension"] = header_elements(rules.sparkSession, notes, rules.count())
    for tag, frame in parts.items():
        (
            frame.write.format("xml")
            .option("rootTag", f"{tag}List")
            .option("rowTag", tag)
            .save(f"{path}/{tag}")
        )


def write_rules_parquet(rules: DataFrame, path: str) -> None:
    rules.write.parquet(path)
