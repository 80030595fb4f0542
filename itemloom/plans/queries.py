"""One query per operator over the supplied tables; ``oracles`` has the same in SQL.

Every query works on whole tables.  Ratios are rounded to six places so that two
engines can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions.labels import interval_label
from itemloom.functions.numbers import locale_number
from itemloom.model import (
    AllOf,
    Border,
    CsvOptions,
    Enumeration,
    Equidistant,
    Equifrequent,
    Equisized,
    FieldType,
    Interval,
    Intervals,
    Is,
    MiningTask,
    Not,
    Or,
    Simple,
)
from itemloom.operators import attributes as attr
from itemloom.operators import cedents, classify, cuts, itemsets, profile, rules, views, wording
from itemloom.plans import mining
from itemloom.runtime import materialize, scratch_path, union_all
from itemloom.sources import delimited, export, narrow, streams, tables, triples
from itemloom.sources.stored import StoredDataset, StoredSource
from itemloom.streaming.support import final_support

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SUPPORT, CONFIDENCE, LENGTH, LIMIT = 0.01, 0.3, 3, 100
STATUS, PRIORITY, SEGMENT = 1, 2, 3


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- data sources and datasets ----------------------------------------------


def orders_source(spark, sf_dir) -> attr.DataSource:
    return tables.data_source(tables.orders_wide(spark, sf_dir), tables.ORDER_FIELDS)


def events_source(spark, sf_dir) -> attr.DataSource:
    return tables.data_source(tables.events_wide(spark, sf_dir), tables.EVENT_FIELDS)


def part_source(spark, sf_dir) -> attr.DataSource:
    return tables.data_source(tables.part_wide(spark, sf_dir), tables.PART_FIELDS)


def docs_source(spark, sf_dir) -> attr.DataSource:
    return tables.data_source(tables.docs_wide(spark, sf_dir), tables.DOC_FIELDS)


ORDER_SPECS = (
    Simple(STATUS, "status", 1),
    Simple(PRIORITY, "priority", 2),
    Simple(SEGMENT, "segment", 3),
)


def orders_dataset(spark, sf_dir) -> attr.Dataset:
    """Status, priority and segment of every order; only these columns are profiled."""
    wide = tables.orders_wide(spark, sf_dir).select("id", "status", "priority", "segment")
    source = tables.data_source(wide, tables.ORDER_FIELDS[:3])
    return attr.build_attributes(source, ORDER_SPECS)


def basket_dataset(spark, sf_dir) -> attr.Dataset:
    instances = tables.baskets(spark, sf_dir)
    values = profile.value_frequencies(instances)
    source = attr.DataSource(tables.BASKET_FIELDS, instances, values)
    return attr.build_attributes(source, [Simple(1, "type", 1), Simple(2, "brand", 2)])


def docs_dataset(spark, sf_dir) -> attr.Dataset:
    specs = [Simple(1, "lang", 1), Simple(2, "quality", 4), Simple(3, "toxic", 5)]
    return attr.build_attributes(docs_source(spark, sf_dir), specs)


def item_of(dataset: attr.Dataset, attribute: int, value: str) -> int:
    found = dataset.item_values.where((F.col("attribute") == attribute) & (F.col("value") == value))
    return found.select("item").first()["item"]


def order_task(**changes) -> MiningTask:
    base = dict(limit=LIMIT, min_confidence=CONFIDENCE, min_support=SUPPORT, max_length=LENGTH)
    return MiningTask(**{**base, **changes})


def all_rules(dataset: attr.Dataset, max_length: int = LENGTH, task: MiningTask | None = None) -> DataFrame:
    search = mining.open_search(dataset, task or order_task(), SUPPORT)
    for search in itemsets.grow(search, max_length):
        pass
    return materialize(rules.association_rules(search, CONFIDENCE, 1, max_length), "rules")


def shown_rules(found: DataFrame, dataset: attr.Dataset) -> DataFrame:
    worded = wording.rule_text(found, dataset.item_values, dataset.names())
    return worded.selectExpr(
        "text",
        "CAST(length AS BIGINT) AS length",
        *[f"round({name}, 6) AS {name}" for name in ("support", "confidence", "lift")],
    )


def joined_texts(items: str, item_values: DataFrame, frame: DataFrame) -> DataFrame:
    """Replace an array of item ids by the items' texts in id order."""
    keyed = frame.select(items).distinct()
    texts = (
        keyed.select(F.col(items), F.posexplode(items).alias("at", "item"))
        .join(item_values.select("item", "value"), "item")
        .groupBy(items)
        .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
        .select(items, F.array_join(F.transform("parts", lambda p: p["value"]), ",").alias("texts"))
    )
    return frame.join(texts, items).drop(items)


# -- scans, sources, sinks ---------------------------------------------------


def _as_csv(frame: DataFrame, compression: str | None = None) -> str:
    path = scratch_path(frame.sparkSession, "csv")
    writer = frame.write.option("header", True).option("escape", '"').option("quote", '"')
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
    return path


@query
def csv_scan(spark, sf_dir):
    """Whole documents with quotes and line breaks through delimited text."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return delimited.read_csv(spark, _as_csv(docs))


@query
def csv_select_fields(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    read = delimited.read_csv(spark, _as_csv(part))
    kept, _ = narrow.select_fields(read, [FieldType.NOMINAL, None, FieldType.NOMINAL, FieldType.NUMERIC])
    return kept


@query
def csv_null_tokens(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select("event_id", "event_type")
    return narrow.apply_null_tokens(events, ["error"], ["event_type"])


@query
def cell_typing(spark, sf_dir):
    """Priorities like ``5-LOW`` stay text; prices are typed."""
    wide = tables.orders_wide(spark, sf_dir).select(
        "id", "priority", F.col("totalprice").cast("string").alias("totalprice")
    )
    return narrow.to_instances(wide, "id", [tables.ORDER_FIELDS[1], tables.ORDER_FIELDS[3]])


@query
def cell_typing_locale(spark, sf_dir):
    """Prices written with a decimal comma and dots between thousands."""
    price = F.col("o_totalprice")
    whole = F.floor(price)
    cents = F.lpad(F.floor((price - whole) * 100 + 0.5).cast("string"), 2, "0")
    german = F.concat(F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), cents)
    orders = tables.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.round(locale_number(german, "de"), 2).alias("value"))


@query
def csv_compressed(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    zipped = scratch_path(spark, "zip")
    streams.write_zip(part.select(F.to_csv(F.struct("*"))), zipped, ",".join(part.columns))
    paths = {"gzip": _as_csv(part, "gzip"), "bzip2": _as_csv(part, "bzip2"), "zip": zipped}
    read = [
        delimited.read_csv(spark, path, CsvOptions(compression=kind)).withColumn("compression", F.lit(kind))
        for kind, path in paths.items()
    ]
    return union_all(read)


@query
def record_checks(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    _, rejected = delimited.check_records(docs)
    return rejected.select("doc_id", F.array_join("errors", ", ").alias("errors"))


@query
def csv_options(spark, sf_dir):
    """Event types and values, where ``error`` is a missing type, read through the options."""
    events = tables.table(spark, sf_dir, "events").select("event_id", "props", "event_type")
    options = CsvOptions(null_values=frozenset({"error"}), types=(FieldType.NUMERIC, None, FieldType.NOMINAL))
    return delimited.read_csv(spark, _as_csv(events), options)


@query
def record_widths(spark, sf_dir):
    """Text records of which every tenth lacks a value and every tenth has one too many."""
    part = tables.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    line = (
        F.when(F.col("p_partkey") % 10 == 3, F.concat_ws(",", key, "p_brand"))
        .when(F.col("p_partkey") % 10 == 7, F.concat_ws(",", key, "p_brand", "p_type", F.lit("more")))
        .otherwise(F.concat_ws(",", key, "p_brand", "p_type"))
    )
    path = scratch_path(spark, "records")
    # the header of every file is the name of the one column; no cell has the separator chosen here
    part.select(line.alias("part,brand,type")).write.option("header", True).option("sep", "\x01").csv(path)
    read = delimited.read_csv(spark, path, CsvOptions(multi_line=False), "PERMISSIVE")
    _, rejected = delimited.check_records(read)
    return rejected.select("part", F.array_join("errors", ", ").alias("errors"))


@query
def text_preview(spark, sf_dir):
    path = scratch_path(spark, "lines")
    events = tables.table(spark, sf_dir, "events").orderBy("event_id")
    events.select(F.concat_ws(";", "event_id", "event_type")).write.text(path)
    return delimited.preview(spark, path, 20)


def _event_triples(spark, sf_dir) -> DataFrame:
    """The events as N-Triples text, read back: URIs, typed numbers and escaped texts."""
    escaped = F.regexp_replace("props", r'(["\\])', r"\\$1")
    subject = F.concat(F.lit("<urn:user:"), F.col("user_id"), F.lit("> "))
    kind = F.when(
        F.col("event_type") == "view", F.concat(F.lit("<urn:type:"), "event_type", F.lit(">"))
    ).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    number = F.concat(
        F.lit('"'), F.col("value").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double>')
    )
    lines = F.array(
        F.concat(subject, F.lit("<urn:event_type> "), kind, F.lit(" .")),
        F.concat(subject, F.lit("<urn:value> "), number, F.lit(" .")),
        F.concat(subject, F.lit('<urn:props> "'), escaped, F.lit('"@en <urn:graph:events> .')),
    )
    path = scratch_path(spark, "triples")
    tables.table(spark, sf_dir, "events").select(F.explode(lines)).write.text(path)
    return triples.read_triples(spark, path)


@query
def rdf_scan(spark, sf_dir):
    return _event_triples(spark, sf_dir)


@query
def rdf_fields(spark, sf_dir):
    return triples.triples_fields(_event_triples(spark, sf_dir))


@query
def rdf_transactions(spark, sf_dir):
    read = _event_triples(spark, sf_dir)
    return triples.triples_instances(read, triples.triples_fields(read))


@query
def row_ids(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return narrow.with_row_id(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@query
def narrow_instances(spark, sf_dir):
    return narrow.to_instances(tables.part_wide(spark, sf_dir), "id", tables.PART_FIELDS)


@query
def streaming_support(spark, sf_dir):
    schema = tables.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    wide = stream.select(
        F.col("event_id").alias("id"), "event_type", "value", F.col("user_id").cast("double").alias("user_id")
    )
    return final_support(spark, wide, "id", tables.EVENT_FIELDS)


@query
def rules_xml(spark, sf_dir):
    """Rules written as one XML document; its three lists and its headers read back."""
    dataset = orders_dataset(spark, sf_dir)
    path = export.write_rules_document(all_rules(dataset), dataset.item_values, dataset.names(), scratch_path(spark, "rules"))

    def elements(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    basic = elements("BBA", "_id string, Text string, FieldRef string, CatRef string")
    compound = elements("DBA", "_id string, Text string, BARef array<string>")
    listed = elements(
        "AssociationRule",
        "_antecedent string, _consequent string, Text string, FourFtTable struct<_a: bigint, _b: bigint, _c: bigint, _d: bigint>",
    )
    header = elements("Extension", "_name string, _value bigint")
    # references are shown by the texts they stand for
    texts = basic.select("_id", "Text").unionByName(compound.select("_id", "Text"))
    children = (
        compound.select("_id", "Text", F.posexplode("BARef").alias("at", "child"))
        .join(texts.selectExpr("_id AS child", "Text AS named"), "child")
        .groupBy("_id", "Text")
        .agg(F.array_sort(F.collect_list(F.struct("at", "named"))).alias("parts"))
    )
    sides = listed.join(texts.selectExpr("_id AS _antecedent", "Text AS left_text"), "_antecedent", "left").join(
        texts.selectExpr("_id AS _consequent", "Text AS right_text"), "_consequent"
    )
    none = [F.lit(None).cast("bigint").alias(x) for x in "abcd"]
    return union_all(
        [
            header.select(F.lit("header").alias("kind"), F.col("_name").alias("text"), F.lit("").alias("refs"), F.col("_value").alias("a"), *none[1:]),
            basic.select(F.lit("BBA").alias("kind"), F.col("Text").alias("text"), F.concat_ws("=", "FieldRef", "CatRef").alias("refs"), *none),
            children.select(
                F.lit("DBA").alias("kind"), F.col("Text").alias("text"), F.array_join(F.transform("parts", lambda p: p["named"]), ",").alias("refs"), *none
            ),
            sides.select(
                F.lit("rule").alias("kind"), F.col("Text").alias("text"), F.concat(F.coalesce("left_text", F.lit("*")), F.lit(","), "right_text").alias("refs"),
                *[F.col(f"FourFtTable._{x}").alias(x) for x in "abcd"],
            ),
        ]
    )


@query
def json_values(spark, sf_dir):
    source = part_source(spark, sf_dir)
    return views.values_as_json(source.values)


@query
def json_instances(spark, sf_dir):
    source = part_source(spark, sf_dir)
    fields = narrow.fields_frame(spark, source.fields)
    page = views.aggregated_page(source.instances, fields, [1, 2], 20, 50, source.size)
    return views.instances_as_json(page)


@query
def json_intervals(spark, sf_dir):
    source = events_source(spark, sf_dir)
    bins = profile.histogram(source.frequencies([2]), 2, 8, Border(50.0, False), Border(300.0))
    return views.intervals_as_json(bins)


# -- profile -----------------------------------------------------------------


@query
def value_frequencies(spark, sf_dir):
    return profile.value_frequencies(narrow.to_instances(tables.part_wide(spark, sf_dir), "id", tables.PART_FIELDS))


@query
def field_support(spark, sf_dir):
    return profile.field_support(narrow.to_instances(tables.docs_wide(spark, sf_dir), "id", tables.DOC_FIELDS))


@query
def field_cardinality(spark, sf_dir):
    return profile.field_cardinality(orders_source(spark, sf_dir).values)


@query
def field_sketches(spark, sf_dir):
    """Exact distinct counts, and whether sketches of two loads of the orders come within 5 per cent."""
    wide = tables.orders_wide(spark, sf_dir)
    loads = [narrow.to_instances(wide.where(F.col("id") % 2 == half), "id", tables.ORDER_FIELDS) for half in (0, 1)]
    stored = materialize(union_all([profile.field_sketches(load) for load in loads]), "sketches")
    guessed = profile.sketched_cardinality(stored).selectExpr("field", "distinct_nominal AS texts", "distinct_numeric AS numbers")
    exact = profile.field_cardinality(orders_source(spark, sf_dir).values)
    near = [F.abs(F.col(g) - F.col(e)) <= 0.05 * F.col(e) for g, e in (("texts", "distinct_nominal"), ("numbers", "distinct_numeric"))]
    return exact.join(guessed, "field").select("field", "distinct_nominal", "distinct_numeric", (near[0] & near[1]).alias("near"))


@query
def field_stats(spark, sf_dir):
    cells = narrow.to_instances(tables.orders_wide(spark, sf_dir), "id", tables.ORDER_FIELDS)
    return profile.field_stats(cells).select("field", "min", "max", F.round("avg", 6).alias("avg"))


@query
def source_size(spark, sf_dir):
    return profile.data_source_size(tables.docs_wide(spark, sf_dir))


@query
def source_profile(spark, sf_dir):
    source = docs_source(spark, sf_dir)
    found = profile.profile_fields(narrow.fields_frame(spark, source.fields), source.instances, source.values)
    return found.withColumn("avg", F.round("avg", 6))


@query
def field_detail(spark, sf_dir):
    source = docs_source(spark, sf_dir)
    return profile.field_detail(
        profile.profile_fields(narrow.fields_frame(spark, source.fields), source.instances, source.values)
    )


@query
def numeric_stats(spark, sf_dir):
    cells = narrow.to_instances(tables.events_wide(spark, sf_dir), "id", tables.EVENT_FIELDS)
    fields = narrow.fields_frame(spark, tables.EVENT_FIELDS)
    found = profile.numeric_stats(fields, profile.field_stats(cells), 2)
    return found.withColumn("avg", F.round("avg", 6))


def _rounded_bins(bins: DataFrame) -> DataFrame:
    return bins.withColumns({c: F.round(c, 6) for c in ("from", "to")})


@query
def histogram(spark, sf_dir):
    return _rounded_bins(profile.histogram(events_source(spark, sf_dir).frequencies([2]), 2, 10))


@query
def histogram_bounded(spark, sf_dir):
    values = events_source(spark, sf_dir).values
    return _rounded_bins(profile.histogram(values, 2, 8, Border(50.0, False), Border(300.0)))


@query
def attribute_cardinality(spark, sf_dir):
    return profile.attribute_cardinality(orders_dataset(spark, sf_dir).item_values)


# -- views and edits ---------------------------------------------------------


@query
def instances_page(spark, sf_dir):
    cells = narrow.to_instances(tables.part_wide(spark, sf_dir), "id", tables.PART_FIELDS)
    return views.instances_page(cells, narrow.fields_frame(spark, tables.PART_FIELDS), [1, 3], 20, 50)


@query
def aggregated_page(spark, sf_dir):
    """Documents without a label have no cell of the chosen fields."""
    source = docs_source(spark, sf_dir)
    fields = narrow.fields_frame(spark, source.fields)
    page = views.aggregated_page(source.instances, fields, [4, 5], 20, 50, source.size)
    cells = F.transform("cells", lambda c: F.concat_ws("=", c["field"], c["value_nominal"]))
    return page.select("id", F.array_join(cells, ",").alias("cells"))


@query
def typed_instances(spark, sf_dir):
    """A field read as numbers shows only the cells that are numbers."""
    fields = [tables.ORDER_FIELDS[0], tables.Field(2, "priority", FieldType.NUMERIC), tables.ORDER_FIELDS[3]]
    cells = narrow.to_instances(tables.orders_wide(spark, sf_dir), "id", fields)
    return views.typed_instances(cells, narrow.fields_frame(spark, fields))


@query
def values_page(spark, sf_dir):
    source = part_source(spark, sf_dir)
    return views.values_page(source.values, narrow.fields_frame(spark, source.fields), 4, 20, 50)


@query
def items_page(spark, sf_dir):
    source = part_source(spark, sf_dir)
    dataset = attr.build_attributes(source, [Simple(1, "brand", 1), Simple(2, "type", 2)])
    return views.items_page(dataset.item_values, 1, 5, 10)


@query
def change_field_type(spark, sf_dir):
    """Flip a numeric field, a nominal one without numbers, and a nominal one with numbers."""
    wide = tables.docs_wide(spark, sf_dir)
    fields = [*tables.DOC_FIELDS[:4], tables.Field(5, "toxic", FieldType.NOMINAL)]
    source = tables.data_source(wide, fields)
    found = profile.profile_fields(narrow.fields_frame(spark, fields), source.instances, source.values)
    parts = [
        views.change_field_type(found, field).select(F.lit(field).alias("flipped"), "field", "type", "changed")
        for field in (4, 1, 5)
    ]
    return rules.merge_results(parts)


@query
def drop_field(spark, sf_dir):
    source = part_source(spark, sf_dir)
    fields = narrow.fields_frame(spark, source.fields)
    kept, cells, values = views.drop_field(fields, source.instances, source.values, 3)
    counted = profile.field_support(cells).select("field", "support_nominal")
    distinct = profile.field_cardinality(values).select("field", "distinct_nominal")
    return kept.select("field", "name").join(counted, "field").join(distinct, "field")


@query
def drop_attribute(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    names, instances, values = views.drop_attribute(
        dataset.names(), dataset.item_instances, dataset.item_values, PRIORITY
    )
    counted = instances.groupBy("attribute").agg(F.count(F.lit(1)).alias("instances"))
    return names.join(counted, "attribute").join(profile.attribute_cardinality(values), "attribute")


def _database(spark) -> str:
    """A database of its own in the scratch folder."""
    name = f"stored_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'stored')}'")
    return name


@query
def stored_source(spark, sf_dir):
    """A stored source without its third field: supports and distinct values of the others."""
    kept = StoredSource.create(f"{_database(spark)}.part", part_source(spark, sf_dir))
    kept.drop_field(3)
    left = kept.load()
    counted = profile.field_support(left.instances).select("field", "support_nominal")
    distinct = profile.field_cardinality(left.values).select("field", "distinct_nominal")
    return narrow.fields_frame(spark, left.fields).select("field", "name").join(counted, "field").join(distinct, "field")


@query
def stored_dataset(spark, sf_dir):
    """Attributes of two builds, one of them dropped and built again: ids go on, rows per item."""
    source = tables.data_source(
        tables.orders_wide(spark, sf_dir).select("id", "status", "priority", "segment"), tables.ORDER_FIELDS[:3]
    )
    kept = StoredDataset.create(spark, f"{_database(spark)}.orders")
    kept.add(source, ORDER_SPECS[:2])
    kept.add(source, ORDER_SPECS[2:])
    kept.drop_attribute(PRIORITY)
    kept.add(source, [ORDER_SPECS[1]])
    counted = kept.item_instances().groupBy("item").agg(F.count(F.lit(1)).alias("instances"))
    return kept.item_values().join(counted, "item").select("attribute", "item", "value", "instances")


# -- attributes --------------------------------------------------------------


@query
def simple_attribute(spark, sf_dir):
    source = part_source(spark, sf_dir)
    specs = [Simple(1, "brand", 1), Simple(2, "size", 3)]
    return attr.build_attributes(source, specs).item_values


PRIORITY_GROUPS = Enumeration(
    1, "urgency", 2, bins=(("high", ("1-URGENT", "2-HIGH")), ("low", ("5-LOW",)))
)
SIZE_GROUPS = Intervals(
    1,
    "size_group",
    3,
    bins=(
        ("small", (Interval(Border(1.0), Border(10.0)),)),
        ("mid", (Interval(Border(10.0, False), Border(30.0)),)),
        ("large", (Interval(Border(30.0, False), Border(float("inf"), False)),)),
    ),
)


@query
def nominal_enumeration(spark, sf_dir):
    return attr.build_attributes(orders_source(spark, sf_dir), [PRIORITY_GROUPS]).item_values


@query
def numeric_intervals(spark, sf_dir):
    dataset = attr.build_attributes(part_source(spark, sf_dir), [SIZE_GROUPS])
    named = dataset.item_instances.join(dataset.item_values.select("item", "value"), "item")
    return named.select("id", "attribute", "value")


@query
def equidistant(spark, sf_dir):
    """Five bins of equal width over account balances, with labels and item ids."""
    source = orders_source(spark, sf_dir)
    return attr.build_attributes(source, [Equidistant(1, "balance", 5, bins=5)]).item_values


@query
def equifrequent(spark, sf_dir):
    source = orders_source(spark, sf_dir)
    return attr.build_attributes(source, [Equifrequent(1, "price", 4, bins=10)]).item_values


@query
def equifrequent_sparse(spark, sf_dir):
    """A source with many missing cells, where smoothing has far to move."""
    events = tables.events_wide(spark, sf_dir)
    wide = events.select("id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    source = tables.data_source(wide, [tables.Field(2, "value", FieldType.NUMERIC)])
    return attr.build_attributes(source, [Equifrequent(1, "value", 2, bins=20)]).item_values


@query
def equisized(spark, sf_dir):
    source = events_source(spark, sf_dir)
    return attr.build_attributes(source, [Equisized(1, "value", 2, support=0.1)]).item_values


@query
def interval_smoothing(spark, sf_dir):
    """Order-line quantities: equal-frequency bins with their frequencies as shares."""
    lines = tables.table(spark, sf_dir, "lineitem")
    wide = lines.select(F.lit(0).alias("id"), F.col("l_quantity").alias("quantity"))
    source = tables.data_source(wide, [tables.Field(1, "quantity", FieldType.NUMERIC)])
    (built,) = attr.balanced(source, [Equifrequent(1, "quantity", 1, bins=7)])
    return built.bins.withColumn("share", F.round(F.col("frequency") / source.size, 6))


@query
def cut_points(spark, sf_dir):
    """Closed ranges of event values, joined half-way between neighbours."""
    events = tables.table(spark, sf_dir, "events")
    closed = events.groupBy(F.floor(F.col("value") / 50).cast("int").alias("bin")).agg(
        F.min("value").alias("from"), F.max("value").alias("to"), F.count(F.lit(1)).alias("frequency")
    )
    return _rounded_bins(cuts.merge_cut_points(closed.withColumn("attribute", F.lit(1))))


@query
def interval_labels(spark, sf_dir):
    """A label for the half-open price band of every part."""
    low = F.floor(F.col("p_retailprice") / 7) * 7.0 + F.col("p_size") / 7.0
    part = tables.table(spark, sf_dir, "part")
    label = interval_label(low, low + 7, F.col("p_size") > 10, F.col("p_size") > 40)
    return part.select("p_partkey", label.alias("label"))


@query
def item_ids(spark, sf_dir):
    source = part_source(spark, sf_dir)
    counted = attr.labelled(
        source.values, source, [Simple(1, "brand", 1), Simple(2, "type", 2), Simple(3, "price", 4)]
    )
    return attr.assign_item_ids(counted.groupBy("attribute", "value").agg(F.sum("frequency").alias("frequency")), 100)


@query
def item_instances(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return dataset.item_instances


@query
def many_attributes(spark, sf_dir):
    """Four kinds of attributes at once, two of them on one field."""
    source = part_source(spark, sf_dir)
    specs = [
        Simple(1, "brand", 1),
        Enumeration(2, "type", 2, bins=(("plain", ("SMALL", "MEDIUM")), ("fine", ("MEDIUM", "PROMO")))),
        Intervals(3, "size_group", 3, bins=SIZE_GROUPS.bins),
        Equidistant(4, "size_band", 3, bins=7),
    ]
    dataset = attr.build_attributes(source, specs)
    per_item = dataset.item_instances.groupBy("attribute", "item").agg(F.count(F.lit(1)).alias("rows"))
    return dataset.item_values.join(per_item, ["attribute", "item"]).select(
        "attribute", "value", "frequency", "rows"
    )


@query
def lookup_items(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    priorities = tables.table(spark, sf_dir, "orders").select(
        F.lit(PRIORITY).alias("attribute"), F.col("o_orderpriority").alias("value")
    )
    types = tables.table(spark, sf_dir, "events").select(
        F.lit(PRIORITY).alias("attribute"), F.col("event_type").alias("value")
    )
    return attr.lookup_items(priorities.union(types).distinct(), dataset.item_values)


@query
def lookup_values(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    wanted = tables.table(spark, sf_dir, "part").select(
        F.lit(SEGMENT).alias("attribute"), F.col("p_size").cast("long").alias("item")
    )
    return attr.lookup_values(wanted.distinct(), dataset.item_values)


# -- cedents -----------------------------------------------------------------


def _left(dataset) -> Or:
    return Or(AllOf(PRIORITY), Is(SEGMENT, item_of(dataset, SEGMENT, "BUILDING")))


def _items(dataset: attr.Dataset, chosen: DataFrame) -> DataFrame:
    return chosen.join(dataset.item_values.select("item", "value"), "item")


@query
def item_predicate(spark, sf_dir):
    """A conjunction over two attributes names the items of both; negation names all others."""
    dataset = orders_dataset(spark, sf_dir)
    both = AllOf(STATUS) & Is(SEGMENT, item_of(dataset, SEGMENT, "BUILDING"))
    return dataset.item_values.select(
        "attribute",
        "value",
        cedents.item_predicate(both).alias("in_both"),
        cedents.item_predicate(Not(both)).alias("in_neither"),
    )


@query
def select_items(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return _items(dataset, cedents.select_items(dataset.item_values, _left(dataset))).select("attribute", "value")


@query
def intersect_items(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    left = cedents.select_items(dataset.item_values, _left(dataset))
    right = cedents.select_items(dataset.item_values, AllOf(SEGMENT))
    return _items(dataset, cedents.intersect_items(left, right)).select("attribute", "value")


@query
def subtract_items(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    left = cedents.select_items(dataset.item_values, AllOf(SEGMENT))
    right = cedents.select_items(dataset.item_values, _left(dataset))
    return _items(dataset, cedents.subtract_items(left, right)).select("attribute", "value")


@query
def appearance(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    sides = cedents.appearance(dataset.item_values, _left(dataset), AllOf(STATUS) | AllOf(SEGMENT))
    return _items(dataset, sides).select("attribute", "value", "can_lhs", "can_rhs")


@query
def filter_item_instances(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    kept = cedents.filter_item_instances(dataset.item_instances, _left(dataset), AllOf(STATUS))
    return kept.select("id", "attribute", "item")


# -- mining ------------------------------------------------------------------


@query
def basket_transactions(spark, sf_dir):
    dataset = basket_dataset(spark, sf_dir)
    return joined_texts("items", dataset.item_values, itemsets.transactions(dataset.item_instances))


@query
def longest_transaction(spark, sf_dir):
    return itemsets.max_transaction_length(basket_dataset(spark, sf_dir).item_instances)


@query
def frequent_itemsets(spark, sf_dir):
    """Types and brands bought together, up to three at a time."""
    dataset = basket_dataset(spark, sf_dir)
    found = itemsets.frequent_itemsets(dataset.item_instances, SUPPORT, LENGTH)
    found = found.select(
        "items", F.col("size").cast("long").alias("size"), "count", F.round("support", 6).alias("support")
    )
    return joined_texts("items", dataset.item_values, found)


@query
def association_rules(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return shown_rules(all_rules(dataset), dataset)


@query
def flagship(spark, sf_dir):
    """Rules of up to two items over orders, as text with their measures."""
    dataset = orders_dataset(spark, sf_dir)
    return shown_rules(all_rules(dataset, 2), dataset)


@query
def basket_rules(spark, sf_dir):
    """Rules over order baskets, where an attribute has several values per order."""
    dataset = basket_dataset(spark, sf_dir)
    return shown_rules(all_rules(dataset), dataset)


@query
def basket_task(spark, sf_dir):
    """The same as a mining task: several values per attribute do not bound the length."""
    dataset = basket_dataset(spark, sf_dir)
    return shown_rules(mining.mine(dataset, order_task(limit=1_000_000)).rules, dataset)


@query
def pattern_rules(spark, sf_dir):
    """Priority or the BUILDING segment on the left, status on the right."""
    dataset = orders_dataset(spark, sf_dir)
    task = order_task(antecedent=_left(dataset), consequent=AllOf(STATUS))
    return shown_rules(all_rules(dataset, LENGTH, task), dataset)


@query
def negated_pattern_rules(spark, sf_dir):
    """Anything but status O on the right."""
    dataset = orders_dataset(spark, sf_dir)
    task = order_task(consequent=Not(Is(STATUS, item_of(dataset, STATUS, "O"))))
    return shown_rules(all_rules(dataset, LENGTH, task), dataset)


@query
def lift_filter(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return shown_rules(rules.filter_lift(all_rules(dataset), 1.0), dataset)


def _with_table(table: DataFrame, dataset: attr.Dataset) -> DataFrame:
    worded = wording.rule_text(table, dataset.item_values, dataset.names())
    return worded.select("text", *"abcd")


@query
def four_fold(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return _with_table(rules.four_fold(all_rules(dataset)), dataset)


@query
def rule_measures(spark, sf_dir):
    """Measures derived from the 4-fold table."""
    dataset = orders_dataset(spark, sf_dir)
    return shown_rules(rules.measures_from_four_fold(rules.four_fold(all_rules(dataset))), dataset)


@query
def four_fold_from_measures(spark, sf_dir):
    """Labelled documents only: fewer transactions than the dataset has rows."""
    dataset = docs_dataset(spark, sf_dir)
    task = order_task(antecedent=AllOf(2), consequent=AllOf(3))
    found = all_rules(dataset, LENGTH, task)
    return _with_table(rules.four_fold_from_measures(found, dataset.size), dataset)


AMOUNT_GROUPS = (
    Intervals(
        4,
        "price",
        4,
        bins=(
            ("cheap", (Interval(Border(float("-inf"), False), Border(150000.0, False)),)),
            ("dear", (Interval(Border(300000.0), Border(float("inf"), False)),)),
            ("mid", (Interval(Border(150000.0), Border(300000.0, False)),)),
        ),
    ),
    Intervals(
        5,
        "balance",
        5,
        bins=(
            ("debt", (Interval(Border(float("-inf"), False), Border(0.0, False)),)),
            ("credit", (Interval(Border(0.0), Border(float("inf"), False)),)),
        ),
    ),
)


@query
def staged_mining(spark, sf_dir):
    """Five attributes of orders: rules up to length three first, then one length at a time."""
    dataset = attr.build_attributes(orders_source(spark, sf_dir), [*ORDER_SPECS, *AMOUNT_GROUPS])
    task = order_task(limit=1_000_000, max_length=4)
    parts = [
        shown_rules(stage.rules, dataset).withColumn("stage", F.lit(i))
        for i, stage in enumerate(mining.mine_staged(dataset, task), start=1)
    ]
    return rules.merge_results(parts)


@query
def rule_limit(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return shown_rules(rules.limit_rules(all_rules(dataset), LIMIT), dataset)


@query
def mining_task(spark, sf_dir):
    """The whole task with its limit; ``limited`` tells whether the limit cut the result."""
    dataset = orders_dataset(spark, sf_dir)
    result = mining.mine(dataset, order_task(min_lift=1.0, limit=50))
    return shown_rules(result.rules, dataset).withColumn("limited", F.lit(bool(result.notes)))


@query
def merged_results(spark, sf_dir):
    """Rules of two tasks together."""
    dataset = orders_dataset(spark, sf_dir)
    parts = [
        all_rules(dataset, LENGTH, order_task(consequent=AllOf(STATUS))),
        all_rules(dataset, 2, order_task(consequent=AllOf(PRIORITY))),
    ]
    return shown_rules(rules.merge_results(parts), dataset)


def _class_task(**changes) -> MiningTask:
    return order_task(consequent=AllOf(STATUS), prune=True, **changes)


@query
def rule_coverage(spark, sf_dir):
    """How many orders each status rule covers, and how many of them correctly."""
    dataset = orders_dataset(spark, sf_dir)
    found = all_rules(dataset, LENGTH, order_task(consequent=AllOf(STATUS)))
    ranked = classify.rank_rules(found)
    baskets = classify.labelled_baskets(dataset.item_instances, STATUS)
    counted = (
        classify.covering(baskets, ranked)
        .groupBy("rank")
        .agg(
            F.sum("weight").alias("covered"),
            F.sum(F.when(F.col("correct"), F.col("weight")).otherwise(0)).alias("correct"),
        )
    )
    worded = wording.rule_text(ranked, dataset.item_values, dataset.names())
    return worded.join(counted, "rank").select("text", "covered", "correct")


@query
def class_pruning(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return shown_rules(mining.mine(dataset, _class_task(max_length=LENGTH)).rules, dataset)


@query
def auto_thresholds(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    task = MiningTask(limit=LIMIT, auto=True, prune=True, consequent=AllOf(STATUS))
    return shown_rules(mining.mine(dataset, task).rules, dataset)


@query
def rule_text(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    return wording.rule_text(all_rules(dataset), dataset.item_values, dataset.names()).select("text", "n_both")


@query
def rule_items(spark, sf_dir):
    dataset = orders_dataset(spark, sf_dir)
    found = wording.rule_items(all_rules(dataset), dataset.item_values, dataset.names())
    return found.select("text", "name", "value")


@query
def rule_cedents(spark, sf_dir):
    """Compound left sides of basket rules and the sides they are made of."""
    dataset = basket_dataset(spark, sf_dir)
    found = wording.rule_cedents(all_rules(dataset)).select("items")
    return joined_texts("items", dataset.item_values, found)
