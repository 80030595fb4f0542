"""From wide rows to the narrow (id, field, value) form that everything else reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.functions.numbers import locale_number
from itemloom.model import Field, FieldType, require
from itemloom.runtime import number_rows

FIELDS_SCHEMA = "field int, name string, type string"


def fields_frame(spark, fields: Sequence[Field]) -> DataFrame:
    rows = [(f.field, f.name, f.type.value) for f in fields]
    return spark.createDataFrame(rows, FIELDS_SCHEMA)


def select_fields(df: DataFrame, types: Sequence[FieldType | None]) -> tuple[DataFrame, list[Field]]:
    """Keep the columns that were given a type, in order; ``None`` drops a column."""
    require(
        len(types) == len(df.columns),
        f"{len(df.columns)} columns but {len(types)} types",
    )
    kept = [(name, kind) for name, kind in zip(df.columns, types) if kind is not None]
    require(len(kept) > 0, "at least one field is needed")
    fields = [Field(i, name, kind) for i, (name, kind) in enumerate(kept, start=1)]
    return df.select(*[F.col(f"`{name}`") for name, _ in kept]), fields


def apply_null_tokens(df: DataFrame, tokens: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Trim text cells and turn every cell that equals one of ``tokens`` into a missing one."""
    chosen = set(df.columns if columns is None else columns)
    token_list = sorted(tokens)

    def clean(name: str) -> Column:
        cell = F.trim(F.col(f"`{name}`"))
        present = ~cell.isin(token_list) if token_list else F.lit(True)
        return F.when(present, cell).alias(name)

    return df.select(*[clean(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str = "id") -> DataFrame:
    """Dense row ids 1..n in the order of ``order_by``, which must be a total order."""
    return number_rows(df, list(order_by), name)


def cell(df: DataFrame, field: Field, locale: str = "en", prefix: bool = False) -> tuple[Column, Column]:
    """Text and number of a wide column; text is typed cell by cell."""
    column = F.col(f"`{field.name}`")
    kind = df.schema[field.name].dataType
    if isinstance(kind, T.NumericType):
        number = column.cast("double")
    elif isinstance(kind, T.StringType):
        number = locale_number(column, locale, prefix)
    else:
        number = F.lit(None).cast("double")
    return column.cast("string"), number


def _typed_cell(df: DataFrame, field: Field, locale: str, prefix: bool) -> Column:
    text, number = cell(df, field, locale, prefix)
    return F.struct(
        F.lit(field.field).alias("field"), text.alias("value_nominal"), number.alias("value_numeric")
    )


def to_instances(
    wide: DataFrame,
    id_column: str,
    fields: Sequence[Field],
    locale: str = "en",
    prefix: bool = False,
) -> DataFrame:
    """One row per non-missing cell: ``id, field, value_nominal, value_numeric``.

    Text is typed cell by cell whatever the declared type, since the type is only
    a view on the data.  Only the columns of ``fields`` are read; no shuffle.
    """
    cells = F.array(*[_typed_cell(wide, f, locale, prefix) for f in fields])
    return wide.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.inline(cells)
    ).where(F.col("value_nominal").isNotNull())


def type_values(narrow: DataFrame, locale: str = "en", prefix: bool = False) -> DataFrame:
    """Retype the text of narrow rows for a locale; the original text stays."""
    return narrow.withColumn("value_numeric", locale_number(F.col("value_nominal"), locale, prefix))
