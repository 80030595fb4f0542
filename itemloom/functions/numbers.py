"""Recognising numbers in text, and locating numbers among cut points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from itemloom.model import require

_WHOLE = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)(E-?[0-9]+)?$"
_PREFIX = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)(E-?[0-9]+)?"


def locale_signs(locale: str) -> tuple[str, str]:
    """Group separators and decimal sign of a locale tag such as ``de`` or ``pt-BR``, as Java has them."""
    java = SparkSession.active()._jvm.java
    place = java.util.Locale.forLanguageTag(locale.replace("_", "-"))
    require(place.getLanguage() != "", f"unknown locale {locale!r}")
    signs = java.text.DecimalFormatSymbols.getInstance(place)
    group = str(signs.getGroupingSeparator())
    # texts often have the wider of the two blanks that do not break
    return ("\u00a0\u202f" if group in "\u00a0\u202f" else group), str(signs.getDecimalSeparator())


def locale_number(text: Column, locale: str = "en", prefix: bool = False) -> Column:
    """The double a text stands for in ``locale``, or null.

    A blank counts as a non-breaking space, group separators are skipped.  The
    whole cell has to be a number unless ``prefix`` asks for the leading part.
    """
    group, decimal = locale_signs(locale)
    plain = F.translate(text, " ", "\u00a0")
    # translate drops characters that have no counterpart
    plain = F.translate(plain, decimal + group, ".")
    if prefix:
        lead = F.regexp_extract(plain, _PREFIX, 0)
        return F.when(lead != "", lead).cast("double")
    return F.when(plain.rlike(_WHOLE), plain).cast("double")


def literal_number(text: Column) -> Column:
    """The double of an RDF literal; the whole lexical form must be a number."""
    return text.try_cast("double")


def segment(value: Column, cuts: Sequence[tuple[float, int]], labels: Sequence[Column]) -> Column:
    """The label of the segment that holds ``value``.

    ``cuts`` are sorted ``(number, side)`` pairs: side 0 starts the next segment
    at the number, side 1 right above it.  Segment ``i`` lies between cuts
    ``i-1`` and ``i``.  The comparisons form a balanced tree, so a thousand
    segments cost ten comparisons per row and no join.
    """

    def branch(low: int, high: int) -> Column:
        if low == high:
            return labels[low]
        middle = (low + high) // 2
        number, side = cuts[middle]
        left = value < F.lit(number) if side == 0 else value <= F.lit(number)
        return F.when(left, branch(low, middle)).otherwise(branch(middle + 1, high))

    return branch(0, len(cuts))


def equal_width_bin(number: Column, low: Column, width: Column, count: int) -> Column:
    """The number of the equal-width bin that holds a number at or above ``low``.

    Bin ``i`` begins at ``low + i * width`` as it is shown.  The quotient may round to the
    other side of a border, so its neighbours are compared with the borders themselves.
    """
    guess = F.greatest(F.least(F.floor((number - low) / width).cast("int"), F.lit(count - 1)), F.lit(0))
    up = ((guess < count - 1) & (number >= low + (guess + 1) * width)).cast("int")
    down = ((guess > 0) & (number < low + guess * width)).cast("int")
    return guess + up - down
