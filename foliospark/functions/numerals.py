"""Counter formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits by decimal place.
ROMAN = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "M", "MM", "MMM"),
)


def roman(n: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3999, else null."""
    n = n.cast("int")
    digit = lambda k: F.get(F.array(*map(F.lit, ROMAN[k])), F.floor(n / 10**k).cast("int") % 10)
    return F.when(n.between(1, 3999), F.concat(digit(3), digit(2), digit(1), digit(0)))


def letters(n: Column) -> Column:
    """Bijective base 26 (1 is A, 26 is Z, 27 is AA) of 1 to 1,000,000, else null."""
    n = n.cast("long")
    step = lambda acc, _: F.when(
        acc["rest"] > 0, F.struct(F.concat(F.chr(65 + F.pmod(acc["rest"] - 1, F.lit(26))), acc["out"]).alias("out"), F.floor((acc["rest"] - 1) / 26).alias("rest"))
    ).otherwise(acc)
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.struct(F.lit("").alias("out"), n.alias("rest")), step)
    return F.when(n.between(1, 1_000_000), digits["out"])


def counter(n: Column, form: str) -> Column:
    """A counter in one of the supported formats; null where the format has no such number."""
    text = n.cast("string")
    forms = {
        "decimal": text, "decimalZero": F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text),
        "upperRoman": roman(n), "lowerRoman": F.lower(roman(n)), "upperLetter": letters(n), "lowerLetter": F.lower(letters(n)), "none": F.lit(""),
    }
    return forms.get(form, F.lit(None).cast("string"))


def label(template: Column, counters: list[Column]) -> Column:
    """A label template with ``%1`` to ``%9`` replaced by the counters given."""
    for i, c in enumerate(counters, 1):
        template = F.replace(template, F.lit(f"%{i}"), F.coalesce(c, F.lit("")))
    return template
