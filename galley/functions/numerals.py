"""Roman and Arabic numerals of captions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman symbols, largest first, with the pairs that subtract.
SYMBOLS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
_SINGLE = {s: n for n, s in SYMBOLS if len(s) == 1}


def numbering_style(token: Column) -> Column:
    """roman, arabic or other."""
    return F.when(F.rlike(token, F.lit(r"^\p{Nd}+\z")), "arabic").when(F.rlike(token, F.lit(r"^[IVXLCDMivxlcdm]+\z")), "roman").when(token.isNotNull(), "other")


def roman_to_int(token: Column) -> Column:
    """Symbols from the right: those under the largest so far subtract. Null for other letters or nothing."""
    values = F.create_map(*[F.lit(x) for pair in _SINGLE.items() for x in pair])
    letters = F.reverse(F.filter(F.split(F.upper(token), ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    fold = F.aggregate(
        letters,
        start,
        lambda a, c: F.struct(
            (a["total"] + F.when(values[c] < a["most"], -values[c]).otherwise(values[c])).alias("total"),
            F.greatest(a["most"], values[c]).alias("most"),
        ),
    )["total"]
    return F.when(F.rlike(token, F.lit("^[IVXLCDMivxlcdm]+\\z")) & (fold > 0), fold)


def int_to_roman(number: Column) -> Column:
    """The greedy spelling of a number from 1 on."""
    parts, rest = [], number
    for n, s in SYMBOLS:
        parts.append(F.repeat(F.lit(s), F.floor(rest / n).cast("int")))
        rest = rest % n
    return F.when(number > 0, F.concat(*parts))


def numeral_value(token: Column, style: Column) -> Column:
    """What a token stands for in the style that it is said to have."""
    return F.when(style == "arabic", F.when(F.rlike(token, F.lit(r"^[0-9]+\z")), token.cast("int"))).when(style == "roman", roman_to_int(token))
