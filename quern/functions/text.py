"""Tokens, numbers as text and text as numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def tokens(line: Column, longest: int = 1024) -> Column:
    """An array of what lies between runs of spaces (tabs stay), without tokens of `longest` bytes or more."""
    return F.filter(F.split(line, " "), lambda w: (w != "") & (F.octet_length(w) < longest))


def lines(text: Column) -> Column:
    r"""An array of the records of a text: ended by \n alone; blank ones count, and the last needs no end."""
    found = F.split(text, "\n")
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def parse_integer(text: Column) -> Column:
    """A non-negative integer by C's base rule: 0x is hexadecimal, a leading 0 octal; stops at the first other sign.

    Text without a digit gives 0, null gives null, and more than a long holds gives null.
    """
    t = F.ltrim(text)
    hexa = F.regexp_extract(t, r"^\+?0[xX]([0-9a-fA-F]+)", 1)
    octal = F.regexp_extract(t, r"^\+?0([0-7]*)", 1)
    decimal = F.regexp_extract(t, r"^\+?([1-9][0-9]*)", 1)
    plain = F.when(F.substring(text, 1, 1).between("1", "9"), text.try_cast("long"))  # most texts, without an expression
    return F.coalesce(plain, (
        F.when(text.isNull(), F.lit(None))
        .when(hexa != "", F.conv(hexa, 16, 10)).when(decimal != "", decimal).when(octal != "", F.conv(octal, 8, 10)).otherwise("0")
    ).try_cast("long"))


@F.pandas_udf(T.StringType())
def general(x: pd.Series) -> pd.Series:
    """A double in six significant digits, as %g has it; the text sink's form of floating point."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:g}")


def index_word(index: Column, length: int) -> Column:
    """The base-62 digits of a non-negative index, least significant first, always `length` of them."""
    digit = lambda k: F.substring(F.lit(ALPHABET), (F.floor(index / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in range(length)])
