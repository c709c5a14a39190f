"""Date formats read from the data: each cell has a shape, each shape one format.

A shape is a cell with its digits and month names replaced (``9`` for one or two digits, ``Y`` for
four, ``L`` and ``S`` for a long and a short month name, ``p`` for am or pm). Only shapes of dates
count, so their number is bounded whatever the column holds, and one aggregate finds them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import check_columns, col

# English month names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December")

_DATE = (r"9/9/Y|9\.9\.Y|9-9-Y|9 9 Y"          # day and month, in either order
         r"|Y/9/9|Y\.9\.9|[LS] 9,? Y|9 [LS],? Y|9-[LS]-Y")
_SHAPE = rf"^({_DATE})(,? 9:9(?::9)?(?: ?p)?)?$"


def tidy(c: Column) -> Column:
    """Cell without outer spaces, inner runs of white space as one space."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))


def shape(c: Column) -> Column:
    """Shape of a cell that looks like a date, else NULL."""
    s = tidy(c)
    for names, mark in ((MONTHS, "L"), ([m[:3] for m in MONTHS], "S")):
        s = F.regexp_replace(s, rf"(?i)\b({'|'.join(m for m in names if mark == 'S' or len(m) > 3)})\b", mark)
    s = F.regexp_replace(F.regexp_replace(s, r"\b\d{4}\b", "Y"), r"\b\d{1,2}(?!\d)", "9")
    s = F.regexp_replace(s, r"(?i)(?<=9 ?)[ap]m$", "p")
    return F.when(s.rlike(_SHAPE), s)


def date_shapes(df: DataFrame, c: str) -> DataFrame:
    """``shape, cells, first_over, second_over``: cells of each shape, and those whose first or
    second number is above 12. One aggregate with a map-side combine."""
    check_columns(df, [c])
    number = lambda i: F.regexp_extract(tidy(col(c)), r"^(\d+)\D+(\d+)", i).try_cast("int")
    return (df.select(shape(col(c)).alias("shape"), number(1).alias("a"), number(2).alias("b"))
            .where(F.col("shape").isNotNull()).groupBy("shape")
            .agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("a") > 12).alias("first_over"),
                 F.count_if(F.col("b") > 12).alias("second_over")))


def date_formats(df: DataFrame, c: str, day_first: bool | None = None) -> dict[str, str]:
    """Format of each shape of the column.

    Whether day or month comes first in ``9/9/Y`` and its like is told by numbers above 12, over all
    cells with that separator. Where none is, or both places have them, ValueError asks for
    ``day_first``, which then holds for all."""
    found = date_shapes(df, c).collect()            # bounded: the shapes of _SHAPE
    over: dict[str, list[int]] = {}
    for r in found:
        date = re.match(_SHAPE, r["shape"])[1]
        if re.fullmatch(r"9.9.Y", date):
            seen = over.setdefault(date, [0, 0])
            seen[0] += r["first_over"]
            seen[1] += r["second_over"]
    out = {}
    for r in found:
        date, time = re.match(_SHAPE, r["shape"]).groups(default="")
        if date in over:
            first, second = over[date]
            if day_first is None and bool(first) == bool(second):
                what = "mixes both orders" if first else "has no number above 12"
                raise ValueError(f"day and month of {c} cannot be told apart ({date} {what}): give day_first")
            day = day_first if day_first is not None else bool(first)
            fmt = date.replace("9", "d" if day else "M", 1).replace("9", "M" if day else "d", 1)
        elif date.startswith("Y"):
            fmt = date.replace("9", "M", 1).replace("9", "d", 1)
        else:
            fmt = date.replace("9", "d").replace("L", "MMMM").replace("S", "MMM")
        time = time.replace("9", "h" if time.endswith("p") else "H", 1).replace("9", "mm", 1).replace("9", "ss", 1)
        out[r["shape"]] = fmt.replace("Y", "yyyy") + time.replace("p", "a")
    return out


def parse_dates(c: Column, formats: dict[str, str]) -> Column:
    """Timestamp of a cell by the format of its shape; NULL for other shapes and days that do not exist."""
    s, t = shape(c), tidy(c)
    parsed = [F.when(s == F.lit(k), F.try_to_timestamp(t, F.lit(f))) for k, f in sorted(formats.items())]
    return F.coalesce(*parsed) if parsed else F.lit(None).cast("timestamp")
