"""What a person is asked to fill in: flags of a row by where its time and place come from, and the filters made of them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# How sources are named.
NONE = "none"
FILE_TIME = "mtime"
DATE_ONLY = "date only"
WORKED_OUT = ("same day", "nearest fix", "same folder")
ENTERED_TIME = "you entered"
ENTERED_PLACE = ("you entered it", "you confirmed it")
PERSONAL_ZONE = "you "


def flags(time_source: Column, place_source: Column, zone_source: Column) -> dict[str, Column]:
    """needs_date, needs_place, worked_out, entered and audited. A null source counts as none."""
    t, p, z = (F.coalesce(c, F.lit(NONE)) for c in (time_source, place_source, zone_source))
    return {
        "needs_date": (t == NONE) | F.startswith(t, F.lit(FILE_TIME)) | F.contains(t, F.lit(DATE_ONLY)),
        "needs_place": p == NONE,
        "worked_out": reduce(or_, [F.startswith(p, F.lit(x)) for x in WORKED_OUT]),
        "entered": F.startswith(t, F.lit(ENTERED_TIME)) | p.isin(*ENTERED_PLACE),
        "audited": ~F.startswith(z, F.lit(PERSONAL_ZONE)),
    }


def filters(flag: dict[str, Column]) -> dict[str, Column]:
    """The six filters by name."""
    either = flag["needs_date"] | flag["needs_place"]
    return {"attention": either | flag["worked_out"], "either": either, "date": flag["needs_date"], "place": flag["needs_place"], "worked_out": flag["worked_out"], "entered": flag["entered"]}
