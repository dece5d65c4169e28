"""Codes and their labels: listing types, fellowships, feed formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekgrid.functions.base import lookup
from weekgrid.schemas import FEED_FORMATS, FELLOWSHIPS

# Fellowship names.
FELLOWSHIP_LABELS = {"aa": "AA", "na": "NA", "ca": "CA"}
FELLOWSHIP_NAMES = {
    "aa": "Alcoholics Anonymous",
    "na": "Narcotics Anonymous",
    "ca": "Cocaine Anonymous",
}
# Type codes offered as filters.
FILTER_TYPES = ("ONL", "B", "SP", "D", "BE", "LGBTQ", "W", "M", "X", "XB", "S", "ASL")
# English labels of the public type codes used here; others show their code.
TYPE_LABELS = {
    "ONL": "Online Meeting",
    "B": "Big Book",
    "SP": "Speaker",
    "D": "Discussion",
    "BE": "Newcomer",
    "LGBTQ": "LGBTQ",
    "W": "Women",
    "M": "Men",
    "X": "Wheelchair Access",
    "XB": "Wheelchair-Accessible Bathroom",
    "S": "Spanish",
    "ASL": "American Sign Language",
    "O": "Open",
    "C": "Closed",
    "ST": "Step Study",
    "YP": "Young People",
}


def type_label(code: Column, labels: Mapping[str, str] = TYPE_LABELS) -> Column:
    return F.coalesce(lookup(labels, code), code)


def as_fellowship(value: Column) -> Column:
    return F.when(value.isin(*FELLOWSHIPS), value).otherwise("aa")


def as_feed_format(value: Column) -> Column:
    return F.when(value.isin(*FEED_FORMATS), value).otherwise("tsml")
