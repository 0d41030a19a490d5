"""Text building blocks shared by staging, maps and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    return blank_to_null(F.concat_ws(" ", first, last))


def compose_address(line1: Column, line2: Column, postal: Column, city: Column, country: Column) -> Column:
    """One address line. A missing postal code and city still leave their separator behind."""
    locality = F.concat_ws(" ", postal, city)
    return blank_to_null(F.concat_ws(", ", line1, line2, locality, country))


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def version_text(service_id: Column, valid_from: Column) -> Column:
    return F.concat_ws("|", service_id, iso_date(valid_from))


def date_key(value: Column) -> Column:
    """Calendar key yyyyMMdd as int; a null date gives a null key."""
    return F.date_format(value.cast("date"), "yyyyMMdd").cast("int")
