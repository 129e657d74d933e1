"""Dates written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.fixed import ZONES
from caseloom.operators.scoring import literal_map

# shape of the text -> date format; a shape is tested before anything is parsed
SHAPES = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2}$", "d MMM yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
]


def parse_date(c: Column) -> Column:
    """UTC time of a date text, null where no known form fits."""
    text = F.regexp_replace(F.trim(c), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    abbreviation = F.regexp_extract(text, r"\s+\(?([A-Z]{2,5})\)?\s*$", 1)
    named = (abbreviation != "") & ~abbreviation.isin("AM", "PM")
    numeric = F.regexp_extract(text, r"\s([+-]\d{4})$", 1)
    offset = F.when(named, literal_map(ZONES, "+0000")(abbreviation)).when(numeric != "", numeric).otherwise("+0000")
    bare = F.regexp_replace(text, r"\s+[+-]\d{4}$", "")
    bare = F.when(named, F.regexp_replace(text, r"\s+\(?[A-Z]{2,5}\)?\s*$", "")).otherwise(bare)
    minutes = (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int"))
    minutes = F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes)
    local = F.coalesce(*[F.when(bare.rlike(shape), F.try_to_timestamp(bare, F.lit(form))) for shape, form in SHAPES])
    # two-digit years from 69 on belong to the last century
    short = bare.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$") & (F.year(local) >= 2069)
    local = F.when(short, local - F.make_ym_interval(F.lit(100))).otherwise(local)
    return local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def month_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")
