"""Identity functions: deterministic keys made from a row's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space for URLs of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def section_id(doc: Column, chapter: Column, number: Column, start: Column, end: Column) -> Column:
    return uuid5(F.concat_ws(":", doc, chapter, F.when(number == "", "NA").otherwise(F.coalesce(number, F.lit("NA"))), F.concat_ws("-", start, end)))


def chapter_id(doc: Column, title: Column) -> Column:
    """By title alone, so that sightings on several pages are one chapter."""
    return uuid5(F.concat_ws(":", doc, F.regexp_replace(F.upper(F.trim(title)), r"\s+", " ")))


def digest_id(*parts: Column) -> Column:
    """The first 24 hex digits of SHA-256 over the parts with colons between."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24)
