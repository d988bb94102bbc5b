"""Text expressions: tags, paths, dates and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOSSLESS = ("flac", "wav", "aiff", "aif")


def clean_tags(tags: Column) -> Column:
    """Tags without blanks around them, nulls and empty ones; repetitions and order stay. Null becomes empty."""
    trimmed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t))
    return F.filter(trimmed, lambda t: t.isNotNull() & (t != ""))


def split_tags(text: Column) -> Column:
    """Tags of one delimited field (";" or ","), trimmed, without empty ones. Null stays null."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda t: F.trim(t)), lambda t: t != "")


def basename(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def stem(path: Column) -> Column:
    """File name without its suffix."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def is_lossless(path: Column) -> Column:
    """1 for suffixes of lossless audio, else 0."""
    return suffix(path).isin(*LOSSLESS).cast("int")


def added_date(added: Column) -> Column:
    """The date in the first ten characters, null if they hold none."""
    return F.to_date(F.when(F.substring(added, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.substring(added, 1, 10), "yyyy-MM-dd")))


def within_dates(added: Column, since: str | None, until: str | None) -> Column:
    """Permissive date range: true where no date can be read; bounds are inclusive."""
    d = added_date(added)
    ok = F.lit(True)
    if since:
        ok = ok & F.coalesce(d >= F.to_date(F.lit(since)), F.lit(True))
    if until:
        ok = ok & F.coalesce(d <= F.to_date(F.lit(until)), F.lit(True))
    return ok


def label(artist: Column, title: Column) -> Column:
    """"artist - title"; missing parts are empty."""
    return F.concat(F.coalesce(artist, F.lit("")), F.lit(" - "), F.coalesce(title, F.lit("")))


def location_uri(path: Column) -> Column:
    """An absolute path as a location with percent-encoding; letters, digits, "/", "_", ".", "-" and "~" stay."""
    coded = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit("file://localhost"), F.when(F.startswith(coded, F.lit("/")), F.lit("")).otherwise(F.lit("/")), coded)


def location_path(location: Column) -> Column:
    """The path of a location; "+" stays a plus sign. Text that is no location, and null, come back as they are."""
    bare = F.regexp_replace(location, r"^file://localhost", "")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
