"""Strings, paths and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for a paper without any text.
NO_TEXT = "Brak dostępnego źródła tekstowego."


def last_segment(url: Column) -> Column:
    """What follows the last slash; the whole string without one."""
    return F.substring_index(url, "/", -1)


def one_line(title: Column) -> Column:
    """Line feeds become spaces; runs of spaces stay."""
    return F.replace(title, F.lit("\n"), F.lit(" "))


def source_url(link: Column) -> Column:
    return F.replace(link, F.lit("/abs/"), F.lit("/e-print/"))


def legacy_pdf_url(link: Column) -> Column:
    """Every ``abs`` is replaced, not only the path's."""
    return F.concat(F.replace(link, F.lit("abs"), F.lit("pdf")), F.lit(".pdf"))


def query_plus(query: Column) -> Column:
    """Spaces as plus signs; nothing else is escaped."""
    return F.replace(query, F.lit(" "), F.lit("+"))


def prefix(text: Column, chars: int) -> Column:
    """The first code points."""
    return F.substring(text, 1, chars)


def object_key(paper_id: Column) -> Column:
    """20YY/MM/id.txt from the first four characters of an id."""
    return F.concat(F.lit("20"), F.substring(paper_id, 1, 2), F.lit("/"), F.substring(paper_id, 3, 2), F.lit("/"), paper_id, F.lit(".txt"))


def object_url(endpoint: str, bucket: str, key: Column) -> Column:
    """``endpoint``: an address, or a URL that names its scheme."""
    return F.concat(F.lit(f"{endpoint if '://' in endpoint else f'http://{endpoint}'}/{bucket}/"), key)


def without_comments(tex: Column) -> Column:
    """Lines that begin with % are emptied; only a line feed ends a line."""
    return F.regexp_replace(tex, r"(?md)^%.*$", "")


def is_blank(text: Column) -> Column:
    """White space alone, of Unicode and of the separators U+001C to U+001F; null is not blank but null."""
    return ~F.regexp_replace(text, "[\u001c-\u001f]", "").rlike(r"(?U)\S")


def has_suffix(name: Column, suffix: str) -> Column:
    """Whether a name ends so; upper and lower case differ."""
    return F.endswith(name, F.lit(suffix))


def or_no_text(text: Column) -> Column:
    return F.when(is_blank(text), F.lit(NO_TEXT)).otherwise(text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def wall_time(iso: Column) -> Column:
    """An ISO text's time of day and date, its zone dropped; null if it is no time."""
    return iso.try_cast("timestamp_ntz")


def backoff_seconds(attempt: Column) -> Column:
    return (F.lit(5) * F.pow(F.lit(2), attempt)).cast("long")


def first_label(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit("Node"))
