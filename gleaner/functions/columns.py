"""Scalar columns: text, time, JSON values, status and presentation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from gleaner.schemas import DONE, FETCH_FAILED, PARSE_FAILED

# Characters up to the space are trimmed everywhere.
BLANKS = "".join(map(chr, range(33)))


def strip(text: Column) -> Column:
    """Text without leading and trailing control characters and spaces."""
    return F.btrim(text, F.lit(BLANKS))


def parse_pattern(pattern: str) -> str:
    """A reading pattern that takes numbers with or without leading zeros.

    A numeric run such as ``MM`` is shortened unless digits of another field
    touch it or it names a month in letters.
    """
    return re.sub(
        r"(?<![A-Za-z])([yMdHhms])\1*(?![A-Za-z])",
        lambda run: run.group(0) if run.group(1) == "M" and len(run.group(0)) > 2 else run.group(1),
        pattern,
    )


def to_epoch(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Epoch seconds of a date text read by a pattern, 0 when it does not fit.

    The state tables hold 32 bits; a moment beyond them wraps around.
    """
    moment = F.try_to_timestamp(text, F.lit(parse_pattern(pattern)))
    seconds = F.coalesce(F.unix_seconds(moment), F.lit(0))
    return (F.pmod(seconds + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def from_epoch(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Date text of epoch seconds, empty when there are none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), pattern), F.lit(""))


def md5_hex(text: Column) -> Column:
    """Upper-case hexadecimal MD5."""
    return F.upper(F.md5(text))


def json_text(document: Column, key: str) -> Column:
    """A JSON member as trimmed text: strings unquoted, the rest (null too) as JSON text, missing empty."""
    # get_json_object gives NULL for a null member as for a missing one.
    member = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    null = F.when(F.schema_of_variant(member) == "VOID", F.lit("null"))
    return strip(F.coalesce(F.get_json_object(document, f"$.{key}"), null, F.lit("")))


def to_int(text: Column, default: int) -> Column:
    """An int from text, or the default."""
    # A sign and digits only; the cast alone would also take spaces and fractions.
    plain = F.when(text.rlike(r"^[+-]?[0-9]+$"), text)
    return F.coalesce(plain.try_cast("int"), F.lit(default))


def result_status(job_error: Column, connect_error: Column, parse_error: Column) -> Column:
    """Status of a finished attempt from its three error texts."""
    return (
        F.when(job_error != "", PARSE_FAILED)
        .when(connect_error != "", FETCH_FAILED)
        .when(parse_error != "", PARSE_FAILED)
        .otherwise(DONE)
    )


def excerpt(text: Column, length: int = 200) -> Column:
    """The first characters of a body text, for a listing."""
    return F.substring(text, 1, length)


def title_image(islocal: Column, urlabs: Column, path: Column, filename: Column) -> Column:
    """Where a reader finds the title image; empty when there is none."""
    stored = F.concat(F.coalesce(path, F.lit("")), F.coalesce(filename, F.lit("")))
    return F.when(islocal == 0, F.coalesce(urlabs, F.lit(""))).otherwise(stored)


# Fixed value: the caption of an account article's counts.
COUNTS_CAPTION = "阅读: %s, 点赞: %s"


def counts_caption(read_count: Column, like_count: Column) -> Column:
    """Caption with the read and like counts."""
    return F.format_string(COUNTS_CAPTION, read_count, like_count)


def page_arguments(page: int, count: int) -> tuple[int, int]:
    """Page number and page size with their defaults for values below 1."""
    return (page if page >= 1 else 1), (count if count >= 1 else 10)


def upload_path(sid: Column, now: int) -> Column:
    """Folder of a site's images for the day of ``now``."""
    day = F.date_format(F.timestamp_seconds(F.lit(now)), "yyyyMM/dd")
    return F.concat(F.lit("upload/"), sid.cast("string"), F.lit("/"), day, F.lit("/"))
