"""Text helpers whose notion of blank is any Unicode white space, not just the space character."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points treated as white space.
WHITE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def filled(text: Column) -> Column:
    """The text, or null when it is the empty string."""
    return F.nullif(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def find(text: Column, pattern: str, group: int = 1, flags: str = "U") -> Column:
    """First match of a pattern, stripped; null when there is none."""
    return strip(filled(F.regexp_extract(text, f"(?{flags}){pattern}", group)))


def money_text(amount: Column) -> Column:
    """A two-decimal amount as shortest text with at least one decimal: 300.00 -> 300.0, 300.25 -> 300.25."""
    return F.regexp_replace(amount.try_cast("decimal(18,2)").cast("string"), "0$", "")


def utc_text(stamp: Column) -> Column:
    """An instant as ISO text in UTC, whatever the time zone of the session."""
    shifted = F.to_utc_timestamp(stamp, F.current_timezone())
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
