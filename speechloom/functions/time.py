"""Time arithmetic. Times are integer milliseconds inside the library; seconds appear at the edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SAMPLE_RATE = 16_000


def seconds_to_ms(seconds: Column) -> Column:
    """Half-even rounding to whole milliseconds."""
    return F.rint(seconds * 1000.0).cast("bigint")


def round3(x: Column) -> Column:
    """Half-even rounding to three decimals (Spark's own ``round`` is half-up)."""
    return F.rint(x * 1000.0) / 1000.0


def seconds_to_sample(seconds: Column, rate: int = SAMPLE_RATE) -> Column:
    """Truncating conversion of a time to a sample index."""
    return (seconds * float(rate)).cast("bigint")


def samples_to_seconds(samples: Column, rate: Column) -> Column:
    """``samples / rate``; any rate other than 16 kHz is an error, as region detectors accept no other."""
    ok = F.when(rate == SAMPLE_RATE, samples / F.lit(float(SAMPLE_RATE)))
    return ok.otherwise(F.raise_error(F.lit("only a 16000 Hz sample rate is allowed")).cast("double"))


def _two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text)


def format_ms(ms: Column, always_hours: bool = False, marker: str = ".") -> Column:
    """``[HH:]MM:SS<marker>mmm``; a negative time is an error."""
    hours = F.floor(ms / 3_600_000)
    minutes = F.floor(ms / 60_000) % 60
    seconds = F.floor(ms / 1000) % 60
    tail = F.concat(
        _two_digits(minutes), F.lit(":"), _two_digits(seconds), F.lit(marker),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )
    with_hours = F.concat(_two_digits(hours), F.lit(":"), tail)
    text = with_hours if always_hours else F.when(hours > 0, with_hours).otherwise(tail)
    return F.when(ms < 0, F.raise_error(F.lit("non-negative timestamp expected")).cast("string")).otherwise(text)


def format_seconds(seconds: Column, always_hours: bool = False, marker: str = ".") -> Column:
    return format_ms(seconds_to_ms(seconds), always_hours, marker)


def seconds_text(ms: Column) -> Column:
    """Plain decimal text of ``ms / 1000`` with at least one fraction digit, never in exponent form."""
    fraction = F.rtrim(F.lpad((F.abs(ms) % 1000).cast("string"), 3, "0"), F.lit("0"))
    return F.concat(
        F.when(ms < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(F.abs(ms) / 1000).cast("string"), F.lit("."),
        F.when(fraction == "", F.lit("0")).otherwise(fraction),
    )
