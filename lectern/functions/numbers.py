"""Reading time, progress and geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 155
RATES = (0.5, 0.65, 0.75, 0.85, 1.0, 1.25, 1.5, 2.0)


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves upwards, also below zero."""
    return F.floor(x + 0.5).cast("long")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def remaining_seconds(words: Column, current: Column, rate: Column | float = 1.0, duration: Column | None = None) -> Column:
    """By the words left at the reading rate, or in proportion to a known duration."""
    left = F.greatest(words - current, F.lit(0))
    pace = round_half_up(left / (F.lit(WORDS_PER_MINUTE) * (rate if isinstance(rate, Column) else F.lit(rate))) * 60)
    if duration is None:
        return pace
    known = (F.coalesce(duration, F.lit(0.0)) != 0) & (words > 0)
    return F.when(known, round_half_up(left * (duration / F.nullif(words, F.lit(0))))).otherwise(pace)


def percentage(words: Column, current: Column) -> Column:
    return F.when(words <= 0, F.lit(0)).otherwise(clamp(round_half_up(current / F.nullif(words, F.lit(0)) * 100), 0, 100)).cast("long")


def duration_text(seconds: Column) -> Column:
    """0 min, 5 s, 7 min, 2 h or 2 h 5 min."""
    minutes = F.floor(seconds / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    text = lambda x: x.cast("string")
    short = F.concat(text(F.greatest(F.lit(1), seconds % 60)), F.lit(" s"))
    long_ = F.concat(text(hours), F.lit(" h"), F.when(rest > 0, F.concat(F.lit(" "), text(rest), F.lit(" min"))).otherwise(""))
    return F.when(seconds.isNull() | (seconds <= 0), "0 min").when(minutes < 1, short).when(minutes < 60, F.concat(text(minutes), F.lit(" min"))).otherwise(long_)


def seek(current: Column, words: Column, seconds: Column, rate: Column) -> Column:
    """The word that so many seconds lead to."""
    return clamp(current + round_half_up(F.lit(WORDS_PER_MINUTE) * rate / 60 * seconds), 0, F.greatest(words - 1, F.lit(0)))


def step(current: Column, words: Column, by: Column | int) -> Column:
    return clamp(current + by, 0, F.greatest(words - 1, F.lit(0)))


def tick_millis(rate: Column) -> Column:
    """Interval of the timer that stands in for missing word events."""
    return F.greatest(F.lit(650), round_half_up(1000 / (F.lit(WORDS_PER_MINUTE) * rate / 60)))


def word_weight(word: Column) -> Column:
    """How long a word is spoken, relative to others, in hundredths: groups of vowels and a little for each letter."""
    vowels = F.size(F.regexp_extract_all(word, F.lit("(?iu)([aeiouáéíóúü]+)"), F.lit(1)))
    return (F.greatest(F.lit(1), vowels) * 100 + F.least(F.length(word), F.lit(20)) * 8).cast("long")


def ocr_scale(width: Column, height: Column) -> Column:
    return F.least(F.lit(2.5), F.lit(4096) / F.greatest(width, height), F.sqrt(F.lit(8e6) / (width * height)))


def box_transform(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An image box (y downwards) as a transform of page space (y upwards)."""
    h = (y1 - y0).cast("double")
    zero = F.lit(0.0)
    return F.array(h, zero, zero, h, x0.cast("double"), (-y1).cast("double"))


def is_turned(transform: Column) -> Column:
    a, b, c, d = (transform[i] for i in range(4))
    return (F.abs(b) > F.abs(a) * 0.1) | (F.abs(c) > F.abs(d) * 0.1)


def font_height(height: Column, transform: Column) -> Column:
    return F.greatest(F.abs(F.coalesce(height, F.lit(0.0))), F.hypot(transform[2], transform[3]), F.lit(1.0))


def font_bucket(height: Column) -> Column:
    return round_half_up(F.log(height) / math.log(1.15))
