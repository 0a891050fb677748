"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by rank 0..4.
SEVERITIES = ["INFORMATIVE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def half_up(x: Column, places: int) -> Column:
    """Rounds halves up, as floor does, negatives too."""
    f = float(10**places)
    return F.floor((x + F.lit(2.220446049250313e-16)) * f + 0.5) / f


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x, F.lit(low))))


def yes(x: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(x, F.lit(False))


def days(older: Column, newer: Column) -> Column:
    """Days between, 0 at least; null if one is missing."""
    gap = (F.unix_millis(newer.cast("timestamp")) - F.unix_millis(older.cast("timestamp"))) / F.lit(86400000.0)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def severity_rank(x: Column) -> Column:
    """0..4; none counts as informative, what is unknown as medium. Its place in the list is looked up once."""
    at = F.array_position(F.lit([*SEVERITIES, "NONE"]), F.upper(F.trim(x)))
    return F.coalesce(F.get(F.lit([2, 0, 1, 2, 3, 4, 0]), at.cast("int")), F.lit(2))


def texts(*pairs: tuple[Column, Column]) -> Column:
    """Texts whose condition holds, in order."""
    return F.filter(F.array(*(F.when(yes(c), t) for c, t in pairs)), lambda x: x.isNotNull())


def _accents() -> tuple[str, str]:
    """Letters with accents (Latin, up to U+024F) and what they are without."""
    import unicodedata

    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b != a and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _one_letter(x: str) -> bool:
    import unicodedata

    return len([c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)]) == 1


#: Names whose characters ``fold`` folds as a full decomposition would: ASCII, and accented letters that become one ASCII letter.
FOLDED = "^[\\x00-\\x7f" + "".join(a for a in _accents()[0] if _one_letter(a)) + "]*$"


def fold(x: Column) -> Column:
    """Lower case without accents: Latin letters up to U+024F and combining marks."""
    return F.lower(F.regexp_replace(F.translate(x, *_accents()), "[\u0300-\u036f]", ""))


def fold_words(x: Column) -> Column:
    """Folded letters and digits, all else one space."""
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " "))
