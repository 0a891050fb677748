"""Pattern flags of texts, computed once for each record and joined as bits.

The searched text of a row is made of parts of several records, joined by a
space. A pattern fits the whole where it fits a part, or a phrase of two words
whose first ends one part and whose second begins the next. So each record
keeps a bit for each pattern and its text's ends, and a row only combines bits
and looks for the phrases at the seams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More characters than a word of a phrase has.
REACH = 12

#: A pattern over lower-case text, and texts of which every match holds one.
Pattern = tuple[str, list[str]]


def lowered(x: Column) -> Column:
    """ASCII letters in lower case: case-blind patterns of ASCII letters fit nothing else."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain(x: Column) -> Column:
    """Lower case, and one character for each that is not ASCII: the borders of words are then those between ASCII letters, digits or underscores and all else."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.regexp_replace(lowered(x), r"[^\x00-\x7f]", "\u0000"))


def fits(text: Column, pattern: Pattern) -> Column:
    """The pattern is tried only where one of its texts stands: to look for these is cheap."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in pattern[1])) & text.rlike(pattern[0])


def bits(text: Column, patterns: list[Pattern]) -> Column:
    """text: of plain(). Bit i: the i-th pattern fits. Null has none."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(fits(text, p), 1 << i).otherwise(0) for i, p in enumerate(patterns)))


def ends(text: Column) -> Column:
    """The text without what lies further than REACH from both its ends; empty ones are null, as they leave no seam."""
    short = F.when(F.length(text) <= 2 * REACH, text).otherwise(F.concat(F.left(text, F.lit(REACH)), F.lit("\u0000"), F.right(text, F.lit(REACH))))
    return F.when(text != "", short)


def told(text: Column, patterns: list[Pattern]) -> Column:
    """What a record keeps of its text: struct of bits and ends."""
    return _kept(plain(text), patterns)


def _kept(low: Column, patterns: list[Pattern]) -> Column:
    return F.struct(bits(low, patterns).alias("bits"), ends(low).alias("ends"))


def add_told(df: DataFrame, name: str, text: Column, patterns: list[Pattern]) -> DataFrame:
    """Adds ``told`` of a text as a column. The lowered text is a column of its own first, so that the plan names it once and not once a pattern."""
    return df.withColumn(f"__{name}", plain(text)).withColumn(name, _kept(F.col(f"__{name}"), patterns)).drop(f"__{name}")


def sides(told: Column, phrases: list[tuple[str, str]]) -> Column:
    """What ``joint`` reads of a part (struct of ``told``): bits, head and tail. Bit j of head: its text begins with the second word of phrase j; of tail: it ends with the first one.
    Both are null for an empty text, which leaves no seam."""
    e = told["ends"]
    some = lambda fits: reduce(lambda a, b: a.bitwiseOR(b), (F.when(fits(p), 1 << j).otherwise(0) for j, p in enumerate(phrases)))
    return F.struct(told["bits"].alias("bits"), F.when(e.isNotNull(), some(lambda p: F.startswith(e, F.lit(p[1])))).alias("head"), F.when(e.isNotNull(), some(lambda p: F.endswith(e, F.lit(p[0])))).alias("tail"))


def joint(parts: list[Column], phrases: list[int]) -> Column:
    """Bits of the parts (structs of ``sides``, null: none) as one text. phrases: of each phrase, the bits of the patterns that it makes fit.

    Only numbers are combined: a phrase that no part holds alone stands where one part's tail meets the head of the next that is not empty."""
    zero = F.lit(0)
    own = reduce(lambda a, b: a.bitwiseOR(b), (F.coalesce(p["bits"], zero) for p in parts))
    seams = [F.coalesce(p["head"], zero).bitwiseAND(F.coalesce(*(q["tail"] for q in parts[i::-1]), zero)) for i, p in enumerate(parts[1:])]
    met = reduce(lambda a, b: a.bitwiseOR(b), seams)
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(met.bitwiseAND(1 << j) != 0, m).otherwise(0) for j, m in enumerate(phrases)), own)


def has(flags: Column, i: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(1 << i) != 0
