"""Filter building blocks: optional filters, contains, fallbacks, keyword matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter values that mean "no filter".
ANY = (None, "", "All")


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality for each column whose wanted value is not one of ANY; the others add nothing to the plan."""
    for name, value in wanted.items():
        if value not in ANY:
            df = df.where(F.col(name) == F.lit(value))
    return df


def allowed(column: str, values: list) -> Column:
    """``column IN values``, where an empty list allows nothing."""
    return F.col(column).isin(values) if values else F.lit(False)


def icontains(column: Column, part: str) -> Column:
    return F.contains(F.lower(column), F.lit(part.lower()))


def any_contains(column: Column, parts: list[str]) -> Column:
    """True if the lower-case text has one of the lower-case parts."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(column, F.lit(part))
    return found


def first_long(*columns: Column, longer_than: int = 5) -> Column:
    """The first value whose trimmed text has more than ``longer_than`` characters."""
    return F.coalesce(*[F.when(F.char_length(F.trim(c)) > longer_than, c) for c in columns])


def has_word(column: Column, word: str) -> Column:
    """Whole-word match in lower-case text; a colon at the word's end is left out."""
    return column.rlike(rf"\b{re.escape(word.rstrip(':'))}\b")


def keyword_hit(text: Column, keyword: Column, short: int = 4) -> Column:
    """Short keywords match whole words, longer ones match anywhere; both sides in lower case."""
    word = F.concat(F.lit(r"\b\Q"), keyword, F.lit(r"\E\b"))
    return F.when(F.char_length(keyword) <= short, F.regexp_like(text, word)).otherwise(F.contains(text, keyword))


def list_without(column: Column, item: str) -> Column:
    """A ", "-separated list without ``item``."""
    return F.array_join(F.array_remove(F.split(column, r",\s*"), F.lit(item)), ", ")


def list_with(column: Column, item: str) -> Column:
    """A ", "-separated list with ``item`` at the end if it isn't there."""
    return F.array_join(F.array_union(F.filter(F.split(column, r",\s*"), lambda x: x != ""), F.array(F.lit(item))), ", ")
