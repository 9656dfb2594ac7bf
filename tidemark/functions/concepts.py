"""Concept ids, skills and grades as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKILLS = ("word", "reading", "change", "particle", "pattern", "quantity")
#: Endings are tested before beginnings.
ENDINGS = ((":reading", "reading"), (":group", "change"))
BEGINNINGS = (("r:", "change"), ("w:", "word"), ("p:", "particle"), ("g:", "pattern"), ("c:", "quantity"), ("n:", "quantity"))


def skill_of(concept: Column) -> Column:
    out = F
    for end, skill in ENDINGS:
        out = out.when(concept.endswith(end), skill)
    for start, skill in BEGINNINGS:
        out = out.when(concept.startswith(start), skill)
    return out


def grade(correct: Column, hinted: Column, r: Column, median: Column) -> Column:
    """1 wrong, 2 hinted or slow, 3 as usual, 4 fast; a median of 0 is none."""
    return F.when(~correct, 1).when(hinted, 2).when(median == 0, 3).when(r < 0.6 * median, 4).when(r > 2 * median, 2).otherwise(3)


def word_concepts(kana: Column, kanji: Column) -> Column:
    cite = F.coalesce(F.nullif(kanji, F.lit("")), kana)
    own = F.array(F.concat(F.lit("w:"), cite))
    return F.when(F.coalesce(kanji, F.lit("")) != "", F.array_append(own, F.concat(F.lit("w:"), cite, F.lit(":reading")))).otherwise(own)


def change_concepts(cite: Column, form: Column, kind: Column) -> Column:
    """kind: groupI, groupII, groupIII, iadj or naadj."""
    return F.array(F.concat(F.lit("r:"), form, F.lit(":"), kind), F.concat(F.lit("w:"), cite, F.lit(":group")))


def skills_of(covers: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(covers, skill_of), lambda s: s.isNotNull()))


def union_enabled(made: dict[str, Callable[[], DataFrame]], enabled: list[str]) -> DataFrame:
    """Union of the enabled generators' rows; one that is off is not planned."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f() for name, f in made.items() if name in enabled])
