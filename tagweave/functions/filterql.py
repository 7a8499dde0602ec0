"""The include / exclude / AND filter language over tag texts, compiled to one predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.tags import _java_word, literals


@dataclass(frozen=True)
class Filter:
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    every: tuple[str, ...]


def parse_filter(query: str) -> Filter:
    """Parts between commas: with "!" exclude, else with "AND" (anywhere, capitals) an AND group, else include."""
    include, exclude, every = [], [], []
    for part in query.replace(", ", ",").split(","):
        if "!" in part:
            exclude.append(part.replace("!", ""))
        elif "AND" in part:
            every.append(part)
        else:
            include.append(part)
    return Filter(tuple(include), tuple(exclude), tuple(every))


def _split(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(", "), F.lit(",")), ",", -1)


def includes_word(text: Column, tags: tuple[str, ...]) -> Column:
    """Any tag stands in the text between word boundaries, in any case."""
    found = F.lit(False)
    for t in tags:
        found = found | F.rlike(text, F.lit(_java_word(t)))
    return F.coalesce(found, F.lit(False))


def includes_exact(text: Column, tags: tuple[str, ...]) -> Column:
    """Any tag equals a part of the text, in any case."""
    lowered = F.transform(_split(text), F.lower)
    return F.coalesce(F.arrays_overlap(lowered, literals([t.lower() for t in tags])), F.lit(False)) if tags else F.lit(False)


def meets_all(text: Column, groups: tuple[str, ...]) -> Column:
    """All members of any AND group are parts of the text, case-sensitive; a repeated member can never be met."""
    found = F.lit(False)
    for g in groups:
        members = g.replace(" AND ", "AND").split("AND")
        if len(set(members)) == len(members):
            found = found | (F.size(F.array_intersect(_split(text), literals(members))) == len(members))
    return F.coalesce(found, F.lit(False))


def selects(text: Column, query: str, exact: bool = False, extension: str = ".txt", compat: bool = True) -> Column:
    """((include, or all if there is none) or AND groups) and not exclude; a null text is a missing file.

    With ``compat`` a query of only AND groups selects everything, as no include means all; without it,
    only what the groups select.
    """
    if extension not in (".txt", ".caption"):
        raise ValueError("only .txt and .caption texts can be filtered")
    f = parse_filter(query)
    if f.include:
        found = includes_exact(text, f.include) if exact else includes_word(text, f.include)
    else:
        found = F.lit(compat or not f.every)
    return (found | meets_all(text, f.every)) & ~includes_exact(text, f.exclude)


def selects_simple(text: Column, query: str, extension: str = ".txt") -> Column:
    """Include only, between word boundaries, without operators."""
    if extension not in (".txt", ".caption"):
        raise ValueError("only .txt and .caption texts can be filtered")
    return includes_word(text, tuple(query.replace(", ", ",").split(",")))


def matches(text: Column, tags: tuple[str, ...]) -> Column:
    """All spans of the given tags in the text, for highlighting, tag by tag."""
    found = [F.regexp_extract_all(text, F.lit(r"(?iuU)(\b\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E\b)"), F.lit(1)) for t in tags if t]
    return F.concat(*found) if found else literals(())
