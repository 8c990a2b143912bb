"""Scalar functions on code text: call patterns, names, arguments, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_name(pattern: Column) -> Column:
    """The called name of a call pattern such as `os.system(` or `run(shell=True)`."""
    return F.regexp_extract(pattern, r"^\s*([\w.$]+)\s*\(?", 1)


def constraints(pattern: Column) -> Column:
    """The keyword constraints of a call pattern, blanks removed: ["shell=True"]."""
    inner = F.regexp_replace(F.regexp_extract(pattern, r"\((.*?)\)?\s*$", 1), " ", "")
    return F.filter(F.split(inner, ","), lambda x: x.contains("=") | x.startswith("**"))


def satisfies(arguments: Column, wanted: Column) -> Column:
    """Whether the arguments have every wanted constraint; `**` asks for any unpacked mapping."""
    have = F.transform(arguments, lambda a: F.regexp_replace(a, " ", ""))
    return F.forall(wanted, lambda w: F.when(w == "**", F.exists(have, lambda a: a.startswith("**"))).otherwise(F.array_contains(have, w)))


def leaf(callee: Column) -> Column:
    return F.element_at(F.split(callee, r"\."), -1)


def receiver(callee: Column) -> Column:
    """What stands before the last dot; null where there is none."""
    return F.nullif(F.regexp_extract(callee, r"^(.*)\.[^.]*$", 1), F.lit(""))


def keyword_of(argument: Column) -> Column:
    """The keyword of an argument `name=value`; null for a positional one and for comparisons."""
    return F.nullif(F.regexp_extract(argument, r"^\s*([A-Za-z_]\w*)\s*=(?!=)", 1), F.lit(""))


def words(text: Column) -> Column:
    """Word tokens; ASCII, so that every engine agrees."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1)


def mentions_any(text: Column, names: Column) -> Column:
    return F.arrays_overlap(words(text), names)


def posix(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(posix(path), "/"), -1), r"\.[^.]*$", "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b <= 0, 0.0).otherwise(a / b)


def expired(at: Column, now: Column, days: int) -> Column:
    return at < now - F.make_interval(days=F.lit(days))


def title(family: Column) -> Column:
    return F.initcap(F.replace(F.lower(family), F.lit("_"), F.lit(" ")))
