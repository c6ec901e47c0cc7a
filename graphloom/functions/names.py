"""Column functions for names, paths and XPath text of data models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Module prefixes that paths drop, and modules whose paths are already anchored.
SHORT_PREFIXES = ("nw:", "nt:", "st:")
ANCHORED_MODULES = ("ietf-network", "ietf-network-topology", "ietf-simap-topology")


def drop_short_prefixes(path: Column) -> Column:
    for p in SHORT_PREFIXES:
        path = F.replace(path, F.lit(p), F.lit(""))
    return path


def module_name(file: Column) -> Column:
    """``name@2020-01-01.yang`` -> ``name``; a date after a hyphen goes too."""
    base = F.regexp_replace(F.regexp_replace(file, r"\.yang", ""), "@.*$", "")
    return F.regexp_replace(base, r"-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")


def normalize_path(path: Column, module: Column) -> Column:
    """Anchor a path at its module; see :data:`ANCHORED_MODULES` for those left alone."""
    clean = drop_short_prefixes(F.regexp_replace(path, "/+", "/"))
    clean = F.concat(F.lit("/"), F.regexp_replace(clean, "^/+", ""))
    first = F.when(F.regexp_replace(clean, "/", "") != "", F.regexp_extract(clean, "^/+([^/]+)", 1))
    anchored = first.isNull() | (first == module) | first.isin(*ANCHORED_MODULES) | module.isNull() | (module == "")
    return F.when(path.isNull() | (path == ""), F.lit("/")).when(anchored, clean).otherwise(F.concat(F.lit("/"), module, clean))


def xpath_clean(xpath: Column) -> Column:
    """XPath text without prefixes, predicates, current() and outer slashes."""
    x = F.regexp_replace(xpath, r"\w+:", "")
    x = F.regexp_replace(x, r"\[.*?\]", "")
    x = F.replace(x, F.lit("current()"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(x, "/+", "/"), "^/+|/+$", "")


def augment_target(arg: Column) -> Column:
    clean = drop_short_prefixes(arg)
    anchored = F.when(F.startswith(clean, F.lit("/networks")), F.concat(F.lit("/ietf-network"), clean))
    return F.regexp_replace(anchored.otherwise(F.concat(F.lit("/"), F.regexp_replace(clean, "^/+", ""))), "/+", "/")


def local_name(name: Column) -> Column:
    """What follows the last colon."""
    return F.element_at(F.split(name, ":"), -1)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """The path without its last segment."""
    return F.regexp_replace(path, "/[^/]*$", "")


def has_name(segment: Column) -> Column:
    """``network-element`` -> ``hasNetworkElement``; the tail of each word is lower-cased."""
    words = F.transform(F.split(segment, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.concat(F.lit("has"), F.array_join(words, ""))


def prov_segment(prefix: Column, name: Column, keyword: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("ex")), F.lit(":"), name, F.lit("?"), keyword)


def range_parts(text: Column) -> Column:
    """The integer ``low..high`` parts of a range or length text; others are dropped."""
    parts = F.transform(F.split(text, r"\|"), lambda p: F.split(F.trim(p), r"\.\."))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & p[0].rlike(r"^\s*[+-]?[0-9]+\s*$") & p[1].rlike(r"^\s*[+-]?[0-9]+\s*$"))
    return F.transform(good, lambda p: F.struct(F.trim(p[0]).cast("long").alias("low"), F.trim(p[1]).cast("long").alias("high")))


def range_hull(text: Column) -> Column:
    """Least low and greatest high of the integer parts, as a struct; nulls if there are none."""
    parts = range_parts(text)
    return F.struct(F.array_min(F.transform(parts, lambda p: p["low"])).alias("low"), F.array_max(F.transform(parts, lambda p: p["high"])).alias("high"))
