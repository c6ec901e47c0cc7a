"""URL allow and block lists by host suffix and path prefix.

Each URL is expanded into expressions ``host suffix + path prefix``: all label
suffixes of its host, times the prefixes of its path that have the length of
some rule's path. Expressions and rules meet in an equi-join on a short prefix
of their SHA-256 digests; the full digest confirms a match and the longest rule
wins. Everything runs as DataFrame expressions. Up to ``ROW_RULES`` rules the
join's table is part of the plan and each row looks its expressions up, so no
row moves; with more, each distinct address is joined once.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule; such a URL gets the default verdict, and so does an empty table's
every row (none). Repeated rows are judged alike and all returned. Input columns named
``host``, ``path``, ``rule`` or ``verdict`` are not carried into the result.
Rules of equal length that both fit: the longer host wins, then ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_groups

#: Up to so many rules are literals of the plan, looked up in each row.
ROW_RULES = 256
#: More rules than this are joined by shuffle instead of being broadcast (about 100 bytes each).
BROADCAST_RULES = 100_000
#: Hex digits of a digest that the equi-join compares.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]; an empty host has none."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def _looked_up(rules: list, tried: Column) -> Column:
    """The best rule of an address, from a table of literals keyed by the short digest; nothing moves."""
    rule = "struct<n:int,r_hlen:int,r_verdict:string,r_rule:string>"
    by_key: dict[str, list] = {}
    for r in rules:
        by_key.setdefault(r["r_key"], []).append(F.struct(F.lit(r["r_digest"]).alias("digest"), F.struct(
            F.lit(len(r["r_rule"])).alias("n"), F.lit(r["r_hlen"]).alias("r_hlen"), F.lit(r["r_verdict"]).alias("r_verdict"), F.lit(r["r_rule"]).alias("r_rule")).alias("rule")))
    if not by_key:
        return F.lit(None).cast(rule)
    table = F.create_map(*(x for k, v in sorted(by_key.items()) for x in (F.lit(k), F.array(*v))))
    hits = F.transform(tried, lambda d: F.filter(F.coalesce(table[F.substring(d, 1, PREFIX_DIGITS)], F.array().cast(f"array<struct<digest:string,rule:{rule}>>")), lambda r: r["digest"] == d))
    return F.array_max(F.transform(F.flatten(hits), lambda r: r["rule"]))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; ``rules`` has (host, path, verdict)."""
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    known = clean.select(
        F.concat("r_host", "r_path").alias("r_rule"), "r_verdict", F.length("r_host").alias("r_hlen"),
        F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256).alias("r_digest"),
    ).withColumn("r_key", F.substring("r_digest", 1, PREFIX_DIGITS))
    # one short list for any number of rules: their paths' distinct lengths
    lengths, count = clean.agg(F.sort_array(F.collect_set(F.length("r_path"))), F.count(F.lit(1))).first()
    drop = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url]
    judged = pages.withColumns({"__host": url_host(F.col(url)), "__path": url_path(F.col(url))})
    prefixes = F.array(*(F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    # digests of all expressions: host suffixes times path prefixes
    tried = F.flatten(F.transform(host_suffixes(F.col("__host")), lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))
    if count <= ROW_RULES:
        out = judged.withColumn("best", _looked_up(known.collect(), tried))
    else:
        # one row for each distinct address, known by a digest, so that a popular one is no hot key
        judged = judged.withColumn("__place", F.unhex(F.sha2(F.concat_ws("\n", "__host", "__path"), 256)))
        places = judged.groupBy("__place").agg(F.any_value("__host").alias("__host"), F.any_value("__path").alias("__path"), F.count(F.lit(1)).alias("__n"))
        digests = places.select("__place", F.explode(tried).alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
        hits = digests.join(F.broadcast(known) if count <= BROADCAST_RULES else known, F.col("key") == F.col("r_key")).where(F.col("digest") == F.col("r_digest"))
        best = hits.groupBy("__place").agg(F.max(F.struct(F.length("r_rule").alias("n"), "r_hlen", "r_verdict", "r_rule")).alias("best"))
        named = places.select("__place", "__n").join(best, "__place", "left")
        out = join_groups(judged, named, ["__place"], "__n", judged.count())
    return out.drop(*drop).select(
        *(F.col(c) for c in pages.columns if c not in drop),
        F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("best.r_rule").alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )
