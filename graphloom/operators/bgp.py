"""Basic graph patterns as joins over a triple table.

Each pattern becomes a filtered scan with only its variables, so a table
partitioned by predicate is read where it matters; patterns that share a
variable meet in equi-joins on whole terms (kind, datatype and language
included), and Catalyst picks the join strategy. Bag semantics, as in SPARQL.
A graph is one frame, or a frame for each predicate (``triples.by_predicate``);
from the latter a pattern with a fixed predicate plans and reads its frame only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triples import object_term, subject_term

Pattern = tuple[str, str, str]  # terms in N-Triples form, or ?variables
Graph = DataFrame | dict[str, DataFrame]


@dataclass
class Query:
    variables: list[str]
    patterns: list[Pattern]
    optionals: list[list[Pattern]] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)  # (variable, descending)
    distinct: bool = False
    limit: int | None = None


def _chosen(graph: Graph, p: str) -> DataFrame:
    """What can have triples of a pattern's predicate."""
    if isinstance(graph, DataFrame):
        return graph
    if p.startswith("?"):
        return reduce(DataFrame.unionByName, graph.values())
    return graph[p[1:-1]] if p[1:-1] in graph else next(iter(graph.values()))


def _scan(graph: Graph, pattern: Pattern) -> DataFrame:
    s, p, o = pattern
    rows, cols = _chosen(graph, p), {}
    if not p.startswith("?"):
        rows = rows.where(F.col("p") == p[1:-1])
    if not s.startswith("?"):
        rows = rows.where(F.col("s") == (s[1:-1] if s.startswith("<") else s))
    if not o.startswith("?"):
        rows = rows.where((F.col("o") == o[1:-1]) & (F.col("o_kind") == "iri")) if o.startswith("<") else rows.where(object_term() == o)
    for term, col in ((s, subject_term()), (p, F.concat(F.lit("<"), F.col("p"), F.lit(">"))), (o, object_term())):
        if term.startswith("?"):
            if term[1:] in cols:
                rows = rows.where(cols[term[1:]] == col)
            else:
                cols[term[1:]] = col
    return rows.select(*(c.alias(v) for v, c in cols.items()))


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    if not shared:
        # patterns without a common variable have no key to join on
        raise ValueError(f"patterns share no variable: {left.columns} and {right.columns}")
    return left.join(right, shared, how)


def _group(graph: Graph, patterns: list[Pattern], bound: DataFrame | None = None) -> DataFrame:
    """Join patterns, each next one sharing a variable with what is joined already if any does."""
    left, out = list(patterns), bound
    while left:
        have = set(out.columns) if out is not None else None
        i = 0 if have is None else next((k for k, p in enumerate(left) if any(t.startswith("?") and t[1:] in have for t in p)), 0)
        scan = _scan(graph, left.pop(i))
        out = scan if out is None else _join(out, scan, "inner")
    return out


def lexical(term: Column) -> Column:
    """The text of a term: an IRI without brackets, a literal without quotes."""
    inner = F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\\\", "\\")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    return F.when(F.startswith(term, F.lit("<")), F.regexp_replace(term, "^<|>$", "")).when(F.startswith(term, F.lit('"')), inner).otherwise(term)


def _numeric(term: Column) -> Column:
    typed = term.rlike(r'\^\^<http://www\.w3\.org/2001/XMLSchema#(?:integer|int|long|short|byte|decimal|double|float|unsigned\w+|\w*[iI]nteger)>$')
    return F.when(typed, lexical(term).try_cast("double"))


def solve(graph: Graph, query: Query) -> DataFrame:
    """Rows of lexical values, one column for each variable asked for; unbound is null."""
    out = _group(graph, query.patterns)
    for group in query.optionals:
        out = _join(out, _group(graph, group), "left")
    rows = out.select(*query.variables, *(v for v, _ in query.order if v not in query.variables))
    if query.distinct:
        rows = rows.distinct()
    if query.order:
        keys = []
        for v, down in query.order:
            for k in (_numeric(F.col(v)), lexical(F.col(v))):
                keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
        rows = rows.orderBy(*keys)
    if query.limit is not None:
        rows = rows.limit(query.limit)
    return rows.select(*(lexical(F.col(v)).alias(v) for v in query.variables))
