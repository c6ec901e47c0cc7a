"""Triples as rows: building, set union, statistics, comparison.

A triple is (s, p, o, o_kind, o_dt, o_lang), all strings; o_kind is ``iri``,
``bnode`` or ``literal``; a graph is a set, so unions end in dropDuplicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
COLUMNS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
PROV = "http://www.w3.org/ns/prov#"
TYPE, LABEL, COMMENT, DOMAIN, RANGE, SUBCLASS = RDF + "type", RDFS + "label", RDFS + "comment", RDFS + "domain", RDFS + "range", RDFS + "subClassOf"
CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, INDIVIDUAL = OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "NamedIndividual"
#: Source rows of more estimated bytes than this are dealt out by ``spread``, into pieces of this size at most.
PIECE = 1 << 20
DERIVED, DISJOINT, MIN_CARDINALITY = PROV + "wasDerivedFrom", OWL + "disjointWith", OWL + "minCardinality"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iri(p: str, o, s=None) -> Column:
    return _po(s, p, _col(o), "iri", None)


def text(p: str, o, s=None) -> Column:
    return _po(s, p, _col(o), "literal", XSD + "string")


def number(p: str, o, s=None) -> Column:
    return _po(s, p, _col(o).cast("string"), "literal", XSD + "integer")


def boolean(p: str, o, s=None) -> Column:
    return _po(s, p, _col(o).cast("string"), "literal", XSD + "boolean")


def _po(s, p: str, o: Column, kind: str, dt: str | None) -> Column:
    return F.struct(
        (_col(s) if s is not None else F.lit(None).cast("string")).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
    )


def spread(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows of a large table dealt out by hash before they become triples; small ones stay where they are.

    A row becomes several wide triples, which the task that makes them also gathers to drop repeated ones. A scan task can hold a
    whole table (row groups aren't split), and then the memory of one task would grow with the table. The size is the planner's
    estimate of the columns given: select the needed ones first. The number of pieces is fixed, so that adaptive execution, which
    sees narrow rows, doesn't merge them again.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= piece:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // piece)), *rows.columns)


def emit(rows: DataFrame, subject: Column, *facts: Column) -> DataFrame:
    """One source row becomes one triple for each fact whose subject and object are not null."""
    t = rows.select(subject.alias("__s"), (facts[0] if len(facts) == 1 else F.explode(F.array(*facts))).alias("t"))
    return t.select(F.coalesce("t.s", "__s").alias("s"), "t.p", "t.o", "t.o_kind", "t.o_dt", "t.o_lang").where("s IS NOT NULL AND o IS NOT NULL")


def by_predicate(rows: DataFrame, subject: Column, *facts) -> dict[str, DataFrame]:
    """The triples of ``emit`` as a frame for each predicate: a pattern with a fixed one then reads only what its fact is made of.

    facts: (``iri``, ``text``, ``number`` or ``boolean``, predicate, object).
    """
    return merged(*({p: emit(rows, subject, make(p, o))} for make, p, o in facts))


def merged(*graphs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All triples of graphs that are kept by predicate; repeated ones stay."""
    out: dict[str, DataFrame] = {}
    for g in graphs:
        for p, rows in g.items():
            out[p] = out[p].unionByName(rows) if p in out else rows
    return out


def triple_set(*graphs: DataFrame) -> DataFrame:
    """Union with set semantics."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates()


def cardinality_default(graph: DataFrame) -> DataFrame:
    """minCardinality 0 for every object property."""
    props = graph.where((F.col("p") == TYPE) & (F.col("o") == OBJECT_PROPERTY)).select("s").distinct()
    return emit(props, F.col("s"), number(MIN_CARDINALITY, 0))


def triple_stats(graph: DataFrame) -> DataFrame:
    return graph.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


def canonical(graph: DataFrame) -> DataFrame:
    """disjointWith is symmetric: the smaller IRI becomes the subject."""
    swap = (F.col("p") == DISJOINT) & (F.col("s") > F.col("o"))
    return graph.withColumns({"s": F.when(swap, F.col("o")).otherwise(F.col("s")), "o": F.when(swap, F.col("s")).otherwise(F.col("o"))}).dropDuplicates()


def graph_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Triples of one graph only, with ``side``."""
    a, b = canonical(left.select(*COLUMNS)), canonical(right.select(*COLUMNS))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def _escape(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def object_term(o="o", kind="o_kind", dt="o_dt", lang="o_lang") -> Column:
    """The object in N-Triples form; plain strings carry no datatype."""
    literal = F.concat(F.lit('"'), _escape(F.col(o)), F.lit('"'), F.when(F.col(lang).isNotNull(), F.concat(F.lit("@"), F.col(lang))).when(F.col(dt).isNotNull() & (F.col(dt) != XSD + "string"), F.concat(F.lit("^^<"), F.col(dt), F.lit(">"))).otherwise(F.lit("")))
    return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), F.col(o), F.lit(">"))).when(F.col(kind) == "bnode", F.col(o)).otherwise(literal)


def subject_term(s="s") -> Column:
    return F.when(F.startswith(F.col(s), F.lit("_:")), F.col(s)).otherwise(F.concat(F.lit("<"), F.col(s), F.lit(">")))


def ntriples(graph: DataFrame) -> DataFrame:
    """One line for each triple."""
    return graph.select(F.concat_ws(" ", subject_term(), F.concat(F.lit("<"), F.col("p"), F.lit(">")), object_term(), F.lit(".")).alias("line"))
