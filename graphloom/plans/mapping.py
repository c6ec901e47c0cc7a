"""Constant mapping rules: triples that hold once an XML document has what a rule looks for.

Rules are read from their own Turtle, in which a triples map names an XPath
iterator, a constant subject and constant predicate-object pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import COLUMNS

RML = "http://semweb.mmlab.be/ns/rml#"


def read_rules(graph: DataFrame) -> DataFrame:
    """(map_id, iterator, s, p, o, o_kind, o_dt, o_lang) of the triples maps in a mapping's graph."""

    def step(name: str, subject: str, obj: str) -> DataFrame:
        """Triples of a property, whatever vocabulary the mapping binds its prefix to."""
        return graph.where(F.col("p").rlike(f"[#/]{name}$")).select(F.col("s").alias(subject), F.col("o").alias(obj))

    iterators = step("logicalSource", "map_id", "src").join(step("iterator", "src", "iterator"), "src")
    subjects = step("subjectMap", "map_id", "sm").join(step("constant", "sm", "subject"), "sm")
    predicates = step("predicate", "pom", "predicate")
    objects = step("objectMap", "pom", "om").join(graph.where(F.col("p").rlike("[#/]constant$")).select(F.col("s").alias("om"), "o", "o_kind", "o_dt", "o_lang"), "om")
    pairs = step("predicateObjectMap", "map_id", "pom").join(predicates, "pom").join(objects, "pom")
    return iterators.join(subjects, "map_id").join(pairs, "map_id").select("map_id", "iterator", F.col("subject").alias("s"), F.col("predicate").alias("p"), "o", "o_kind", "o_dt", "o_lang")


def matching_iterators(spark: SparkSession, xml: DataFrame, iterators: list[str]) -> DataFrame:
    """The iterators that find a node in some row of ``xml`` (one column, ``xml``). Element prefixes are ignored."""
    tests = [F.when(F.expr(f"xpath_boolean(xml, {_quoted(i)})"), F.lit(i)) for i in iterators]
    if not tests:
        return spark.createDataFrame([], "iterator string")
    plain = xml.select(F.regexp_replace("xml", r"(</?)[A-Za-z_][\w.-]*:", "$1").alias("xml"))
    return plain.select(F.explode(F.array(*tests)).alias("iterator")).where("iterator IS NOT NULL").distinct()


def _quoted(iterator: str) -> str:
    import re

    path = re.sub(r"(?<=[/\[@(])[A-Za-z_][\w.-]*:(?=[A-Za-z_])", "", iterator)
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_rules(rules: DataFrame, xml: DataFrame) -> DataFrame:
    """Constant triples of the rules whose iterator matches. The distinct iterators are part of the mapping, a few dozen texts."""
    spark = rules.sparkSession
    names = sorted(r[0] for r in rules.select("iterator").distinct().collect())
    hits = matching_iterators(spark, xml, names)
    return rules.join(F.broadcast(hits), "iterator", "left_semi").select(*COLUMNS).dropDuplicates()


def yin(stmts: DataFrame) -> DataFrame:
    """(file, xml): each module in its XML form, built bottom-up. Arguments become attributes named as the grammar names them."""
    name = {"namespace": "uri", "import": "module", "include": "module", "revision": "date", "augment": "target-node", "must": "condition", "when": "condition", "pattern": "value", "range": "value", "length": "value", "path": "value", "key": "value", "mandatory": "value", "config": "value", "default": "value", "status": "value", "prefix": "value", "yang-version": "value", "base": "name", "presence": "value", "units": "name", "if-feature": "name", "refine": "target-node", "position": "value", "min-elements": "value", "max-elements": "value", "fraction-digits": "value", "ordered-by": "value", "require-instance": "value", "unique": "tag", "belongs-to": "module", "revision-date": "date", "error-app-tag": "value"}
    words = F.create_map(*(F.lit(x) for kv in name.items() for x in kv))
    element = ("description", "reference", "organization", "contact", "error-message")

    def escaped(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    deepest = stmts.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = stmts.where(F.col("depth") == depth)
        level = level.withColumn("children", F.lit("")) if below is None else level.join(below, ["file", "stmt_id"], "left")
        tag = F.regexp_replace("keyword", ":", "-")
        inner = F.when(F.col("keyword").isin(*element), F.concat(F.lit("<text>"), escaped(F.col("arg")), F.lit("</text>"))).otherwise(F.lit(""))
        attr = F.when(F.col("arg").isNotNull() & ~F.col("keyword").isin(*element), F.concat(F.lit(" "), F.coalesce(words[F.col("keyword")], F.lit("name")), F.lit('="'), escaped(F.col("arg")), F.lit('"'))).otherwise(F.lit(""))
        level = level.select("file", F.col("parent_id"), "ordinal", F.concat(F.lit("<"), tag, attr, F.lit(">"), inner, F.coalesce("children", F.lit("")), F.lit("</"), tag, F.lit(">")).alias("x"))
        if depth == 0:
            return level.select("file", F.col("x").alias("xml"))
        below = level.groupBy("file", F.col("parent_id").alias("stmt_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "x"))), lambda r: r["x"]), "").alias("children"))
    return stmts.select("file", F.lit("").alias("xml"))
