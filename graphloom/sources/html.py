"""HTML view of a statement table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements left out of the view, those with a class of their own, and those shown without children.
SKIPPED = ("description", "reference", "organization", "contact", "revision")
CLASSED = ("container", "list", "leaf", "augment", "grouping")
CLOSED = ("leaf", "leaf-list", "typedef")
#: Keywords stand out, what explains them is muted.
STYLE = "main, li { line-height: 1.5 } .keyword { color: #05a } .keyword::after { content: ' ' } .type, .desc { color: #666 } h2 { border-bottom: thin solid }"


def node_html(keyword: Column, arg: Column, type_name: Column, description: Column, children: Column) -> Column:
    """One list item; the first line of the description is cut to 60 characters, and a statement without argument shows None."""
    css = F.when(keyword.isin(*CLASSED), keyword).otherwise("other")
    brief = F.substr(F.substring_index(description, "\n", 1), F.lit(1), F.lit(60))
    return F.concat(
        F.lit("<li class='"), css, F.lit("'><span class='keyword'>"), keyword, F.lit("</span><span class='arg'>"), F.coalesce(arg, F.lit("None")), F.lit("</span>"),
        F.coalesce(F.concat(F.lit('<span class="type">('), type_name, F.lit(")</span>")), F.lit("")),
        F.coalesce(F.concat(F.lit('<span class="desc">"'), brief, F.lit('..."</span>')), F.lit("")),
        F.when(F.coalesce(children, F.lit("")) != "", F.concat(F.lit("<ul>"), children, F.lit("</ul>"))).otherwise(F.lit("")),
        F.lit("</li>"),
    )


def html_tree(stmts: DataFrame) -> DataFrame:
    """(file, html): the nested list of each module, built bottom-up, one join for each depth."""
    first = stmts.where(F.col("keyword").isin("type", "description")).groupBy("file", F.col("parent_id").alias("stmt_id")).agg(
        F.min_by("arg", F.when(F.col("keyword") == "type", F.col("ordinal"))).alias("type_name"),
        F.min_by("arg", F.when(F.col("keyword") == "description", F.col("ordinal"))).alias("description"),
    )
    nodes = stmts.where(~F.col("keyword").isin(*SKIPPED)).join(first, ["file", "stmt_id"], "left")
    deepest = stmts.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", F.lit(""))
        else:
            level = level.join(below, ["file", "stmt_id"], "left")
        shown = F.when(F.col("keyword").isin(*CLOSED), F.lit("")).otherwise(F.col("children"))
        level = level.select("file", F.col("parent_id").alias("stmt_id"), "ordinal", node_html(F.col("keyword"), F.col("arg"), F.col("type_name"), F.col("description"), shown).alias("h"))
        below = level.groupBy("file", "stmt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]), "").alias("children"))
    if below is None:
        return stmts.select("file", F.lit("").alias("html")).distinct()
    return stmts.where("depth = 0").select("file", "stmt_id").join(below, ["file", "stmt_id"], "left").select("file", F.coalesce("children", F.lit("")).alias("html"))


def html_page(stmts: DataFrame) -> str:
    """The whole document; modules in order of their names. Model trees are read by people, so they fit a driver."""
    parts = [f"<!DOCTYPE html><html><head><title>YANG Parse Tree</title><style>{STYLE}</style></head><body><h1>YANG Parse Tree</h1>"]
    parts += (f"<div class='module-box'><h2>Module: {r[0]}</h2><ul>{r[1]}</ul></div>" for r in html_tree(stmts).orderBy("file").toLocalIterator())
    return "".join([*parts, "</body></html>"])
