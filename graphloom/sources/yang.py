"""YANG modules as a table of statements.

Files are read whole by Spark, one row each, and a small parser for the YANG
statement grammar turns each into rows (file, stmt_id, parent_id, ordinal,
depth, keyword, arg). A file that does not parse gives one row with keyword
``!error`` and the reason, and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import module_name

ERROR = "!error"
_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<punct>[{};])|(?P<plus>\+(?=\s*[\"']|\s*/[/*]))|\"(?P<double>(?:[^\"\\]|\\.)*)\"|'(?P<single>[^']*)'|(?P<word>(?:(?!//|/\*)[^\s{};\"'])(?:(?!//|/\*)[^\s{};])*)", re.S)
_ESCAPE = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}


class YangSyntaxError(ValueError):
    pass


def _columns(text: str) -> int:
    n = 0
    for c in text:
        n = n // 8 * 8 + 8 if c == "\t" else n + 1
    return n


def _unquote(raw: str, column: int) -> str:
    """Text of a double-quoted string whose quote stands at ``column``: later lines lose their indent up to it."""
    lines = raw.split("\n")
    for i in range(len(lines)):
        line = lines[i]
        if i:
            at = 0
            k = 0
            while k < len(line) and line[k] in " \t" and at <= column:
                at = at // 8 * 8 + 8 if line[k] == "\t" else at + 1
                k += 1
            line = " " * max(0, at - column - 1) + line[k:]
        lines[i] = line.rstrip(" \t\r") if i < len(lines) - 1 else line
    return re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], "\\" + m[1]), "\n".join(lines), flags=re.S)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise YangSyntaxError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at : at + 20]!r}")
        if m["punct"]:
            yield "punct", m["punct"]
        elif m["plus"]:
            yield "plus", "+"
        elif m["double"] is not None:
            yield "string", _unquote(m["double"], _columns(text[text.rfind("\n", 0, at) + 1 : at]))
        elif m["single"] is not None:
            yield "string", m["single"]
        elif m["word"]:
            yield "word", m["word"]
        at = m.end()


def parse(text: str) -> list[tuple[int, int | None, int, int, str, str | None]]:
    """(stmt_id, parent_id, ordinal, depth, keyword, arg) in document order; ids count from 0."""
    rows: list[list] = []
    stack: list[int] = []
    kids: dict[int | None, int] = {}
    state, keyword, arg, joining = "keyword", None, None, False

    def add() -> int:
        parent = stack[-1] if stack else None
        rows.append([len(rows), parent, kids.get(parent, 0), len(stack), keyword, arg])
        kids[parent] = kids.get(parent, 0) + 1
        return len(rows) - 1

    for kind, value in _tokens(text):
        if state == "keyword":
            if kind == "punct" and value == "}":
                if not stack:
                    raise YangSyntaxError("unmatched }")
                stack.pop()
            elif kind == "word":
                keyword, arg, joining, state = value, None, False, "arg"
            else:
                raise YangSyntaxError(f"keyword expected, found {value!r}")
        elif kind == "punct":
            if value == "}" or joining:
                raise YangSyntaxError(f"{keyword}: ; or {{ expected")
            n = add()
            if value == "{":
                stack.append(n)
            state = "keyword"
        elif kind == "plus":
            if arg is None:
                raise YangSyntaxError(f"{keyword}: + without a string")
            joining = True
        elif arg is None:
            arg = value
        elif joining and kind == "string":
            arg, joining = arg + value, False
        else:
            raise YangSyntaxError(f"{keyword}: unexpected {value!r}")
    if stack or state != "keyword":
        raise YangSyntaxError("the file ends inside a statement")
    if sum(r[3] == 0 for r in rows) != 1 or rows[0][4] not in ("module", "submodule"):
        raise YangSyntaxError("one module is expected")
    return [tuple(r) for r in rows]


STATEMENT = "file string, stmt_id long, parent_id long, ordinal int, depth int, keyword string, arg string"


def parse_modules(texts: DataFrame) -> DataFrame:
    """Statements of rows (file, text)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for file, text in zip(b["file"], b["text"]):
                try:
                    out += [(file, *r) for r in parse(text)]
                except ValueError as e:
                    out.append((file, 0, None, 0, 0, ERROR, str(e)))
            frame = pd.DataFrame(out, columns=["file", "stmt_id", "parent_id", "ordinal", "depth", "keyword", "arg"])
            yield frame.astype({"parent_id": "Int64"})

    return texts.select("file", "text").mapInPandas(run, STATEMENT)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the YANG files in a folder."""
    raw = spark.read.option("pathGlobFilter", "*.yang").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def load_order(stmts: DataFrame, main: str | None = None) -> DataFrame:
    """Add module (from the file name), prefix, and both orders of modules: ``load_seq`` (main first) and ``walk_seq``."""
    files = stmts.select("file").distinct()
    first = F.when(F.col("file") == F.lit(main), 0).otherwise(1) if main else F.lit(1)
    # one row for each module
    seq = files.select("file", F.row_number().over(Window.orderBy(first, "file")).alias("load_seq"), F.row_number().over(Window.orderBy("file")).alias("walk_seq"))
    prefix = stmts.where("depth = 1 AND keyword = 'prefix'").groupBy("file").agg(F.min_by("arg", "ordinal").alias("prefix"))
    return stmts.join(F.broadcast(seq), "file").join(F.broadcast(prefix), "file", "left").withColumn("module", module_name(F.col("file")))


def read_modules(spark: SparkSession, path: str, main: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, errors) of a folder of modules."""
    parsed = parse_modules(read_texts(spark, path))
    return load_order(parsed.where(F.col("keyword") != ERROR), main), parsed.where(F.col("keyword") == ERROR).select("file", F.col("arg").alias("reason"))
