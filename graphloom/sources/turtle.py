"""Turtle documents as triples, and triples as Turtle or N-Triples files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import RDF, TRIPLE, XSD, ntriples, object_term, subject_term

_TOKEN = re.compile(
    r"\s+|#[^\n]*"
    r"|<(?P<iri>[^<>\"{}|^`\\\s]*)>"
    r"|(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')"
    r"|(?P<short>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|@(?P<at>[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)"
    r"|(?P<types>\^\^)"
    r"|_:(?P<bnode>[\w.-]*\w)"
    r"|(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+(?:[eE][+-]?[0-9]+)?)(?![\w:]))"
    r"|(?P<name>(?:[\w](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w.:%/-]|\\.)*(?:[\w:%/-]|\\.))?)?)"
    r"|(?P<word>[a-zA-Z]+)"
    r"|(?P<punct>[.;,\[\]()])",
    re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
#: Tasks, and so files, of one predicate at most.
SPREAD = 64
Term = tuple[str, str, str | None, str | None]  # value, kind, datatype, language


def _text(raw: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)


class _Reader:
    def __init__(self, text: str, scope: str):
        self.tokens = self._scan(text)
        self.scope, self.count = scope, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[tuple] = []
        self.next = next(self.tokens, None)

    @staticmethod
    def _scan(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                yield m.lastgroup, m[m.lastgroup]

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.next is None or kind and self.next[0] != kind or value and self.next[1] != value:
            raise ValueError(f"{value or kind} expected, found {self.next}")
        got = self.next[1]
        self.next = next(self.tokens, None)
        return got

    def at(self, value: str) -> bool:
        return self.next == ("punct", value)

    def bnode(self) -> Term:
        self.count += 1
        return f"_:{self.scope}g{self.count}", "bnode", None, None

    def iri(self, raw: str) -> str:
        return raw if re.match(r"[a-zA-Z][\w+.-]*:", raw) else self.base + raw

    def term(self) -> Term:
        kind, value = self.next or ("", "")
        if kind == "punct" and value == "[":
            self.take()
            node = self.bnode()
            if not self.at("]"):
                self.facts(node)
            self.take("punct", "]")
            return node
        if kind == "punct" and value == "(":
            self.take()
            items = []
            while not self.at(")"):
                items.append(self.term())
            self.take()
            tail: Term = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.bnode()
                self.add(node, RDF + "first", item)
                self.add(node, RDF + "rest", tail)
                tail = node
            return tail
        self.take()
        if kind == "iri":
            return self.iri(_text(value)), "iri", None, None
        if kind == "name":
            prefix, local = value.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "bnode":
            return f"_:{self.scope}{value}", "bnode", None, None
        if kind == "number":
            return value, "literal", XSD + ("integer" if re.fullmatch(r"[+-]?[0-9]+", value) else "double" if "e" in value.lower() else "decimal"), None
        if kind == "word" and value in ("true", "false"):
            return value, "literal", XSD + "boolean", None
        if kind in ("long", "short"):
            text = _text(value[3:-3] if kind == "long" else value[1:-1])
            if self.next and self.next[0] == "at":
                return text, "literal", RDF + "langString", self.take()
            if self.next and self.next[0] == "types":
                self.take()
                return text, "literal", self.term()[0], None
            return text, "literal", XSD + "string", None
        raise ValueError(f"unexpected {value!r}")

    def add(self, s: Term, p: str, o: Term) -> None:
        self.out.append((s[0], p, o[0], o[1], o[2], o[3]))

    def facts(self, s: Term) -> None:
        while True:
            if self.next == ("word", "a"):
                self.take()
                p = RDF + "type"
            else:
                p = self.term()[0]
            self.add(s, p, self.term())
            while self.at(","):
                self.take()
                self.add(s, p, self.term())
            while self.at(";"):
                self.take()
            if self.next is None or self.at(".") or self.at("]"):
                return

    def read(self) -> list[tuple]:
        while self.next:
            kind, value = self.next
            if kind == "at" and value in ("prefix", "base") or kind == "word" and value.lower() in ("prefix", "base"):
                self.take()
                if value.lower() == "prefix":
                    name = self.take("name")
                    self.prefixes[name[:-1]] = self.iri(self.take("iri"))
                else:
                    self.base = self.iri(self.take("iri"))
                if kind == "at":
                    self.take("punct", ".")
                continue
            s = self.term()
            if not (self.at(".") and s[1] == "bnode"):
                self.facts(s)
            self.take("punct", ".")
        return self.out


def parse(text: str, scope: str = "") -> list[tuple]:
    """(s, p, o, o_kind, o_dt, o_lang) of one document; blank nodes get ``scope`` in their names."""
    return _Reader(text, scope).read()


def parse_documents(texts: DataFrame) -> DataFrame:
    """Triples of rows (file, text), as a set. A document that does not parse fails the read with its name."""

    def run(batches):
        import hashlib

        import pandas as pd

        for b in batches:
            out = []
            for file, text in zip(b["file"], b["text"]):
                try:
                    out += parse(text, f"b{hashlib.sha1(file.encode()).hexdigest()[:8]}")
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from e
            yield pd.DataFrame(out, columns=["s", "p", "o", "o_kind", "o_dt", "o_lang"])

    return texts.select("file", "text").mapInPandas(run, TRIPLE).dropDuplicates()


def read_turtle(spark: SparkSession, *paths: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.ttl").text(list(paths), wholetext=True)
    return parse_documents(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def turtle_blocks(graph: DataFrame) -> DataFrame:
    """(s, block): one Turtle statement for each subject."""
    fact = F.struct(F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), object_term().alias("o"))
    rows = graph.select(subject_term().alias("s"), fact.alias("f")).groupBy("s").agg(F.array_sort(F.collect_set("f")).alias("f"))
    body = F.array_join(F.transform("f", lambda x: F.concat_ws(" ", x["p"], x["o"])), " ;\n    ")
    return rows.select("s", F.concat(F.col("s"), F.lit(" "), body, F.lit(" .")).alias("block"))


def write_turtle(graph: DataFrame, path: str, single: bool = False) -> None:
    """Subjects in order, as text files; ``single`` makes one file, for graphs that one task can sort."""
    blocks = turtle_blocks(graph)
    blocks = blocks.coalesce(1).sortWithinPartitions("s") if single else blocks.orderBy("s")
    blocks.select("block").write.mode("overwrite").text(path)


def write_ntriples(graph: DataFrame, path: str) -> None:
    ntriples(graph).write.mode("overwrite").text(path)


def write_triples(graph: DataFrame, path: str) -> None:
    """Parquet by predicate: a pattern with a bound predicate reads its folder alone.

    A predicate's rows go to ``SPREAD`` tasks by subject, so that one that all subjects have is no task of its own.
    """
    graph.repartition("p", F.pmod(F.xxhash64("s"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("p").parquet(path)
