import pytest

from graphloom.operators import triples as T
from graphloom.plans.mapping import apply_rules, read_rules, yin
from graphloom.plans.sparql import SparqlError, parse_query, sparql
from graphloom.sources import turtle, yang

DOC = '''@prefix ex: <http://e/> . @base <http://b/> .
PREFIX x: <http://x/>
ex:a a ex:Thing ; ex:name "A \\"q\\"\\n" , "B"@en-GB ; ex:size 12 , 1.5 , 1e3 ; ex:ok true ; ex:at <rel> .
ex:b ex:has [ ex:ref ex:a ; ex:rank 2 ] , [ ] ; ex:list ( 1 "two" ) ; ex:long """x "y"
z""" ; ex:d "2020"^^x:year .
_:n ex:name "N" . # done
ex:c.d ex:name 'single' .'''


@pytest.fixture(scope="module")
def graph(spark):
    return turtle.parse_documents(spark.createDataFrame([("d.ttl", DOC)], "file string, text string")).cache()


def test_turtle_terms():
    got = {(s, p, o): (k, d, lang) for s, p, o, k, d, lang in turtle.parse(DOC, "s")}
    e = "http://e/"
    assert got[e + "a", e + "name", 'A "q"\n'] == ("literal", T.XSD + "string", None)
    assert got[e + "a", e + "name", "B"][2] == "en-GB" and got[e + "a", e + "at", "http://b/rel"][0] == "iri"
    assert [got[e + "a", e + "size", v][1].split("#")[1] for v in ("12", "1.5", "1e3")] == ["integer", "decimal", "double"]
    assert got[e + "b", e + "d", "2020"][1] == "http://x/year" and got[e + "b", e + "long", 'x "y"\nz']
    assert got["_:sn", e + "name", "N"] and got[e + "c.d", e + "name", "single"]
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", '<a> <b> "x .'):
        with pytest.raises(ValueError):
            turtle.parse(bad)


def test_turtle_round_trip(spark, graph, tmp_path):
    turtle.write_turtle(graph, str(tmp_path / "t"), single=True)
    turtle.write_ntriples(graph, str(tmp_path / "n"))
    plain = graph.where("o_kind <> 'bnode' AND s NOT LIKE '\\\\_:%'")
    for d in ("t", "n"):
        text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / d)).collect()) if d == "n" else "".join(p.read_text() for p in (tmp_path / d).glob("part-*"))
        back = spark.createDataFrame(turtle.parse(text), T.TRIPLE)
        assert back.count() == graph.count()
        assert T.graph_diff(back.where("o_kind <> 'bnode' AND s NOT LIKE '\\\\_:%'"), plain).count() == 0
    turtle.write_triples(graph, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("p = 'http://e/name'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_queries(graph):
    pre = "PREFIX ex: <http://e/> "
    assert [tuple(r) for r in sparql(graph, pre + "SELECT ?n ?z WHERE { ?a a ex:Thing ; ex:name ?n . OPTIONAL { ?a ex:none ?z } } ORDER BY ?n").collect()] == [('A "q"\n', None), ("B", None)]
    assert [r[0] for r in sparql(graph, pre + "SELECT ?v { ex:a ex:size ?v } ORDER BY DESC(?v)").collect()] == ["1e3", "12", "1.5"]
    assert [tuple(r) for r in sparql(graph, pre + "SELECT ?b ?r WHERE { ?b ex:has ?x . ?x ex:ref ?a ; ex:rank ?r . ?a ex:ok true . }").collect()] == [("http://e/b", "2")]
    assert sparql(graph, pre + 'SELECT DISTINCT ?a { ?a ex:name ?n . ?a ex:name "B"@en-GB } LIMIT 5').count() == 1
    assert sparql(graph, pre + "SELECT * { ?a ex:rank ?a }").count() == 0
    assert parse_query(pre + "SELECT * { ?a ex:p ?b , 5 }").variables == ["a", "b"]
    for bad in ("SELECT ?a { ?a ?b ?c FILTER(?c > 1) }", "ASK { }", "SELECT ?a { }", "SELECT ?a { ?a x:y ?c }", "SELECT ?a { ?a ?b ?c } GROUP BY ?a"):
        with pytest.raises(SparqlError):
            parse_query(bad)
    with pytest.raises(ValueError, match="share no variable"):
        sparql(graph, pre + "SELECT * { ?a ex:ok ?b . ?c ex:rank ?d }")


def test_set_statistics_and_difference(spark, graph):
    assert T.triple_set(graph, graph).count() == graph.count()
    stats = {r["p"]: (r["n"], r["subjects"]) for r in T.triple_stats(graph).collect()}
    assert stats["http://e/name"] == (4, 3)
    a = spark.createDataFrame([("x", T.DISJOINT, "y", "iri", None, None)], T.TRIPLE)
    b = spark.createDataFrame([("y", T.DISJOINT, "x", "iri", None, None)], T.TRIPLE)
    assert T.graph_diff(a, b).count() == 0 and T.graph_diff(a, graph).where("side = 'left'").count() == 1


def test_constant_rules(spark):
    rules = """@prefix r: <http://r#> . @prefix e: <http://e/> .
    <m1> a r:Map ; r:logicalSource [ r:iterator "/yin:module/yin:container[@name='top']" ] ; r:subjectMap [ r:constant e:Top ] ;
      r:predicateObjectMap [ r:predicate e:is ; r:objectMap [ r:constant "top"@en ] ] , [ r:predicate e:of ; r:objectMap [ r:constant e:All ] ] .
    <m2> r:logicalSource [ r:iterator "/yin:module/yin:container[@name='none']" ] ; r:subjectMap [ r:constant e:No ] ; r:predicateObjectMap [ r:predicate e:is ; r:objectMap [ r:constant e:X ] ] ."""
    table = read_rules(spark.createDataFrame(turtle.parse("@base <http://b/> ." + rules), T.TRIPLE))
    assert table.count() == 3
    mod = yang.parse_modules(spark.createDataFrame([("m.yang", 'module m { prefix m; container top { description "a < b"; } }')], "file string, text string"))
    xml = yin(mod).select("xml")
    assert "<text>a &lt; b</text>" in xml.first()[0]
    assert {(r["s"], r["o"], r["o_lang"]) for r in apply_rules(table, xml).collect()} == {("http://e/Top", "top", "en"), ("http://e/Top", "http://e/All", None)}
    namespaced = spark.createDataFrame([('<y:module xmlns:y="u"><y:container name="none"/></y:module>',)], "xml string")
    assert [r["s"] for r in apply_rules(table, namespaced).collect()] == ["http://e/No"]


def test_command_line(spark, tmp_path, capsys):
    from graphloom.cli import main, output_path

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.yang").write_text("module m { prefix m; container top { leaf a { type string; } } }")
    (tmp_path / "in" / "bad.yang").write_text("module {")
    assert main([str(tmp_path / "in"), str(tmp_path / "out" / "o.ttl"), "--modules", "m.yang", "--html", str(tmp_path / "t.html")]) == 0
    triples = turtle.parse((tmp_path / "out" / "o.ttl").read_text())
    assert ("http://example.org/ontology/m/top", T.TYPE, T.CLASS) in {t[:3] for t in triples}
    assert "top" in (tmp_path / "t.html").read_text()
    (tmp_path / "q.rq").write_text(f"SELECT ?s {{ ?s a <{T.CLASS}> }}")
    assert main(["--query", str(tmp_path / "q.rq"), "--graph", str(tmp_path / "out" / "o.ttl")]) == 0
    assert capsys.readouterr().out.split() == ["s", "http://example.org/ontology/m/top"]
    assert output_path(str(tmp_path)).name == "simap-ontology.ttl"


def test_patterns_on_a_graph_by_predicate_read_their_own_facts(spark, sf):
    from pyspark.sql import functions as F

    from graphloom.operators.bgp import Query, solve
    from graphloom.plans.table_queries import QUERIES

    rows = spark.createDataFrame([(1, "one", "uno"), (2, None, "dos"), (2, None, "dos")], "id int, a string, b string")
    s = F.concat(F.lit("e/"), F.col("id").cast("string"))
    parts = T.merged(T.by_predicate(rows, s, (T.text, "e/a", F.col("a")), (T.number, "e/id", F.col("id"))), T.by_predicate(rows, s, (T.text, "e/a", F.col("b"))))
    whole = T.emit(rows, s, T.text("e/a", F.col("a")), T.number("e/id", F.col("id"))).unionByName(T.emit(rows, s, T.text("e/a", F.col("b"))))
    name, number, any_ = ("?x", "<e/a>", "?n"), ("?x", "<e/id>", "?i"), ("?x", "?p", "?o")
    for query in (Query(["x", "n", "i"], [name, number]), Query(["x", "p", "o"], [any_]), Query(["x", "n"], [name, ("?x", "<e/none>", "?z")]), Query(["x", "z"], [number], [[("?x", "<e/none>", "?z")]])):
        assert sorted(map(str, solve(parts, query).collect())) == sorted(map(str, solve(whole, query).collect()))
    # a pattern plans the tables of its facts, not every table of the graph: eight patterns, two of them on names of parts and suppliers
    plan = QUERIES["bgp_power"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 10 and "Generate" not in plan


def test_source_rows_of_a_large_table_are_dealt_out_before_they_become_triples(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.plans.table_queries import QUERIES

    customers = spark.range(300_000).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", (F.col("id") * 7919) % 1_000_003).alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    customers.coalesce(1).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(str(tmp_path / "customer.parquet"))
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    # one file, one row group: one task reads it all, more than one makes the triples
    rows = spark.read.parquet(str(tmp_path / "customer.parquet"))
    made = T.emit(T.spread(rows), F.col("c_name"), T.text("p", F.col("c_name")), T.number("q", F.col("c_custkey"))).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in made) == 600_000 and max(r[1] for r in made) <= 200_000
    assert T.spread(spark.read.parquet(f"{sf}/nation.parquet")).rdd.getNumPartitions() == 1
    triples = QUERIES["class_triples"](spark, str(tmp_path))
    assert "RepartitionByExpression" in triples._jdf.queryExecution().optimizedPlan().toString()
    assert triples.count() == 3 * (300_000 + 25 + 5)


@pytest.mark.parametrize("name", ["triple_stats", "triple_set", "must_when", "cardinality_default"])
def test_lines_are_dealt_out_before_they_become_triples(spark, name):
    from graphloom.plans.table_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_" in plan
