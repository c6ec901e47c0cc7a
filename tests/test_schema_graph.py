import pytest

from graphloom.operators import triples as T
from graphloom.plans.schema_graph import SchemaGraph, compile_model
from graphloom.sources import html, yang

EX = "http://example.org/ontology/"

TYPES = """module b-types { prefix bt; namespace "urn:b";
  typedef percent { type uint8 { range "0..50 | 60..100"; } }
  typedef label { type string { length "1..8|10..12"; pattern "[a-z]*"; pattern '\\d+'; } }
  typedef mode { type enumeration { enum fast { description "Quick."; } enum slow; } }
  typedef either { type union { type identityref { base bt:thing; } type string; } }
  identity thing { description "Any thing."; }
  identity part { base bt:thing; }
  grouping common { description "Shared leaves.";
    leaf tag { type bt:label; description "A tag."; }
    leaf-list alias { type string; }
    anydata extra;
    container inner { leaf n { type percent; } }
    uses deep;
  }
  grouping deep { leaf depth { type uint8; } choice c { case one { leaf x { type string; } } container two; } }
}"""
MAIN = """module m-main { prefix mm; namespace "urn:m"; import b-types { prefix bt; }
  // a comment
  container top { description "The " + "top
                   of all."; /* more */
    when "a = 'b'";
    list item { key id;
      leaf id { type string; must "count(.) > 1" { error-message "Too few"; } }
      leaf kind { type identityref { base "bt:thing"; } }
      leaf ref { type leafref { path "../../mm:item/mm:id"; } }
      leaf far { type leafref { path "/mm:top/mm:item/mm:id"; } }
      leaf any { type bt:either; }
      leaf node { type instance-identifier; }
      leaf level { type percent; }
      uses bt:common { refine tag { mandatory true; } }
    }
    choice way { case a { leaf p { type string; } } list b { key k; } container c; leaf d { type string; } }
  }
  leaf alone { type boolean; }
  augment "/mm:top/mm:item" { leaf added { type int32; } container box { leaf w { type int64; } } }
  rpc run; notification done { leaf t { type string; } }
  container apart { uses nowhere; uses deep-local; }
  grouping deep-local { leaf q { type string; } }
}"""


@pytest.fixture(scope="module")
def stmts(spark):
    files = spark.createDataFrame([("m-main@2024-01-02.yang", MAIN), ("b-types.yang", TYPES), ("bad.yang", "module x {")], "file string, text string")
    parsed = yang.parse_modules(files).cache()
    assert [r["file"] for r in parsed.where("keyword = '!error'").collect()] == ["bad.yang"]
    return yang.load_order(parsed.where("keyword <> '!error'"), "m-main@2024-01-02.yang").cache()


@pytest.fixture(scope="module")
def graph(stmts):
    return {(r["s"].removeprefix(EX), r["p"], r["o"].removeprefix(EX)) for r in compile_model(stmts).collect()}


def of(graph, s):
    return {(p.split("#")[-1], o.split("#")[-1]) for a, p, o in graph if a == s}


def test_parser_rows():
    got = yang.parse('module m { a "x\\n\\"y"; b \'z\\n\' + "q"; c { d e//f;\n /* ; */ ; } }')
    assert [(r[3], r[4], r[5]) for r in got] == [(0, "module", "m"), (1, "a", 'x\n"y'), (1, "b", "z\\nq"), (1, "c", None), (2, "d", "e")]
    assert yang.parse('module m {\n  d "one\n      two  \n   three";\n}')[1][5] == "one\n two\nthree"
    for bad in ("", "module m {", "module m { a b c; }", "module m { } }", "leaf x;", 'module m { a "b; }', "module m { a + 'b'; }"):
        with pytest.raises(ValueError):
            yang.parse(bad)


def test_containers_and_leaves(graph):
    item = "m-main/top/item"
    assert of(graph, "m-main/top") == {("type", "Class"), ("label", "top"), ("comment", "The top\nof all."), ("wasDerivedFrom", "mm:top?container"), ("deactivated", "a = 'b'"), ("comment", "Conditional: exists when a = 'b'")} | {x for x in of(graph, "m-main/top") if x[0] == "disjointWith"}
    assert of(graph, item + "/id") == {("type", "DatatypeProperty"), ("label", "id"), ("range", "string"), ("domain", item), ("wasDerivedFrom", "mm:top?container/mm:item?list/mm:id?leaf"), ("condition", "count(.) > 1"), ("message", "Too few")}
    assert of(graph, item + "/kind") == {("type", "ObjectProperty"), ("label", "kind"), ("range", "identity/thing"), ("domain", item), ("minCardinality", "0"), ("wasDerivedFrom", "mm:top?container/mm:item?list/mm:kind?leaf")}
    assert {x for x in of(graph, item + "/ref") if x[0] in ("range", "domain", "label")} == {("range", item), ("domain", item)}
    assert of(graph, item + "/far") == {("type", "ObjectProperty"), ("minCardinality", "0"), ("wasDerivedFrom", "mm:top?container/mm:item?list/mm:far?leaf")}
    assert ("range", "types/Union_any") in of(graph, item + "/any") and ("subClassOf", "types/Union_any") in of(graph, "identity/thing")
    assert of(graph, item + "/node") >= {("type", "ObjectProperty"), (EX + "isInstanceIdentifier", "true")}
    assert ("range", "unsignedByte") in of(graph, item + "/level") and of(graph, "m-main/alone") >= {("range", "boolean")}
    assert not any(x[0] == "domain" for x in of(graph, "m-main/alone"))


def test_groupings(graph):
    item = "m-main/top/item"
    assert of(graph, item + "/tag") == {("type", "DatatypeProperty"), ("label", "tag"), ("range", "string"), ("domain", item), ("comment", "A tag."), ("minCardinality", "1")}
    assert ("comment", "Anydata: Arbitrary structure extension point") in of(graph, item + "/extra") and of(graph, item + "/alias") and of(graph, item + "/depth")
    assert ("wasDerivedFrom", "mm:top?container/mm:item?list/bt:inner?container") in of(graph, item + "/inner")
    assert ("range", "unsignedByte") in of(graph, item + "/inner/n")
    assert of(graph, "grouping/common") == {("type", "Class"), ("label", "common"), ("comment", "Grouping definition: common"), ("comment", "Shared leaves.")}
    assert of(graph, "m-main/apart/q") >= {("domain", "m-main/apart")}
    assert (item + "/one", T.DISJOINT, item + "/two") in graph or (item + "/two", T.DISJOINT, item + "/one") in graph
    pairs = {frozenset((a, o)) for a, p, o in graph if p == T.DISJOINT and a.startswith("m-main/top/") and "item" not in a}
    assert pairs == {frozenset((f"m-main/top/{a}", f"m-main/top/{b}")) for a, b in ("ab", "ac", "bc")}


def test_augments_containment_and_the_rest(graph):
    assert of(graph, "mm:top/mm:item") == {("type", "Class")}
    assert ("range", "int") in of(graph, "mm:top/mm:item/added") and ("wasDerivedFrom", "mm:added?leaf") in of(graph, "mm:top/mm:item/added")
    assert of(graph, "m-main/top/hasItem") == {("type", "ObjectProperty"), ("label", "hasItem"), ("domain", "m-main/top"), ("range", "m-main/top/item"), ("comment", "Containment relation (parent --> child)."), ("minCardinality", "0"), ("wasDerivedFrom", "mm:top?container/hasItem")}
    assert of(graph, "identity/part") == {("type", "Class"), ("type", "NamedIndividual"), ("label", "part"), ("wasDerivedFrom", "bt:part?identity"), ("subClassOf", "identity/thing")}
    assert of(graph, "types/mode/fast") == {("type", "NamedIndividual"), ("type", "types/mode"), ("label", "fast"), ("comment", "Quick.")}
    assert of(graph, "percent") == {("type", "NodeShape"), ("label", "percent"), ("datatype", "unsignedByte"), ("minInclusive", "0"), ("maxInclusive", "100")}
    assert of(graph, "label") == {("type", "NodeShape"), ("label", "label"), ("datatype", "string"), ("pattern", "[a-z]*"), ("pattern", "\\d+"), ("minLength", "1"), ("maxLength", "12")}
    assert not of(graph, "mode") and not of(graph, "either")
    assert of(graph, "rpc/run") == {("type", "Class"), ("label", "run")} and of(graph, "notification/done") == {("type", "Class"), ("label", "done")}


def test_circular_groupings_fail(spark, monkeypatch):
    import graphloom.plans.schema_graph as sg

    monkeypatch.setattr(sg, "DEPTH", 5)
    text = "module c { prefix c; grouping g { uses g; } container top { uses g; } }"
    with pytest.raises(RecursionError):
        SchemaGraph(yang.load_order(yang.parse_modules(spark.createDataFrame([("c.yang", text)], "file string, text string"))))


def test_html(stmts):
    page = html.html_page(stmts)
    assert page.count("<div class='module-box'>") == 2
    assert "<li class='leaf'><span class='keyword'>leaf</span><span class='arg'>id</span><span class=\"type\">(string)</span></li>" in page
    assert '<span class="desc">"The top..."</span>' in page and "error-message" not in page
