"""Queries that run the whole compiler on models written out of the tables' rows.

Each region is a YANG module; its nations are lists, identities, enum values and
augments in it. The texts are parsed and compiled once for a session and folder,
and each query is one kind of the compiled triples, for which SQL names the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import triples as T
from ..sources import html, turtle, yang
from .durable import cut
from .mapping import apply_rules, read_rules, yin
from .schema_graph import compile_model
from .sparql import sparql

BASE = "http://e/"
_LIST = (
    " list n%d { key id; description \"%s\"; must \"id > %d\" { error-message \"Low %d\"; } when \"../on = 'n%d'\";"
    " leaf id { type uint8; } leaf kind { type identityref { base tp:kind%d; } } leaf any { type tp:u%d; } leaf node { type instance-identifier; }"
    " leaf level { type w%d; } leaf ref { type leafref { path \"../../tp:n%d/tp:id\"; } } uses g%d { refine tag { mandatory true; } } }"
)
_MODULE = (
    "module r%d { prefix tp; identity kind%d { description \"%s\"; } %s typedef t%d { type enumeration { %s } } typedef w%d { type uint8 { range \"%d..5 | 10..2%d\"; } }"
    " typedef u%d { type union { type identityref { base tp:kind%d; } type string; } }"
    " grouping g%d { description \"Shared by %s.\"; leaf tag { type string; description \"A tag.\"; } leaf-list alias { type string; } anydata extra; uses h%d; }"
    " grouping h%d { leaf depth { type uint8; } }"
    " container top%d { description \"%s\"; %s choice way { %s } } %s rpc run%d; notification done%d; }"
)
_COMPILED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): one module for each region."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    k, g = F.col("n_nationkey"), F.col("n_regionkey")
    one = n.select(
        g.alias("g"), k.alias("k"), F.format_string(" identity n%d { base tp:kind%d; }", k, g).alias("identity"), F.format_string("enum e%d { description \"%s\"; }", k, F.col("n_name")).alias("value"),
        F.format_string(_LIST, k, F.col("n_name"), k, k, k, g, g, g, k, g).alias("list"), F.format_string("case c%d { leaf x%d { type string; } }", k, k).alias("branch"),
        F.format_string(" augment \"/tp:top%d/tp:n%d\" { leaf added { type int32; } }", g, k).alias("augment"),
    )

    def joined(c: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), " ").alias(c)

    # a region's nations: a handful, the model of one module
    parts = one.groupBy("g").agg(*(joined(c) for c in ("identity", "value", "list", "branch", "augment")))
    g, name = F.col("r_regionkey"), F.col("r_name")
    text = F.format_string(_MODULE, g, g, name, F.col("identity"), g, F.col("value"), g, g, g, g, g, g, name, g, g, g, name, F.col("list"), F.col("branch"), F.col("augment"), g, g)
    return r.join(parts, F.col("g") == F.col("r_regionkey")).select(F.format_string("r%d@2024-01-02.yang", g).alias("file"), text.alias("text"))


def compiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(statements, triples) of the models, kept for the session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _COMPILED:
        parsed = cut(yang.parse_modules(model_texts(spark, sf_dir)))
        if not parsed.where(F.col("keyword") == yang.ERROR).isEmpty():
            raise ValueError(parsed.where(F.col("keyword") == yang.ERROR).first()["arg"])
        stmts = cut(yang.load_order(parsed))
        _COMPILED[key] = stmts, cut(compile_model(stmts, BASE))
    return _COMPILED[key]


def _local(c: str):
    return F.regexp_replace(c, f"^{BASE}", "")


def _slice(subject: str, *predicates: str):
    """The triples whose subject (without the base) matches, and their predicates' short names."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = compiled(spark, sf_dir)[1].select(_local("s").alias("s"), F.regexp_extract("p", "[^#/]*$", 0).alias("p"), _local("o").alias("o"))
        return g.where(F.col("s").rlike(f"^(?:{subject})$") & F.col("p").isin(*predicates))

    return query


_N = "(SELECT n_nationkey AS k, n_regionkey AS g, n_name AS name FROM nation) n"
_R = "(SELECT r_regionkey AS g, r_name AS name FROM region) r"
_P = "'r' || g || '/top' || g || '/n' || k"
#: The second expansion of groupings puts every module's nodes under the last module's name.
_LAST = "'r' || (SELECT max(r_regionkey) FROM region) || '/top' || g"
_P2 = _LAST + " || '/n' || k"
_V = "'tp:top' || g || '?container/tp:n' || k || '?list'"


def _sql(*parts: tuple[str, str, str, str]) -> str:
    return " UNION ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {t}" for s, p, o, t in parts)


def _leaf(name: str, *facts: tuple[str, str], parent: str = _P, t: str = _N) -> list[tuple[str, str, str, str]]:
    return [(f"{parent} || '/{name}'", p, o, t) for p, o in facts]


_LEAF = r"r\d+/top\d+/n\d+/"
_KINDS = ("type", "label", "range", "domain", "minCardinality", "comment", "isInstanceIdentifier", "xpathPath")
_OBJ, _DAT = f"'{T.OBJECT_PROPERTY}'", f"'{T.DATATYPE_PROPERTY}'"
_XSD = "'" + T.XSD
QUERIES = {
    "model_containers": _slice(r"r\d+/top\d+", "type", "label", "comment", "wasDerivedFrom"),
    "model_lists": _slice(r"r\d+/top\d+/n\d+", "type", "label", "wasDerivedFrom"),
    "model_must_when": _slice(r"r\d+/top\d+/n\d+", "condition", "message", "deactivated", "comment"),
    "model_regular_leaf": _slice(_LEAF + "(?:id|level)", *_KINDS),
    "model_identityref": _slice(_LEAF + "kind", *_KINDS),
    "model_instance_identifier": _slice(_LEAF + "node", *_KINDS),
    "model_leafref": _slice(_LEAF + "ref", *_KINDS),
    "model_union": _slice(_LEAF + "any|types/Union_any", *_KINDS),
    "model_identities": _slice(r"identity/n\d+", "type", "label", "subClassOf", "wasDerivedFrom"),
    "model_enumeration": _slice(r"types/t\d+(?:/e\d+)?", "type", "label", "comment"),
    "model_groupings": _slice(r"grouping/\w+", "type", "label", "comment"),
    "model_uses_refine": _slice(_LEAF + "(?:tag|alias|extra)", *_KINDS),
    "model_nested_uses": _slice(_LEAF + "depth", *_KINDS),
    "model_disjoint": _slice(r"r\d+/top\d+/c\d+", "disjointWith"),
    "model_augments": _slice(r"tp:top\d+/tp:n\d+(?:/added)?", *_KINDS, "wasDerivedFrom"),
    "model_containment": _slice(r"r\d+/top\d+/hasN\d+", *_KINDS, "wasDerivedFrom"),
    "model_operations": _slice(r"(?:rpc|notification)/\w+", "type", "label"),
    "model_shapes": _slice(r"w\d+", "type", "label", "datatype", "minInclusive", "maxInclusive"),
}
ORACLE_SQL = {
    "model_containers": _sql(*(("'r' || g || '/top' || g", p, o, _R) for p, o in (("type", f"'{T.CLASS}'"), ("label", "'top' || g"), ("comment", "name"), ("wasDerivedFrom", "'tp:top' || g || '?container'"))),
        *((_LAST, p, o, _R) for p, o in (("type", f"'{T.CLASS}'"), ("comment", "name"), ("wasDerivedFrom", "'tp:top' || g || '?container'")))),
    "model_lists": _sql(*((_P, p, o, _N) for p, o in (("type", f"'{T.CLASS}'"), ("label", "'n' || k"), ("wasDerivedFrom", _V)))),
    "model_must_when": _sql(*((_P, p, o, _N) for p, o in (
        ("condition", "'id > ' || k"), ("message", "'Low ' || k"), ("deactivated", "'../on = ''n' || k || ''''"), ("comment", "'Conditional: exists when ../on = ''n' || k || ''''"), ("comment", "name")))),
    "model_regular_leaf": _sql(*(x for leaf in ("id", "level") for x in _leaf(leaf, ("type", _DAT), ("label", f"'{leaf}'"), ("range", _XSD + "unsignedByte'"), ("domain", _P)))),
    "model_identityref": _sql(*_leaf("kind", ("type", _OBJ), ("label", "'kind'"), ("range", "'identity/kind' || g"), ("domain", _P), ("minCardinality", "'0'"))),
    "model_instance_identifier": _sql(*_leaf("node", ("type", _OBJ), ("label", "'node'"), ("isInstanceIdentifier", "'true'"), ("comment", "'A semantic pointer to a specific data node instance.'"), ("domain", _P), ("minCardinality", "'0'"))),
    "model_leafref": _sql(*_leaf("ref", ("type", _OBJ), ("range", _P), ("domain", _P), ("xpathPath", "'../../tp:n' || k || '/tp:id'"), ("minCardinality", "'0'"))),
    "model_union": _sql(*_leaf("any", ("type", _OBJ), ("range", "'types/Union_any'"), ("domain", _P), ("minCardinality", "'0'")), ("'types/Union_any'", "type", f"'{T.CLASS}'", _R), ("'types/Union_any'", "label", "'Union Parent: any'", _R)),
    "model_identities": _sql(*(("'identity/n' || k", p, o, _N) for p, o in (("type", f"'{T.CLASS}'"), ("type", f"'{T.INDIVIDUAL}'"), ("label", "'n' || k"), ("subClassOf", "'identity/kind' || g"), ("wasDerivedFrom", "'tp:n' || k || '?identity'")))),
    "model_enumeration": _sql(("'types/t' || g", "type", f"'{T.CLASS}'", _R), ("'types/t' || g", "label", "'t' || g", _R),
        *(("'types/t' || g || '/e' || k", p, o, _N) for p, o in (("type", f"'{T.INDIVIDUAL}'"), ("type", "'types/t' || g"), ("label", "'e' || k"), ("comment", "name")))),
    "model_groupings": _sql(*(("'grouping/' || x || g", p, o, "(SELECT * FROM " + _R + ", (VALUES ('g'), ('h')) v(x)) w") for p, o in (("type", f"'{T.CLASS}'"), ("label", "x || g"), ("comment", "'Grouping definition: ' || x || g"))),
        ("'grouping/g' || g", "comment", "'Shared by ' || name || '.'", _R)),
    "model_uses_refine": _sql(*(x for at in (_P, _P2) for leaf in ("tag", "alias", "extra") for x in _leaf(leaf, ("type", _DAT), ("label", f"'{leaf}'"), ("range", _XSD + "string'"), ("domain", at), parent=at)),
        *(x for at in (_P, _P2) for x in [*_leaf("tag", ("comment", "'A tag.'"), ("minCardinality", "'1'"), parent=at), *_leaf("extra", ("comment", "'Anydata: Arbitrary structure extension point'"), parent=at)])),
    "model_nested_uses": _sql(*(x for at in (_P, _P2) for x in _leaf("depth", ("type", _DAT), ("label", "'depth'"), ("range", _XSD + "string'"), ("domain", at), parent=at))),
    "model_disjoint": f"SELECT least(x, y) AS s, 'disjointWith' AS p, greatest(x, y) AS o FROM (SELECT 'r' || a.g || '/top' || a.g || '/c' || a.k AS x, 'r' || a.g || '/top' || a.g || '/c' || b.k AS y FROM {_N[:-2]} a JOIN {_N[:-2]} b ON a.g = b.g AND a.k < b.k)",
    "model_augments": _sql(("'tp:top' || g || '/tp:n' || k", "type", f"'{T.CLASS}'", _N), *(("'tp:top' || g || '/tp:n' || k || '/added'", p, o, _N) for p, o in (
        ("type", _DAT), ("label", "'added'"), ("range", _XSD + "int'"), ("domain", "'tp:top' || g || '/tp:n' || k"), ("wasDerivedFrom", "'tp:added?leaf'")))),
    "model_containment": _sql(*(("'r' || g || '/top' || g || '/hasN' || k", p, o, _N) for p, o in (
        ("type", _OBJ), ("label", "'hasN' || k"), ("domain", "'r' || g || '/top' || g"), ("range", _P), ("comment", "'Containment relation (parent --> child).'"), ("minCardinality", "'0'"), ("wasDerivedFrom", "'tp:top' || g || '?container/hasN' || k")))),
    "model_operations": _sql(*(("y || '/' || x || g", p, o, "(SELECT * FROM " + _R + ", (VALUES ('rpc', 'run'), ('notification', 'done')) v(y, x)) w") for p, o in (("type", f"'{T.CLASS}'"), ("label", "x || g")))),
    "model_shapes": _sql(*(("'w' || g", p, o, _R) for p, o in (("type", f"'{T.SH}NodeShape'"), ("label", "'w' || g"), ("datatype", _XSD + "unsignedByte'"), ("minInclusive", "CAST(g AS VARCHAR)"), ("maxInclusive", "'2' || g")))),
}


def model_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each keyword in each module, as the parser reads them."""
    stmts = compiled(spark, sf_dir)[0]
    return stmts.where(F.col("keyword").isin("module", "list", "enum", "augment", "case", "refine")).groupBy("file", "module", "prefix", "walk_seq", "keyword").agg(F.count(F.lit(1)).alias("n"))


def model_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in each module's HTML tree, and what it says of the module's container."""
    page = html.html_tree(compiled(spark, sf_dir)[0])
    return page.select("file", (F.size(F.split("html", "<li class='list'>")) - 1).alias("lists"), F.regexp_extract("html", r"<span class='arg'>top\d+</span><span class=\"desc\">\"([^\"]*)\"</span>", 1).alias("top"))


def turtle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle text for each region, read and asked in SPARQL: a star, a chain, an optional part, an order."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    facts = n.select("n_regionkey", F.format_string("e:n%d a e:Nation ; e:name \"%s\" ; e:key %d ; e:in e:r%d .", F.col("n_nationkey"), F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey")).alias("t"))
    facts = facts.unionByName(r.where("r_regionkey > 1").select(F.col("r_regionkey").alias("n_regionkey"), F.format_string("e:r%d e:label \"%s\" .", F.col("r_regionkey"), F.col("r_name")).alias("t")))
    docs = facts.groupBy("n_regionkey").agg(F.concat(F.lit("@prefix e: <http://e/> .\n"), F.array_join(F.collect_list("t"), "\n")).alias("text"))
    graph = turtle.parse_documents(docs.select(F.format_string("r%d.ttl", F.col("n_regionkey")).alias("file"), "text"))
    return sparql(graph, "PREFIX e: <http://e/> SELECT ?name ?key ?region WHERE { ?n a e:Nation ; e:name ?name ; e:key ?key ; e:in ?r . OPTIONAL { ?r e:label ?region } } ORDER BY DESC(?key)")


def rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant rules read from their Turtle and applied to the models' XML form: a rule for each region's last nation number."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    rule = "<http://e/m%d> l:logicalSource [ l:iterator \"/yin:module/yin:container/yin:list[@name='n%d']\" ] ; l:subjectMap [ l:constant e:R%d ] ; l:predicateObjectMap [ l:predicate e:is ; l:objectMap [ l:constant \"%s\" ] ] ."
    texts = r.select(F.format_string("m%d.ttl", F.col("r_regionkey")).alias("file"), F.concat(F.lit("@prefix l: <http://l#> . @prefix e: <http://e/> .\n"), F.format_string(rule, *[F.col("r_regionkey"), F.col("r_regionkey") * 10, F.col("r_regionkey"), F.col("r_name")])).alias("text"))
    xml = yin(compiled(spark, sf_dir)[0]).select("xml")
    return apply_rules(cut(read_rules(turtle.parse_documents(texts))), xml).select("s", "p", "o")


QUERIES |= {"model_statements": model_statements, "model_html": model_html, "turtle_query": turtle_query, "rule_query": rule_query}
ORACLE_SQL |= {
    "model_statements": "SELECT 'r' || g || '@2024-01-02.yang' AS file, 'r' || g AS module, 'tp' AS prefix, CAST(g + 1 AS INTEGER) AS walk_seq, kw AS keyword, CASE kw WHEN 'module' THEN 1 ELSE n END AS n"
    f" FROM (SELECT g, count(*) AS n FROM {_N} GROUP BY g) a, (VALUES ('module'), ('list'), ('enum'), ('augment'), ('case'), ('refine')) v(kw)",
    "model_html": f"SELECT 'r' || r.g || '@2024-01-02.yang' AS file, CAST(count(*) AS INTEGER) AS lists, r.name || '...' AS top FROM {_R} JOIN {_N} ON r.g = n.g GROUP BY r.g, r.name",
    "turtle_query": "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN r_regionkey > 1 THEN r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_nationkey DESC",
    "rule_query": "SELECT 'http://e/R' || r_regionkey AS s, 'http://e/is' AS p, r_name AS o FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 10 * r_regionkey)",
}
