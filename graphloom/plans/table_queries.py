"""The engine's operators bound to relational tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import registry as R
from ..operators import triples as T
from ..operators import types as Y
from ..operators.bgp import Query, solve

EX = "ex/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _iri(table: str, key: str):
    return F.concat(F.lit(f"{EX}{table}/"), F.col(key).cast("string"))


# --- sources ----------------------------------------------------------------


@_query("SELECT file, CAST(row_number() OVER (ORDER BY file) AS INTEGER) AS walk_seq FROM (SELECT DISTINCT source AS file FROM documents)")
def scan_modules(spark, sf_dir):
    """Distinct file names, ranked. A source name is a bounded vocabulary, so one window orders it."""
    from pyspark.sql.window import Window

    files = _t(spark, sf_dir, "documents").select(F.col("source").alias("file")).distinct()
    return files.select("file", F.row_number().over(Window.orderBy("file")).alias("walk_seq"))


@_query(r"""
SELECT file, regexp_replace(regexp_replace(regexp_replace(file, '\.yang', '', 'g'), '@.*$', ''), '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '') AS module
FROM (SELECT DISTINCT event_type || '@' || strftime(ts, '%Y-%m-%d') || '.yang' AS file FROM events
      UNION SELECT DISTINCT event_type || '-' || strftime(ts, '%Y-%m-%d') || '.yang' FROM events)""")
def module_name(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct()
    files = e.select(F.explode(F.array(*(F.concat("event_type", F.lit(c), "d", F.lit(".yang")) for c in "@-"))).alias("file"))
    return files.distinct().select("file", N.module_name(F.col("file")).alias("module"))


@_query(r"""
WITH c AS (
  SELECT page_id, url, '/' || regexp_replace(replace(replace(replace(regexp_replace(url, '/+', '/', 'g'), 'nw:', ''), 'nt:', ''), 'st:', ''), '^/+', '') AS p FROM pages)
SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '/'
  WHEN replace(p, '/', '') = '' OR regexp_extract(p, '^/+([^/]+)', 1) IN ('https:', 'ietf-network', 'ietf-network-topology', 'ietf-simap-topology') THEN p
  ELSE '/https:' || p END AS path FROM c""")
def normalize_path(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", N.normalize_path(F.col("url"), F.lit("https:")).alias("path"))


@_query(r"""
SELECT o_orderkey, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
  'current()/../../nw:order[nw:id=' || o_orderkey || ']//nw:' || lower(o_orderstatus) || '/ietf-x:key/', '\w+:', '', 'g'), '\[.*?\]', '', 'g'), 'current()', ''), '/+', '/', 'g'), '^/+|/+$', '', 'g') AS xpath FROM orders""")
def xpath_clean(spark, sf_dir):
    raw = F.concat(F.lit("current()/../../nw:order[nw:id="), F.col("o_orderkey").cast("string"), F.lit("]//nw:"), F.lower("o_orderstatus"), F.lit("/ietf-x:key/"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", N.xpath_clean(raw).alias("xpath"))


# --- triples ----------------------------------------------------------------


@_query("SELECT DISTINCT 'ex/order/' || l_orderkey AS s, 'ex/hasPart' AS p, 'ex/part/' || l_partkey AS o FROM lineitem")
def triple_set(spark, sf_dir):
    li = T.spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    g = T.emit(li, _iri("order", "l_orderkey"), T.iri(EX + "hasPart", _iri("part", "l_partkey")))
    return T.triple_set(g, g).select("s", "p", "o")


def _place_triples(spark, sf_dir):
    r, n, c = (_t(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    c = T.spread(c.select("c_nationkey", "c_name"))
    top = r.select(F.concat(F.lit("regions/"), "r_name").alias("path"), F.col("r_name").alias("name"), F.concat(F.lit("tp:"), "r_name", F.lit("?container")).alias("prov"))
    mid = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("regions/"), "r_name", F.lit("/"), "n_name").alias("path"), F.col("n_name").alias("name"),
        F.concat(F.lit("tp:"), "r_name", F.lit("?container/tp:"), "n_name", F.lit("?list")).alias("prov"))
    low = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("regions/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_name").alias("path"), F.col("c_name").alias("name"),
        F.concat(F.lit("tp:"), "r_name", F.lit("?container/tp:"), "n_name", F.lit("?list/tp:"), "c_name", F.lit("?list")).alias("prov"))
    return top.unionByName(mid).unionByName(low)


_PLACES = """
WITH places AS (
  SELECT 'regions/' || r_name AS path, r_name AS name, 'tp:' || r_name || '?container' AS prov FROM region
  UNION ALL SELECT 'regions/' || r_name || '/' || n_name, n_name, 'tp:' || r_name || '?container/tp:' || n_name || '?list' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'regions/' || r_name || '/' || n_name || '/' || c_name, c_name, 'tp:' || r_name || '?container/tp:' || n_name || '?list/tp:' || c_name || '?list'
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@_query(_PLACES + f"""
SELECT DISTINCT * FROM (
  SELECT 'ex/' || path AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM places
  UNION ALL SELECT 'ex/' || path, '{T.LABEL}', name FROM places
  UNION ALL SELECT 'ex/' || path, '{T.DERIVED}', prov FROM places)""")
def class_triples(spark, sf_dir):
    p = _place_triples(spark, sf_dir)
    return T.triple_set(T.emit(p, F.concat(F.lit(EX), "path"), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("name")), T.text(T.DERIVED, F.col("prov")))).select("s", "p", "o")


@_query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'rpc/' WHEN 'view' THEN 'notification/' WHEN 'purchase' THEN 'identity/' ELSE 'grouping/' END || user_id AS iri,
  CASE event_type WHEN 'click' THEN 'rpc' WHEN 'view' THEN 'notification' WHEN 'purchase' THEN 'identity' ELSE 'grouping' END AS kind FROM events WHERE event_type IS NOT NULL""")
def stmt_dispatch(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "rpc").when(F.col("event_type") == "view", "notification").when(F.col("event_type") == "purchase", "identity").otherwise("grouping")
    return _t(spark, sf_dir, "events").where("event_type IS NOT NULL").select("event_id", F.concat(kind, F.lit("/"), F.col("user_id").cast("string")).alias("iri"), kind.alias("kind"))


@_query("""
SELECT s, k AS kind, CASE WHEN k IS NULL THEN NULL WHEN k = 'regular' THEN 'DatatypeProperty' ELSE 'ObjectProperty' END AS property FROM (
  SELECT 'ex/part/' || p_partkey AS s, CASE WHEN p_size <= 10 THEN 'identityref' WHEN p_size <= 20 THEN 'leafref' WHEN p_brand < 'Brand#3' THEN 'union'
    WHEN p_size <= 30 THEN 'instance-identifier' WHEN p_size <= 45 THEN 'regular' END AS k FROM part)""")
def leaf_dispatch(spark, sf_dir):
    """Each part is a leaf: its size says which type, its brand whether that is a union."""
    size = F.col("p_size")
    kinds = F.when(size <= 10, "identityref").when(size <= 20, "leafref").when(size <= 30, "instance-identifier").when(size <= 45, "string")
    kind = Y.leaf_kind(kinds, F.col("p_brand") < "Brand#3")
    return _t(spark, sf_dir, "part").select(_iri("part", "p_partkey").alias("s"), kind.alias("kind"), F.when(kind == "regular", "DatatypeProperty").when(kind.isNotNull(), "ObjectProperty").alias("property"))


@_query("""
WITH RECURSIVE defs AS (
  SELECT p_type AS name, max(CASE WHEN p_size > 40 THEN 'uint16' ELSE 'string' END) AS base FROM part GROUP BY p_type
  UNION ALL SELECT DISTINCT p_brand, max(p_type) FROM part GROUP BY p_brand),
builtin(name, iri) AS (VALUES """ + ", ".join(f"('{k}','{v}')" for k, v in Y.BUILTIN.items()) + f"""),
walk(p_partkey, t, hops) AS (
  SELECT p_partkey, p_brand, 0 FROM part
  UNION ALL SELECT p_partkey, defs.base, hops + 1 FROM walk JOIN defs ON defs.name = walk.t)
SELECT p_partkey, coalesce(max(iri), '{T.XSD}string') AS resolved FROM walk LEFT JOIN builtin ON builtin.name = walk.t GROUP BY p_partkey""")
def type_resolve(spark, sf_dir):
    """Chains brand -> type -> built-in; the definitions are a bounded vocabulary beside the parts."""
    p = _t(spark, sf_dir, "part")
    defs = p.groupBy(F.col("p_type").alias("name")).agg(F.max(F.when(F.col("p_size") > 40, "uint16").otherwise("string")).alias("base_type")).unionByName(
        p.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_type").alias("base_type"))
    )
    # each distinct name is resolved once, then joined to its parts
    kinds = Y.resolve_types(p.select("p_brand").distinct(), defs, "p_brand", ["p_brand"])
    return p.join(kinds, "p_brand").select("p_partkey", "resolved")


@_query("""
WITH reg AS (SELECT DISTINCT '/' || array_to_string(list_slice(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> ''), 1, 2), '/') AS path FROM pages),
tried AS (
  SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS n
  FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages)),
hit AS (SELECT page_id, n, path FROM tried JOIN reg ON '/' || array_to_string(list_slice(parts, 1, n), '/') = path)
SELECT page_id, arg_max(path, n) AS path FROM hit GROUP BY page_id""")
def leafref_resolve(spark, sf_dir):
    """The longest registered prefix of each URL's parts; every page registers its first two."""
    parts = F.filter(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), lambda x: x != "")
    p = _t(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    reg = p.select(F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, 2), "/")).alias("path")).distinct()
    return R.longest_prefix(p.where("parts IS NOT NULL"), reg, "parts", ["page_id"])


@_query(f"""
SELECT DISTINCT 'ex/identity/' || p_brand AS s, '{T.SUBCLASS}' AS p, 'ex/types/Union_' || replace(p_type, ' ', '_') AS o FROM part
UNION SELECT DISTINCT 'ex/types/Union_' || replace(p_type, ' ', '_'), '{T.LABEL}', 'Union Parent: ' || p_type FROM part""")
def union_parent(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    u = F.concat(F.lit(EX + "types/Union_"), F.replace("p_type", F.lit(" "), F.lit("_")))
    return T.triple_set(T.emit(p, u, T.iri(T.SUBCLASS, u, s=_iri("identity", "p_brand")), T.text(T.LABEL, F.concat(F.lit("Union Parent: "), "p_type")))).select("s", "p", "o")


@_query("""
WITH m AS (SELECT DISTINCT p_size, 'ex/case/' || p_type AS c FROM part)
SELECT a.p_size, a.c AS a, b.c AS b FROM m a JOIN m b ON a.p_size = b.p_size AND a.c < b.c""")
def choice_disjoint(spark, sf_dir):
    m = _t(spark, sf_dir, "part").select("p_size", _iri("case", "p_type").alias("c"))
    return R.disjoint_pairs(m, "p_size", "c")


@_query(f"""
WITH t AS (SELECT DISTINCT p_brand AS name, p_type AS base FROM part UNION SELECT DISTINCT p_type, 'item' FROM part)
SELECT DISTINCT * FROM (
  SELECT 'ex/identity/' || name AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM t
  UNION ALL SELECT 'ex/identity/' || name, '{T.TYPE}', '{T.INDIVIDUAL}' FROM t
  UNION ALL SELECT 'ex/identity/' || name, '{T.LABEL}', name FROM t
  UNION ALL SELECT 'ex/identity/' || name, '{T.SUBCLASS}', 'ex/identity/' || base FROM t)""")
def identity_triples(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    t = p.select(F.col("p_brand").alias("name"), F.col("p_type").alias("base")).unionByName(p.select(F.col("p_type").alias("name"), F.lit("item").alias("base"))).distinct()
    return T.triple_set(T.emit(t, _iri("identity", "name"), T.iri(T.TYPE, T.CLASS), T.iri(T.TYPE, T.INDIVIDUAL), T.text(T.LABEL, F.col("name")), T.iri(T.SUBCLASS, _iri("identity", "base")))).select("s", "p", "o")


@_query("""
WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'world' FROM region),
up(node, ancestor, depth) AS (SELECT c, p, 1 FROM e UNION ALL SELECT up.node, e.p, depth + 1 FROM up JOIN e ON up.ancestor = e.c)
SELECT node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY node, ancestor""")
def identity_closure(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    e = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("child"), F.lit("world").alias("parent")))
    return R.closure(e)


@_query(f"""
WITH v AS (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority <> '')
SELECT 'ex/types/priority' AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o
UNION SELECT 'ex/types/priority/' || v, '{T.TYPE}', '{T.INDIVIDUAL}' FROM v
UNION SELECT 'ex/types/priority/' || v, '{T.TYPE}', 'ex/types/priority' FROM v
UNION SELECT 'ex/types/priority/' || v, '{T.LABEL}', v FROM v""")
def enum_individuals(spark, sf_dir):
    v = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v")).where("v <> ''").distinct()
    kind = EX + "types/priority"
    one = T.emit(v, F.concat(F.lit(kind + "/"), "v"), T.iri(T.TYPE, T.INDIVIDUAL), T.iri(T.TYPE, kind), T.text(T.LABEL, F.col("v")))
    return T.triple_set(one, T.emit(spark.range(1), F.lit(kind), T.iri(T.TYPE, T.CLASS))).select("s", "p", "o")


@_query(f"""
SELECT 'ex/grouping/' || r_name AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM region
UNION SELECT 'ex/grouping/' || r_name, '{T.LABEL}', r_name FROM region
UNION SELECT 'ex/grouping/' || r_name, '{T.COMMENT}', 'Grouping definition: ' || r_name FROM region""")
def grouping_class(spark, sf_dir):
    r = _t(spark, sf_dir, "region")
    return T.triple_set(T.emit(r, _iri("grouping", "r_name"), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("r_name")), T.text(T.COMMENT, F.concat(F.lit("Grouping definition: "), "r_name")))).select("s", "p", "o")


_MEMBERS = [("common", "id", "leaf"), ("common", "label", "leaf"), ("common", "geo", "uses"), ("geo", "lat", "leaf"), ("geo", "lon", "leaf"), ("geo", "extra", "uses"), ("extra", "note", "anydata"), ("extra", "tags", "leaf-list")]
_MEMBERS_SQL = "members(g, m, k) AS (VALUES " + ", ".join(f"('{g}','{m}','{k}')" for g, m, k in _MEMBERS) + ")"


def _expanded(spark, uses: DataFrame) -> DataFrame:
    """(path, member, kind) for each use site and each leaf of its grouping, nested uses followed."""
    members = F.broadcast(spark.createDataFrame(_MEMBERS, "g string, m string, k string"))
    out, level = None, uses
    # no chain of nested uses is longer than the number of groupings; a circle would be
    for _ in range(len({g for g, _, _ in _MEMBERS})):
        step = level.join(members, F.col("grouping") == F.col("g"))
        leaves = step.where("k <> 'uses'").select("path", F.col("m").alias("member"), F.col("k").alias("kind"))
        out = leaves if out is None else out.unionByName(leaves)
        level = step.where("k = 'uses'").select("path", F.col("m").alias("grouping"))
    return out


@_query(f"""
WITH {_MEMBERS_SQL}
SELECT DISTINCT 'ex/nation/' || n_nationkey || '/' || m AS s, '{T.RANGE}' AS p, '{T.XSD}string' AS o FROM nation CROSS JOIN members WHERE g = 'common' AND k <> 'uses'""")
def grouping_expand(spark, sf_dir):
    members = F.broadcast(spark.createDataFrame(_MEMBERS, "g string, m string, k string"))
    site = _t(spark, sf_dir, "nation").select(_iri("nation", "n_nationkey").alias("path"), F.lit("common").alias("u"))
    rows = site.join(members, F.col("u") == F.col("g")).where("k <> 'uses'")
    return T.triple_set(T.emit(rows, F.concat_ws("/", "path", "m"), T.iri(T.RANGE, T.XSD + "string"))).select("s", "p", "o")


_NESTED = f"""
WITH RECURSIVE {_MEMBERS_SQL},
x(path, g, hops) AS (SELECT 'ex/nation/' || n_nationkey, 'common', 0 FROM nation UNION ALL SELECT path, m, hops + 1 FROM x JOIN members USING (g) WHERE k = 'uses')
"""


@_query(_NESTED + "SELECT path || '/' || m AS path, k AS kind FROM x JOIN members USING (g) WHERE k <> 'uses'")
def grouping_nested(spark, sf_dir):
    site = _t(spark, sf_dir, "nation").select(_iri("nation", "n_nationkey").alias("path"), F.lit("common").alias("grouping"))
    return _expanded(spark, site).select(F.concat_ws("/", "path", "member").alias("path"), "kind")


@_query(f"""
WITH {_MEMBERS_SQL}, refine(m, mandatory) AS (VALUES ('id', 'true'), ('label', 'false'))
SELECT 'ex/nation/' || n_nationkey || '/' || members.m AS s, CASE WHEN mandatory = 'true' THEN 1 ELSE 0 END AS min_cardinality
FROM nation CROSS JOIN members LEFT JOIN refine ON refine.m = members.m WHERE g = 'common' AND k <> 'uses'""")
def refine_mandatory(spark, sf_dir):
    refine = F.broadcast(spark.createDataFrame([("id", "true"), ("label", "false")], "rm string, mandatory string"))
    members = F.broadcast(spark.createDataFrame(_MEMBERS, "g string, m string, k string"))
    site = _t(spark, sf_dir, "nation").select(_iri("nation", "n_nationkey").alias("path"), F.lit("common").alias("u"))
    rows = site.join(members, F.col("u") == F.col("g")).where("k <> 'uses'").join(refine, F.col("m") == F.col("rm"), "left")
    return rows.select(F.concat_ws("/", "path", "m").alias("s"), F.when(F.col("mandatory") == "true", 1).otherwise(0).alias("min_cardinality"))


@_query(f"""
WITH RECURSIVE {_MEMBERS_SQL},
x(path, g, hops) AS (SELECT (SELECT max(r_name) FROM region) || '/nation/' || n_nationkey, 'common', 0 FROM nation UNION ALL SELECT path, m, hops + 1 FROM x JOIN members USING (g) WHERE k = 'uses')
SELECT DISTINCT path || '/' || m AS path, k AS kind FROM x JOIN members USING (g) WHERE k <> 'uses'""")
def uses_reexpand(spark, sf_dir):
    """The same expansion under the last module's name."""
    last = F.broadcast(_t(spark, sf_dir, "region").agg(F.max("r_name").alias("last")).withColumn("j", F.lit(1)))
    site = _t(spark, sf_dir, "nation").withColumn("j", F.lit(1)).join(last, "j").select(F.concat(F.col("last"), F.lit("/nation/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit("common").alias("grouping"))
    return _expanded(spark, site).select(F.concat_ws("/", "path", "member").alias("path"), "kind").distinct()


@_query(f"SELECT DISTINCT 'ex/customer/' || c_custkey AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def augment_stub(spark, sf_dir):
    """Targets that nothing registered get a class of their own."""
    targets = _t(spark, sf_dir, "customer").select(_iri("customer", "c_custkey").alias("path"))
    reg = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(_iri("customer", "o_custkey").alias("path"))
    return T.triple_set(T.emit(R.unregistered(targets, reg), F.col("path"), T.iri(T.TYPE, T.CLASS))).select("s", "p", "o")


@_query(_PLACES + """
SELECT p.path AS parent, c.path AS child,
  'has' || array_to_string(list_transform(string_split(regexp_replace(c.path, '^.*/', ''), '-'), lambda w: upper(w[1]) || lower(w[2:])), '') AS property
FROM places c JOIN places p ON p.path = regexp_replace(c.path, '/[^/]*$', '')""")
def containment(spark, sf_dir):
    return R.containment(_place_triples(spark, sf_dir).select("path"))


@_query("SELECT DISTINCT 'ex/links/' || o_custkey AS s, 0 AS min_cardinality FROM orders WHERE o_orderstatus <> 'P' UNION SELECT DISTINCT 'ex/made-of/' || l_partkey, 0 FROM lineitem")
def cardinality_default(spark, sf_dir):
    o, li = T.spread(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")), T.spread(_t(spark, sf_dir, "lineitem").select("l_partkey"))
    kind = F.when(F.col("o_orderstatus") == "P", T.DATATYPE_PROPERTY).otherwise(T.OBJECT_PROPERTY)
    g = T.emit(o, F.concat(F.lit(EX + "links/"), F.col("o_custkey").cast("string")), T.iri(T.TYPE, kind))
    g = g.unionByName(T.emit(li, F.concat(F.lit(EX + "made-of/"), F.col("l_partkey").cast("string")), T.iri(T.TYPE, T.OBJECT_PROPERTY)))
    return T.cardinality_default(g).select("s", F.col("o").cast("int").alias("min_cardinality"))


@_query(f"SELECT DISTINCT 'ex/nation/' || n_nationkey AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def import_bases(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(_iri("nation", "n_nationkey").alias("path"))
    reg = _t(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(_iri("nation", "s_nationkey").alias("path"))
    return T.triple_set(T.emit(R.unregistered(rows, reg), F.col("path"), T.iri(T.TYPE, T.CLASS))).select("s", "p", "o")


@_query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS BIGINT) AS d, l_returnflag AS f FROM lineitem)
SELECT 'ex/line/' || l_orderkey || '/' || l_linenumber AS s, '{T.SH}condition' AS p, '. <= ' || d AS o FROM d WHERE d > 5
UNION SELECT 'ex/line/' || l_orderkey || '/' || l_linenumber, '{T.SH}deactivated', '../flag = ''' || f || '''' FROM d WHERE f = 'R'
UNION SELECT 'ex/line/' || l_orderkey || '/' || l_linenumber, '{T.COMMENT}', 'Conditional: exists when ../flag = ''' || f || '''' FROM d WHERE f = 'R'""")
def must_when(spark, sf_dir):
    d = T.spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.col("l_returnflag").alias("f")))
    s = F.concat(F.lit(EX + "line/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    must = F.when(F.col("d") > 5, F.concat(F.lit(". <= "), F.col("d").cast("string")))
    when = F.when(F.col("f") == "R", F.concat(F.lit("../flag = '"), "f", F.lit("'")))
    return T.triple_set(T.emit(d, s, T.text(T.SH + "condition", must), T.text(T.SH + "deactivated", when), T.text(T.COMMENT, F.concat(F.lit("Conditional: exists when "), when)))).select("s", "p", "o")


_RANGE_SQL = """
WITH r AS (SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' .. ' || CAST(CAST(l_quantity AS BIGINT) + l_linenumber AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey, l_quantity) || '|5|min..9|1.5..2' AS txt FROM lineitem GROUP BY l_orderkey),
x AS (SELECT l_orderkey, string_split(trim(u), '..') AS p FROM r, unnest(string_split(txt, '|')) AS t(u)),
g AS (SELECT l_orderkey, CAST(trim(p[1]) AS BIGINT) AS low, CAST(trim(p[2]) AS BIGINT) AS high FROM x WHERE len(p) = 2 AND regexp_matches(p[1], '^\\s*[+-]?[0-9]+\\s*$') AND regexp_matches(p[2], '^\\s*[+-]?[0-9]+\\s*$'))
"""


def _ranges(spark, sf_dir):
    part = F.concat_ws(" .. ", F.col("l_quantity").cast("long").cast("string"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).cast("string"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", part.alias("x")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["x"]), "|")
    return li.groupBy("l_orderkey").agg(F.concat(joined, F.lit("|5|min..9|1.5..2")).alias("txt"))


@_query(_RANGE_SQL + "SELECT l_orderkey, low, high FROM g")
def constraint_extract(spark, sf_dir):
    return _ranges(spark, sf_dir).select("l_orderkey", F.inline(N.range_parts(F.col("txt"))))


@_query(_RANGE_SQL + "SELECT l_orderkey, min(low) AS low, max(high) AS high FROM g GROUP BY l_orderkey")
def range_hull(spark, sf_dir):
    return _ranges(spark, sf_dir).select("l_orderkey", N.range_hull(F.col("txt")).alias("h")).select("l_orderkey", "h.low", "h.high")


@_query(f"""
WITH a AS (SELECT p_type AS t, min(length(p_name)) AS a, max(length(p_name)) AS b, min(p_size) AS c, max(p_size) AS d FROM part GROUP BY p_type)
SELECT 'ex/' || t AS s, '{T.TYPE}' AS p, '{T.SH}NodeShape' AS o FROM a
UNION SELECT 'ex/' || t, '{T.SH}minLength', CAST(a AS VARCHAR) FROM a UNION SELECT 'ex/' || t, '{T.SH}maxLength', CAST(b AS VARCHAR) FROM a
UNION SELECT 'ex/' || t, '{T.SH}minInclusive', CAST(c AS VARCHAR) FROM a UNION SELECT 'ex/' || t, '{T.SH}maxInclusive', CAST(d AS VARCHAR) FROM a""")
def shacl_shape(spark, sf_dir):
    a = _t(spark, sf_dir, "part").groupBy("p_type").agg(F.min(F.length("p_name")).alias("a"), F.max(F.length("p_name")).alias("b"), F.min("p_size").alias("c"), F.max("p_size").alias("d"))
    facts = [T.number(T.SH + p, F.col(c)) for p, c in (("minLength", "a"), ("maxLength", "b"), ("minInclusive", "c"), ("maxInclusive", "d"))]
    return T.triple_set(T.emit(a, F.concat(F.lit(EX), "p_type"), T.iri(T.TYPE, T.SH + "NodeShape"), *facts)).select("s", "p", "o")


@_query(_PLACES + "SELECT path, prov FROM places")
def prov_path(spark, sf_dir):
    """Provenance of each place: segments of its ancestors, joined."""
    r, n, c = (_t(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    pre = F.lit("tp")
    top = r.select("r_regionkey", F.concat(F.lit("regions/"), "r_name").alias("path"), N.prov_segment(pre, F.col("r_name"), F.lit("container")).alias("prov"))
    mid = n.join(F.broadcast(top), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "path", "n_name").alias("path"), F.concat_ws("/", "prov", N.prov_segment(pre, F.col("n_name"), F.lit("list"))).alias("prov"))
    low = c.join(F.broadcast(mid), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "path", "c_name").alias("path"), F.concat_ws("/", "prov", N.prov_segment(pre, F.col("c_name"), F.lit("list"))).alias("prov"))
    return top.select("path", "prov").unionByName(mid.select("path", "prov")).unionByName(low)


# --- graph patterns ---------------------------------------------------------


def _i(x: str) -> str:
    return f"<{EX}{x}>"


@_query("SELECT 'ex/nation/' || n_nationkey AS location, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, r_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey")
def bgp_location(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    g = T.by_predicate(n, _iri("nation", "n_nationkey"), (T.iri, T.TYPE, EX + "location"), (T.text, EX + "id", F.col("n_nationkey").cast("string")), (T.text, EX + "name", F.col("n_name")), (T.text, EX + "type", F.col("r_name")))
    return solve(g, Query(["location", "id", "name", "type"], [("?location", f"<{T.TYPE}>", _i("location")), ("?location", _i("id"), "?id"), ("?location", _i("name"), "?name"), ("?location", _i("type"), "?type")]))


@_query("""
SELECT CAST(o_orderkey AS VARCHAR) AS orderID, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, c_name AS customerName, n_name AS nationName
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' ORDER BY nationName, orderID""")
def bgp_chassis(spark, sf_dir):
    o, c, n = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    orders = T.by_predicate(o, _iri("order", "o_orderkey"), (T.iri, EX + "status", _iri("status", "o_orderstatus")), (T.text, EX + "order-id", F.col("o_orderkey").cast("string")), (T.iri, EX + "customer", _iri("customer", "o_custkey")))
    customers = T.by_predicate(c, _iri("customer", "c_custkey"), (T.text, EX + "name", F.col("c_name")), (T.text, EX + "segment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))), (T.iri, EX + "nation", _iri("nation", "c_nationkey")))
    nations = T.by_predicate(n, _iri("nation", "n_nationkey"), (T.text, EX + "name", F.col("n_name")))
    return solve(T.merged(orders, customers, nations), Query(
        ["orderID", "segment", "customerName", "nationName"],
        [("?o", _i("status"), _i("status/F")), ("?o", _i("order-id"), "?orderID"), ("?o", _i("customer"), "?c"), ("?c", _i("name"), "?customerName"), ("?c", _i("nation"), "?n"), ("?n", _i("name"), "?nationName")],
        optionals=[[("?c", _i("segment"), "?segment")]], order=[("nationName", False), ("orderID", False)],
    ))


@_query("""
SELECT CAST(l_orderkey AS VARCHAR) AS orderID, p_name AS partName, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, s_name AS supplierName
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 15 ORDER BY CAST(l_quantity AS BIGINT) DESC""")
def bgp_power(spark, sf_dir):
    """Blank nodes for lines, a value join from line to part by its number, numeric order."""
    li, p, s = (_t(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    line = F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string"), F.lit("x"), F.col("l_linenumber").cast("string"), F.lit("x"), F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_suppkey").cast("string"))
    lines = T.by_predicate(li, line, (T.text, EX + "order-id", F.col("l_orderkey").cast("string")), (T.number, EX + "part-number", F.col("l_partkey")), (T.iri, EX + "supplier", _iri("supplier", "l_suppkey")), (T.number, EX + "quantity", F.col("l_quantity").cast("long")))
    parts = T.by_predicate(p, _iri("part", "p_partkey"), (T.number, EX + "number", F.col("p_partkey")), (T.text, EX + "name", F.col("p_name")), (T.number, EX + "size", F.col("p_size")))
    suppliers = T.by_predicate(s, _iri("supplier", "s_suppkey"), (T.text, EX + "name", F.col("s_name")))
    return solve(T.merged(lines, parts, suppliers), Query(
        ["orderID", "partName", "quantity", "supplierName"],
        [("?p", _i("size"), f'"15"^^<{T.XSD}integer>'), ("?p", _i("number"), "?num"), ("?p", _i("name"), "?partName"), ("?l", _i("part-number"), "?num"), ("?l", _i("quantity"), "?quantity"),
         ("?l", _i("order-id"), "?orderID"), ("?l", _i("supplier"), "?s"), ("?s", _i("name"), "?supplierName")], order=[("quantity", True)],
    ))


@_query("""
SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM (
  SELECT DISTINCT 'ex/order/' || l_orderkey AS s, 'ex/hasPart' AS p, 'ex/part/' || l_partkey AS o FROM lineitem
  UNION SELECT 'ex/order/' || o_orderkey, 'ex/customer', 'ex/customer/' || o_custkey FROM orders) GROUP BY p""")
def triple_stats(spark, sf_dir):
    o, li = T.spread(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")), T.spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    a = T.emit(li, _iri("order", "l_orderkey"), T.iri(EX + "hasPart", _iri("part", "l_partkey")))
    b = T.emit(o, _iri("order", "o_orderkey"), T.iri(EX + "customer", _iri("customer", "o_custkey")))
    return T.triple_stats(T.triple_set(a, b))


_MAPS = [("m1", "ASIA", "ex/Asia", "type", "Class"), ("m1", "ASIA", "ex/Asia", "label", "Asia"), ("m2", "ATLANTIS", "ex/Atlantis", "type", "Class"), ("m3", "EUROPE", "ex/Europe", "inverseOf", "ex/Land"), ("m3", "EUROPE", "ex/Europe", "disjointWith", "ex/Asia")]


@_query("SELECT subject AS s, predicate AS p, object AS o FROM (VALUES " + ", ".join(str(m) for m in _MAPS) + ") AS v(map_id, iterator, subject, predicate, object) WHERE EXISTS (SELECT 1 FROM region WHERE r_name = iterator)")
def rml_constant_map(spark, sf_dir):
    """Constant triples of the maps whose iterator finds something."""
    maps = spark.createDataFrame(_MAPS, "map_id string, iterator string, s string, p string, o string")
    return maps.join(_t(spark, sf_dir, "region"), F.col("iterator") == F.col("r_name"), "left_semi").select("s", "p", "o")


@_query("""
SELECT n_nationkey, '<li class=''list''><span class=''keyword''>list</span><span class=''arg''>' || n_name || '</span><span class="type">(' || r_name || ')</span></li>' AS fragment
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def html_tree(spark, sf_dir):
    from ..sources.html import node_html

    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", node_html(F.lit("list"), F.col("n_name"), F.col("r_name"), F.lit(None).cast("string"), F.lit("")).alias("fragment"))


@_query(f"""
SELECT '<ex/region/' || r_regionkey || '> <{T.LABEL}> "' || r_name || '" .' AS line FROM region
UNION SELECT '<ex/nation/' || n_nationkey || '> <ex/region> <ex/region/' || n_regionkey || '> .' FROM nation
UNION SELECT '<ex/nation/' || n_nationkey || '> <ex/key> "' || n_nationkey || '"^^<{T.XSD}integer> .' FROM nation""")
def turtle_sink(spark, sf_dir):
    r = T.emit(_t(spark, sf_dir, "region"), _iri("region", "r_regionkey"), T.text(T.LABEL, F.col("r_name")))
    n = T.emit(_t(spark, sf_dir, "nation"), _iri("nation", "n_nationkey"), T.iri(EX + "region", _iri("region", "n_regionkey")), T.number(EX + "key", F.col("n_nationkey")))
    return T.ntriples(T.triple_set(r, n))
