"""From YANG statements to the triples of an ontology.

The walk over a model is not done step by step. First a table of instances is
grown level by level (one join with the statements for each level): every data
node with its full path, where ``uses`` and ``augment`` put it, and ``ord``, an
array that sorts like the moment a sequential walk would reach it. What was
known at that moment (paths, typedefs, provenance) is then an as-of join
against registries with the same kind of array. Each emission is a projection.

``ord`` starts with the step: 5 for the walk over modules by file name, 9 for
the second expansion of ``uses``, which names paths after the last module.
Circular groupings fail at ``DEPTH`` levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import registry as R
from ..operators import triples as T
from ..operators import types as Y
from .durable import cut

DEPTH = 64
DATA = ("container", "list", "leaf", "leaf-list")
#: Texts that comments must have.
ANYDATA = "Anydata: Arbitrary structure extension point"
CONTAINMENT = "Containment relation (parent --> child)."
POINTER = "A semantic pointer to a specific data node instance."
GROUPING = "Grouping definition: "
CONDITIONAL = "Conditional: exists when "
UNION_PARENT = "Union Parent: "


class SchemaGraph:
    """One compilation; :meth:`triples` is the graph, the other tables can be looked at by themselves."""

    def __init__(self, stmts: DataFrame, base_uri: str = "http://example.org/ontology/"):
        self.ex = base_uri.rstrip("/") + "/"
        self.stmts = cut(stmts)
        self.spark = stmts.sparkSession
        top = self.stmts.where("depth = 1")
        self.top = top
        last = top.agg(F.max_by("module", "walk_seq")).first()
        self.stale = last[0] if last else None
        kid = self.stmts.where("depth > 0")

        def first(keyword: str, what: str) -> Column:
            return F.min_by(what, F.when(F.col("keyword") == keyword, F.col("ordinal")))

        self.facts = cut(kid.groupBy("file", F.col("parent_id").alias("stmt_id")).agg(
            first("description", "arg").alias("description"), first("type", "arg").alias("type_name"), first("type", "stmt_id").alias("type_id"),
            first("base", "arg").alias("base"), first("path", "arg").alias("xpath"),
        ))
        self.groupings = R.last_by(top.where("keyword = 'grouping'"), "arg", "load_seq", "ordinal").select(F.col("arg").alias("g_name"), F.col("file").alias("g_file"), F.col("stmt_id").alias("g_id"), "load_seq")
        types = top.where("keyword = 'typedef'").join(self.facts, ["file", "stmt_id"], "left")
        self.typedefs = types.select(F.col("arg").alias("name"), F.col("type_name").alias("base_type"), F.col("type_id").alias("base_id"), F.col("file").alias("base_file"), F.array(F.lit(5), F.col("walk_seq"), F.col("ordinal")).alias("order"))
        self.instances = cut(self._instances())

    def uri(self, path: Column) -> Column:
        return F.concat(F.lit(self.ex), F.regexp_replace(path, "^/+", ""))

    def _ex(self, *parts) -> Column:
        return F.concat(F.lit(self.ex), *(p if isinstance(p, Column) else F.lit(p) for p in parts))

    # --- instances ----------------------------------------------------------

    def _instances(self) -> DataFrame:
        none, no_ord = F.lit(None).cast("string"), F.lit(None).cast("array<int>")
        walk = F.array(F.lit(5), F.col("walk_seq"), F.col("ordinal"))
        path = N.normalize_path(F.concat(F.lit("/"), F.col("arg")), F.col("module"))
        columns = ["role", "file", "stmt_id", "keyword", "name", "path", "module", "routine", "parent_path", "parent_ord", "lookup", "ord", "uses_file", "uses_id", "prefix", "src_file", "src_id"]

        def rows(df: DataFrame, role: str, path: Column, module: Column, ord_: Column) -> DataFrame:
            return df.select(
                F.lit(role).alias("role"), "file", "stmt_id", "keyword", F.col("arg").alias("name"), path.alias("path"), module.alias("module"), F.col("keyword").alias("routine"),
                none.alias("parent_path"), no_ord.alias("parent_ord"), none.alias("lookup"), ord_.alias("ord"), none.alias("uses_file"), F.lit(None).cast("long").alias("uses_id"),
                "prefix", F.col("file").alias("src_file"), F.col("stmt_id").alias("src_id"),
            )

        stale = F.lit(self.stale).cast("string")
        tree = rows(self.top.where(F.col("keyword").isin("container", "list")), "tree", N.normalize_path(F.concat(F.lit("/"), F.col("arg")), stale), stale, F.array(F.lit(9), F.col("load_seq"), F.col("ordinal")))
        nodes = rows(self.top.where(F.col("keyword").isin("container", "list", "leaf")), "node", path, F.col("module"), walk)
        augments = rows(self.top.where("keyword = 'augment' AND arg IS NOT NULL"), "augment", N.augment_target(F.col("arg")), F.col("module"), walk)
        level = cut(nodes.unionByName(augments).unionByName(tree))
        found = level
        kids = self.stmts.where("depth > 0").select(
            F.col("file").alias("k_file"), F.col("parent_id").alias("k_parent"), F.col("stmt_id").alias("k_id"), F.col("ordinal").alias("k_ordinal"),
            F.col("keyword").alias("k_keyword"), F.col("arg").alias("k_arg"), F.col("prefix").alias("k_prefix"),
        )
        exact = F.broadcast(self.groupings.select(F.col("g_name").alias("n1"), F.col("g_file").alias("f1"), F.col("g_id").alias("i1")))
        bare = F.broadcast(self.groupings.select(F.col("g_name").alias("n2"), F.col("g_file").alias("f2"), F.col("g_id").alias("i2")))
        for _ in range(DEPTH):
            k = F.col("k_keyword")
            opened = level.where((F.col("role").isin("augment", "uses", "tree")) | ((F.col("role") == "node") & F.col("keyword").isin("container", "list")))
            pairs = opened.join(kids, (F.col("src_file") == F.col("k_file")) & (F.col("src_id") == F.col("k_parent")))
            inner = k.isin("container", "list")
            role = (
                F.when(k == "uses", "uses")
                .when((F.col("role") == "tree") & inner, "tree")
                .when(F.col("role") == "tree", None)
                .when((F.col("role") == "node") & k.isin(*DATA), "node")
                .when((F.col("role") == "node") & (k == "choice") & (F.col("routine") == "container"), "choice")
                .when((F.col("role") == "augment") & k.isin("leaf", "container", "list"), "node")
                .when((F.col("role") == "uses") & k.isin("leaf", "leaf-list", "anydata"), "member")
                .when((F.col("role") == "uses") & inner, "node")
                .when((F.col("role") == "uses") & (k == "choice"), "choice")
            )
            below = F.concat_ws("/", "path", "k_arg")
            new_path = F.when(F.col("new_role").isin("uses", "choice"), F.col("path")).when(F.col("role").isin("node", "tree"), N.normalize_path(below, F.col("module"))).otherwise(below)
            step = pairs.withColumn("new_role", role).where("new_role IS NOT NULL")
            step = step.join(exact, (k == "uses") & (F.col("k_arg") == F.col("n1")), "left").join(bare, (k == "uses") & (N.local_name(F.col("k_arg")) == F.col("n2")), "left")
            step = step.where((k != "uses") | F.coalesce("i1", "i2").isNotNull())  # an unknown grouping adds nothing
            opens = F.col("role").isin("augment", "uses")
            level = cut(step.select(
                F.col("new_role").alias("role"), F.col("k_file").alias("file"), F.col("k_id").alias("stmt_id"), k.alias("keyword"), F.col("k_arg").alias("name"), new_path.alias("path"), "module",
                F.when(F.col("role") == "augment", F.lit("container")).otherwise(k).alias("routine"), F.col("path").alias("parent_path"),
                F.when(F.col("role") == "node", F.col("ord")).alias("parent_ord"), F.when(opens & (F.col("new_role") == "node"), F.col("path")).alias("lookup"),
                F.concat("ord", F.array("k_ordinal")).alias("ord"), F.when(F.col("role") == "uses", F.col("file")).alias("uses_file"), F.when(F.col("role") == "uses", F.col("stmt_id")).alias("uses_id"),
                F.col("k_prefix").alias("prefix"), F.when(k == "uses", F.coalesce("f1", "f2")).otherwise(F.col("k_file")).alias("src_file"), F.when(k == "uses", F.coalesce("i1", "i2")).otherwise(F.col("k_id")).alias("src_id"),
            ).select(*columns))
            if level.isEmpty():
                return found
            found = found.unionByName(level)
        raise RecursionError(f"groupings nest deeper than {DEPTH} levels; one of them may use itself")

    # --- registries ---------------------------------------------------------

    def _inner(self) -> DataFrame:
        return self.instances.where("role = 'node' AND keyword IN ('container', 'list')")

    def class_paths(self) -> DataFrame:
        """(path, since): when each path was first registered."""
        return self.instances.where("role = 'augment' OR (role = 'node' AND keyword IN ('container', 'list'))").groupBy("path").agg(F.min("ord").alias("since"))

    def provenance(self) -> DataFrame:
        """(ord, prov) of every data node."""
        seg = N.prov_segment(F.col("prefix"), F.col("name"), F.col("keyword"))
        nodes = self.instances.where("role = 'node'").select("ord", "keyword", "path", "lookup", "parent_ord", seg.alias("seg"))
        reg = self._inner().select("path", F.col("ord").alias("reg_ord"))
        asked = nodes.where("lookup IS NOT NULL").select("ord", F.col("lookup").alias("path"))
        found = R.latest_before(asked, reg.withColumn("up", F.col("reg_ord")), "path", "reg_ord", "ord", ["up"], ["ord"]).select(F.col("ord").alias("o"), "up")
        linked = cut(nodes.join(found, F.col("ord") == F.col("o"), "left").select("ord", "keyword", "seg", F.coalesce("parent_ord", "up").alias("up")))
        inner = linked.where("keyword IN ('container', 'list')")
        level = cut(inner.where("up IS NULL").select("ord", F.col("seg").alias("prov")))
        done = level
        for _ in range(DEPTH):
            level = cut(inner.join(level.select(F.col("ord").alias("u"), F.col("prov").alias("above")), F.col("up") == F.col("u")).select("ord", F.concat_ws("/", "above", "seg").alias("prov")))
            if level.isEmpty():
                break
            done = done.unionByName(level)
        else:
            raise RecursionError(f"data nodes nest deeper than {DEPTH} levels")
        leaves = linked.where("keyword NOT IN ('container', 'list')").join(done.select(F.col("ord").alias("u"), F.col("prov").alias("above")), F.col("up") == F.col("u"), "left")
        return cut(done.unionByName(leaves.select("ord", F.concat_ws("/", "above", "seg").alias("prov"))))

    # --- emission -----------------------------------------------------------

    def _constraints(self, nodes: DataFrame) -> DataFrame:
        """must and when of nodes (file, stmt_id, s)."""
        rules = self.stmts.where("keyword IN ('must', 'when')").select("file", F.col("parent_id").alias("stmt_id"), F.col("stmt_id").alias("rule_id"), F.col("keyword").alias("rule"), F.coalesce("arg", F.lit("")).alias("xpath_text"))
        said = self.stmts.where("keyword = 'error-message'").select("file", F.col("parent_id").alias("rule_id"), F.col("arg").alias("message"))
        rows = nodes.select("file", "stmt_id", "s").join(rules, ["file", "stmt_id"]).join(said, ["file", "rule_id"], "left")
        must, when = F.when(F.col("rule") == "must", F.col("xpath_text")), F.when(F.col("rule") == "when", F.col("xpath_text"))
        return T.emit(rows, F.col("s"), T.text(T.SH + "condition", must), T.text(T.SH + "message", F.when(F.col("rule") == "must", F.col("message"))), T.text(T.SH + "deactivated", when), T.text(T.COMMENT, F.concat(F.lit(CONDITIONAL), when)))

    def inner_nodes(self, prov: DataFrame) -> DataFrame:
        rows = self._inner().join(self.facts.select("file", "stmt_id", "description"), ["file", "stmt_id"], "left").join(prov, "ord", "left").withColumn("s", self.uri(F.col("path")))
        return T.emit(rows, F.col("s"), T.text(T.DERIVED, F.col("prov")), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("name")), T.text(T.COMMENT, F.col("description"))).unionByName(self._constraints(rows))

    def leaf_rows(self) -> DataFrame:
        """Typed leaves with what their type is made of."""
        leaves = self.instances.where("role = 'node' AND keyword IN ('leaf', 'leaf-list')").join(self.facts, ["file", "stmt_id"], "left")
        leaves = leaves.withColumns({"bare": N.local_name(F.col("type_name")), "s": self.uri(F.col("path")), "domain": self.uri(F.col("parent_path"))})
        seen = R.latest_before(
            leaves.where("type_name IS NOT NULL").select("ord", "bare"), self.typedefs.where("base_type IS NOT NULL").withColumnRenamed("name", "bare"), "bare", "order", "ord", ["base_type", "base_id", "base_file"], ["ord"]
        ).select("ord", "base_type", "base_id", "base_file")
        rows = leaves.join(seen, "ord", "left")
        union = F.coalesce("base_type", "type_name") == "union"
        return cut(rows.withColumns({
            "kind": Y.leaf_kind(F.col("type_name"), union), "union_file": F.coalesce("base_file", "file"), "union_id": F.coalesce("base_id", "type_id"),
        }))

    def leafref_targets(self, leaves: DataFrame) -> DataFrame:
        """(ord, xpath, target) for the leafrefs that resolve. The first answer for a path and XPath holds for all later ones."""
        type_facts = self.facts.select("file", F.col("stmt_id").alias("type_id"), F.col("xpath").alias("ref"))
        refs = leaves.where("kind = 'leafref'").join(type_facts, ["file", "type_id"]).where("ref IS NOT NULL AND ref <> ''")
        firsts = refs.groupBy("path", "ref").agg(F.min("ord").alias("first_ord"))
        clean = N.xpath_clean(F.col("ref"))
        ups = (F.length(clean) - F.length(F.replace(clean, F.lit("../"), F.lit("")))) / 3
        context = F.filter(F.split("path", "/"), lambda p: p != "")
        rest = F.filter(F.split(F.replace(clean, F.lit("../"), F.lit("")), "/"), lambda p: p != "")
        base = F.when(ups >= F.size(context), F.array().cast("array<string>")).otherwise(F.slice(context, F.lit(1), F.greatest(F.size(context) - ups.cast("int"), F.lit(0))))
        asked = firsts.where(F.contains(clean, F.lit("../"))).select(F.col("path").alias("leaf_path"), "ref", "first_ord", F.concat(base, rest).alias("parts"))
        hit = R.longest_prefix(asked, self.class_paths(), "parts", ["leaf_path", "ref", "first_ord"], at="first_ord", order="since")
        return refs.join(hit.select(F.col("leaf_path").alias("lp"), F.col("ref").alias("r"), F.col("path").alias("target")), (F.col("path") == F.col("lp")) & (F.col("ref") == F.col("r"))).select("ord", "ref", "target")

    def leaf_nodes(self, prov: DataFrame) -> DataFrame:
        leaves = self.leaf_rows()
        s, domain = F.col("s"), F.col("domain")
        out = [T.emit(leaves.select("ord", "s").join(prov, "ord"), s, T.text(T.DERIVED, F.col("prov")))]
        typed = leaves.where("type_name IS NOT NULL")
        out += [T.emit(typed, s, T.text(T.COMMENT, F.col("description"))), self._constraints(typed)]
        bases = self.facts.select("file", F.col("stmt_id").alias("type_id"), N.local_name(F.col("base")).alias("base_name"))
        ids = typed.where("kind = 'identityref'").join(bases, ["file", "type_id"], "left")
        out.append(T.emit(ids, s, T.iri(T.TYPE, T.OBJECT_PROPERTY), T.text(T.LABEL, F.col("name")), T.iri(T.RANGE, self._ex("identity/", F.col("base_name"))), T.iri(T.DOMAIN, domain)))
        refs = typed.where("kind = 'leafref'").join(self.leafref_targets(typed), "ord", "left")
        found = F.col("target").isNotNull()
        out.append(T.emit(refs, s, T.iri(T.TYPE, T.OBJECT_PROPERTY), T.text(self.ex + "xpathPath", F.when(found, F.col("ref"))), T.iri(T.RANGE, self.uri(F.col("target"))), T.iri(T.DOMAIN, F.when(found, domain))))
        unions = typed.where("kind = 'union'").withColumn("u", self._ex("types/Union_", F.col("name")))
        out.append(T.emit(unions, s, T.iri(T.TYPE, T.OBJECT_PROPERTY), T.iri(T.RANGE, F.col("u")), T.iri(T.DOMAIN, domain), T.iri(T.TYPE, T.CLASS, s=F.col("u")), T.text(T.LABEL, F.concat(F.lit(UNION_PARENT), "name"), s=F.col("u"))))
        parts = self.stmts.where("keyword = 'type' AND arg = 'identityref'").select(F.col("file").alias("union_file"), F.col("parent_id").alias("union_id"), F.col("stmt_id").alias("type_id2"))
        parts = parts.join(bases.select(F.col("file").alias("union_file"), F.col("type_id").alias("type_id2"), "base_name"), ["union_file", "type_id2"])
        out.append(T.emit(unions.join(parts, ["union_file", "union_id"]), self._ex("identity/", F.col("base_name")), T.iri(T.SUBCLASS, F.col("u"))))
        out.append(T.emit(typed.where("kind = 'instance-identifier'"), s, T.iri(T.TYPE, T.OBJECT_PROPERTY), T.text(T.LABEL, F.col("name")), T.boolean(self.ex + "isInstanceIdentifier", "true"), T.text(T.COMMENT, POINTER), T.iri(T.DOMAIN, domain)))
        plain = Y.resolve_types(typed.where("kind = 'regular'").select("ord", "s", "name", "domain", "type_name"), self.typedefs, "type_name", ["ord"], at="ord")
        out.append(T.emit(plain, s, T.iri(T.TYPE, T.DATATYPE_PROPERTY), T.text(T.LABEL, F.col("name")), T.iri(T.RANGE, F.col("resolved")), T.iri(T.DOMAIN, domain)))
        return T.triple_set(*out)

    def members(self) -> DataFrame:
        """Leaves that a grouping brings in."""
        refine = self.stmts.where("keyword = 'refine'").select("file", "parent_id", F.col("stmt_id").alias("refine_id"), F.col("arg").alias("member"), F.col("ordinal").alias("refine_at"))
        said = self.stmts.where("keyword = 'mandatory'").groupBy("file", F.col("parent_id").alias("refine_id")).agg(F.max_by("arg", "ordinal").alias("mandatory"))
        refine = refine.join(said, ["file", "refine_id"], "left").groupBy(F.col("file").alias("uses_file"), F.col("parent_id").alias("uses_id"), F.col("member").alias("name")).agg(F.max_by(F.struct("mandatory"), "refine_at").alias("m"))
        rows = self.instances.where("role = 'member'").join(self.facts.select("file", "stmt_id", "description"), ["file", "stmt_id"], "left").join(refine, ["uses_file", "uses_id", "name"], "left")
        return T.emit(
            rows, self.uri(F.col("path")), T.iri(T.TYPE, T.DATATYPE_PROPERTY), T.text(T.LABEL, F.col("name")), T.iri(T.DOMAIN, self.uri(F.col("parent_path"))), T.iri(T.RANGE, T.XSD + "string"),
            T.text(T.COMMENT, F.col("description")), T.text(T.COMMENT, F.when(F.col("keyword") == "anydata", ANYDATA)), T.number(T.MIN_CARDINALITY, F.when(F.col("m.mandatory") == "true", 1)),
        )

    def disjoint_cases(self) -> DataFrame:
        cases = self.stmts.where("keyword IN ('case', 'container', 'list')").select("file", F.col("parent_id").alias("stmt_id"), F.col("arg").alias("case_name"))
        rows = self.instances.where("role = 'choice'").join(cases, ["file", "stmt_id"]).select("ord", self.uri(N.normalize_path(F.concat_ws("/", "path", "case_name"), F.col("module"))).alias("c"))
        return T.emit(R.disjoint_pairs(rows, "ord", "c"), F.col("a"), T.iri(T.DISJOINT, F.col("b")))

    def stubs(self) -> DataFrame:
        """Augmented paths that nothing had registered when the first augment came."""
        reg = self._inner().groupBy("path").agg(F.min("ord").alias("since"))
        first = self.instances.where("role = 'augment'").groupBy("path").agg(F.min("ord").alias("asked"))
        missing = first.join(reg, "path", "left").where("since IS NULL OR since > asked")
        return T.emit(missing, self.uri(F.col("path")), T.iri(T.TYPE, T.CLASS))

    def containment(self, prov: DataFrame) -> DataFrame:
        walked = self.class_paths().where(F.element_at("since", 1) == 5)
        latest = self._inner().where(F.element_at("ord", 1) == 5).groupBy("path").agg(F.max("ord").alias("ord")).join(prov, "ord").select(F.col("path").alias("parent"), "prov")
        rows = R.containment(walked).join(latest, "parent", "left")
        return T.emit(
            rows, self.uri(F.concat_ws("/", "parent", "property")), T.iri(T.TYPE, T.OBJECT_PROPERTY), T.text(T.LABEL, F.col("property")), T.iri(T.DOMAIN, self.uri(F.col("parent"))),
            T.iri(T.RANGE, self.uri(F.col("child"))), T.text(T.COMMENT, CONTAINMENT), T.text(T.DERIVED, F.when(F.col("prov").isNotNull(), F.concat_ws("/", "prov", "property"))),
        )

    def ghosts(self) -> DataFrame:
        """Top-level containers and lists under the last module's name, where nothing is registered there."""
        rows = self.top.where(F.col("keyword").isin("container", "list")).withColumn("path", N.normalize_path(F.concat(F.lit("/"), F.col("arg")), F.lit(self.stale).cast("string")))
        first = rows.groupBy("path").agg(F.min(F.struct("load_seq", "ordinal")).alias("f"))
        rows = rows.join(first, "path").where("load_seq = f.load_seq AND ordinal = f.ordinal")
        rows = R.unregistered(rows, self.class_paths()).join(self.facts.select("file", "stmt_id", "description"), ["file", "stmt_id"], "left")
        box = F.col("keyword") == "container"
        return T.emit(
            rows, self.uri(F.col("path")), T.iri(T.TYPE, T.CLASS),
            T.text(T.DERIVED, F.when(box, N.prov_segment(F.col("prefix"), F.col("arg"), F.col("keyword")))), T.text(T.COMMENT, F.when(box, F.col("description"))),
        )

    def identities(self) -> DataFrame:
        ids = self.top.where("keyword = 'identity'")
        s = self._ex("identity/", F.col("arg"))
        prov = N.prov_segment(F.col("prefix"), F.col("arg"), F.col("keyword"))
        said = self.stmts.where("keyword = 'description'").select("file", F.col("parent_id").alias("stmt_id"), F.col("arg").alias("said"))
        last = R.last_by(ids, "arg", "load_seq", "ordinal").join(self.facts.select("file", "stmt_id", "base"), ["file", "stmt_id"], "left")
        return T.triple_set(
            T.emit(ids, s, T.text(T.DERIVED, prov), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("arg")), T.iri(T.TYPE, T.INDIVIDUAL)),
            T.emit(ids.join(said, ["file", "stmt_id"]), s, T.text(T.COMMENT, F.col("said"))),
            T.emit(last, s, T.iri(T.SUBCLASS, self._ex("identity/", N.local_name(F.col("base"))))),
        )

    def grouping_classes(self) -> DataFrame:
        g = self.groupings.select("g_name", F.col("g_file").alias("file"), F.col("g_id").alias("stmt_id")).join(self.facts.select("file", "stmt_id", "description"), ["file", "stmt_id"], "left")
        return T.emit(g, self._ex("grouping/", F.col("g_name")), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("g_name")), T.text(T.COMMENT, F.concat(F.lit(GROUPING), "g_name")), T.text(T.COMMENT, F.col("description")))

    def operations(self) -> DataFrame:
        """rpc and notification classes."""
        return T.emit(self.top.where("keyword IN ('rpc', 'notification')"), self._ex(F.col("keyword"), "/", F.col("arg")), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("arg")))

    def _typedef_types(self) -> DataFrame:
        t = self.stmts.where("keyword = 'type'").select("file", F.col("parent_id").alias("stmt_id"), F.col("stmt_id").alias("type_id"), F.col("arg").alias("type_name"), F.col("ordinal").alias("type_at"))
        return self.top.where("keyword = 'typedef' AND arg IS NOT NULL").select("file", "stmt_id", F.col("arg").alias("name")).join(t, ["file", "stmt_id"])

    def enumerations(self) -> DataFrame:
        types = self._typedef_types()
        first = types.groupBy("file", "stmt_id").agg(F.min("type_at").alias("type_at"))
        enums = types.join(first, ["file", "stmt_id", "type_at"]).where("type_name = 'enumeration'").withColumn("s", self._ex("types/", F.col("name")))
        values = self.stmts.where("keyword = 'enum' AND arg <> ''").select("file", F.col("parent_id").alias("type_id"), F.col("stmt_id").alias("value_id"), F.col("arg").alias("value"))
        values = enums.select("file", "type_id", "s").join(values, ["file", "type_id"]).join(self.facts.select("file", F.col("stmt_id").alias("value_id"), "description"), ["file", "value_id"], "left")
        return T.triple_set(
            T.emit(enums, F.col("s"), T.iri(T.TYPE, T.CLASS), T.text(T.LABEL, F.col("name"))),
            T.emit(values, F.concat_ws("/", "s", "value"), T.iri(T.TYPE, T.INDIVIDUAL), T.iri(T.TYPE, F.col("s")), T.text(T.LABEL, F.col("value")), T.text(T.COMMENT, F.col("description"))),
        )

    def shapes(self) -> DataFrame:
        types = self._typedef_types()
        barred = types.where("type_name IN ('enumeration', 'union')").select("file", "stmt_id").distinct()
        defs = self.top.where("keyword = 'typedef' AND arg IS NOT NULL").select("file", "stmt_id", F.col("arg").alias("name")).join(barred, ["file", "stmt_id"], "left_anti").withColumn("s", self._ex(F.col("name")))
        last = types.groupBy("file", "stmt_id").agg(F.max_by("type_name", "type_at").alias("type_name"))
        known = Y.resolve_types(defs.join(last, ["file", "stmt_id"], "left"), self.typedefs, "type_name", ["file", "stmt_id"])
        facets = self.stmts.where("keyword IN ('pattern', 'range', 'length')").select("file", F.col("parent_id").alias("type_id"), F.col("keyword").alias("facet"), F.coalesce("arg", F.lit("")).alias("value"), "ordinal")
        facets = types.join(defs.select("file", "stmt_id", "s"), ["file", "stmt_id"]).join(facets, ["file", "type_id"])
        hulls = facets.where("facet <> 'pattern'").groupBy("s", "file", "stmt_id", "facet").agg(F.max_by("value", F.struct("type_at", "ordinal")).alias("value")).withColumn("h", N.range_hull(F.col("value")))
        length, range_ = F.col("facet") == "length", F.col("facet") == "range"
        return T.triple_set(
            T.emit(known, F.col("s"), T.iri(T.TYPE, T.SH + "NodeShape"), T.text(T.LABEL, F.col("name")), T.iri(T.SH + "datatype", F.col("resolved"))),
            T.emit(facets.where("facet = 'pattern'"), F.col("s"), T.text(T.SH + "pattern", F.col("value"))),
            T.emit(hulls, F.col("s"), T.number(T.SH + "minLength", F.when(length, F.col("h.low"))), T.number(T.SH + "maxLength", F.when(length, F.col("h.high"))), T.number(T.SH + "minInclusive", F.when(range_, F.col("h.low"))), T.number(T.SH + "maxInclusive", F.when(range_, F.col("h.high")))),
        )

    def triples(self) -> DataFrame:
        """The whole graph, as a set."""
        prov = self.provenance()
        graph = cut(T.triple_set(
            self.grouping_classes(), self.inner_nodes(prov), self.leaf_nodes(prov), self.members(), self.disjoint_cases(), self.stubs(),
            self.containment(prov), self.ghosts(), self.identities(), self.operations(), self.enumerations(), self.shapes(),
        ))
        return T.triple_set(graph, T.cardinality_default(graph))


def compile_model(stmts: DataFrame, base_uri: str = "http://example.org/ontology/") -> DataFrame:
    return SchemaGraph(stmts, base_uri).triples()
