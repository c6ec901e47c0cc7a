"""YANG types and what they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .triples import RDFS, XSD

#: Range of a datatype property for each built-in or well-known type.
BUILTIN = {
    "binary": XSD + "hexBinary",
    "bits": RDFS + "Literal",
    "boolean": XSD + "boolean",
    "decimal64": XSD + "decimal",
    "empty": XSD + "boolean",
    "enumeration": RDFS + "Literal",
    "int8": XSD + "byte",
    "int16": XSD + "short",
    "int32": XSD + "int",
    "int64": XSD + "long",
    "string": XSD + "string",
    "uint8": XSD + "unsignedByte",
    "uint16": XSD + "unsignedShort",
    "uint32": XSD + "unsignedInt",
    "uint64": XSD + "unsignedLong",
    "inet:ip-address": XSD + "string",
    "yang:date-and-time": XSD + "dateTime",
    "yang:counter32": XSD + "unsignedInt",
    "yang:counter64": XSD + "unsignedLong",
    "inet:uri": XSD + "anyURI",
}


def builtin_map() -> Column:
    return F.create_map(*(F.lit(x) for kv in BUILTIN.items() for x in kv))


def leaf_kind(type_name: Column, is_union: Column) -> Column:
    """Which of the five forms a leaf takes; the order matters."""
    return (
        F.when(type_name == "identityref", "identityref").when(type_name == "leafref", "leafref").when(is_union, "union")
        .when(type_name == "instance-identifier", "instance-identifier").when(type_name.isNotNull(), "regular")
    )


def builtin_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUILTIN.items()), "name string, iri string")


def resolve_types(rows: DataFrame, typedefs: DataFrame, type_col: str, row_id: list[str], at: str | None = None) -> DataFrame:
    """Add ``resolved``: the XSD type at the end of each type's typedef chain, xsd:string if it leads nowhere.

    ``typedefs`` is (name, base_type, order); with ``at``, a hop sees the latest
    definition registered before the row, else the last one. Chains may have any
    length; those that never end (definitions in a circle) fail.
    """
    from ..plans.durable import cut

    if "order" not in typedefs.columns:
        typedefs = typedefs.withColumn("order", F.array(F.lit(0)))
    state = rows.select(*row_id, *([at] if at else []), F.col(type_col).alias("__t"))
    found, hop, names = None, 0, None
    while True:
        state = cut(state.withColumn("__iri", builtin_map()[F.col("__t")]))
        done = state.where("__iri IS NOT NULL").select(*row_id, F.col("__iri").alias("resolved"))
        found = done if found is None else found.unionByName(done)
        state = state.where("__iri IS NULL").drop("__iri")
        if state.isEmpty():
            break
        if hop == 8:  # a chain without a circle has no more hops than there are definitions
            names = typedefs.count()
        if names is not None and hop > names:
            raise RecursionError(f"typedefs refer to each other in a circle: {state.first()['__t']!r} is one of them")
        hop += 1
        on = F.col("__t") == F.col("name")
        if at:
            on = on & (F.col("order") < F.col(at))
        state = state.join(typedefs, on).groupBy(*row_id, *([at] if at else [])).agg(F.max_by("base_type", "order").alias("__t"))
    return rows.join(found, row_id, "left").withColumn("resolved", F.coalesce("resolved", F.lit(XSD + "string")))
