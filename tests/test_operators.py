import pytest

from graphloom.operators import registry as R
from graphloom.operators import types as Y
from graphloom.operators.triples import XSD


def test_long_typedef_chains_and_circles(spark):
    defs = [(f"t{i}", f"t{i + 1}") for i in range(40)] + [("t40", "uint8"), ("lost", "nowhere")]
    rows = spark.createDataFrame([(1, "t0"), (2, "t39"), (3, "lost"), (4, "int8"), (5, None)], "id int, t string")
    got = {r["id"]: r["resolved"] for r in Y.resolve_types(rows, spark.createDataFrame(defs, "name string, base_type string"), "t", ["id"]).collect()}
    assert got == {1: XSD + "unsignedByte", 2: XSD + "unsignedByte", 3: XSD + "string", 4: XSD + "byte", 5: XSD + "string"}
    with pytest.raises(RecursionError):
        Y.resolve_types(rows, spark.createDataFrame([("t0", "a"), ("a", "b"), ("b", "a")], "name string, base_type string"), "t", ["id"])


def test_closure_counts_pairs_and_ends_on_circles(spark):
    ladder = [(f"{s}{i}", f"{t}{i + 1}") for i in range(20) for s in "ab" for t in "ab"]
    got = {(r["node"], r["ancestor"]): r["depth"] for r in R.closure(spark.createDataFrame(ladder, "child string, parent string")).collect()}
    assert got == {(f"{s}{i}", f"{t}{j}"): j - i for i in range(20) for j in range(i + 1, 21) for s in "ab" for t in "ab"}
    circle = R.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 1)], "child int, parent int")).collect()
    assert {tuple(r) for r in circle} == {(a, b, (b - a - 1) % 3 + 1) for a in (1, 2, 3) for b in (1, 2, 3)}
    assert R.closure(spark.createDataFrame([], "child int, parent int")).collect() == []


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    from graphloom.plans import durable

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(*_):
                    return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.cut(Frame())
