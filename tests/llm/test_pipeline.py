import corpus_pipeline as cp
from graphloom.llm.decontaminate import find_leaks
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.rule_quality import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_what_they_should(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in docs.select("doc_id").collect()}
        kept = {r[0] for r in out.select("doc_id").collect()}
        if i < len(cp.STAGES) - 1:
            assert out.columns == COLUMNS
        if name == "quality":
            want = {r[0] for r in score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").select("doc_id").collect()}
        elif name == "near_dedup":
            want = {r[0] for r in near_duplicates(docs).where("kept").select("doc_id").collect()}
        elif name == "decontamination":
            want = ids - {r[0] for r in find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").collect()}
        else:
            want = ids
        assert kept == want, name
        docs = out
    assert cp.run(spark, sf).count() == docs.count()


def test_stage_edges(spark, sf):
    rows = [(1, None, "en", None, None, 5), (2, "", None, "s", 0, 5), (3, "a b c d e f g", "en", "s", 13, 5), (3, "a b c d e f g", "en", "s", 13, 5), (None, "a b c d e f g", "en", "s", 13, 5), (4, "a@b.c", "en", "s", 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    by = dict(cp.STAGES)
    assert by["quality"](spark, df, sf).columns == df.columns
    kept = sorted(r["doc_id"] or 0 for r in by["near_dedup"](spark, df, sf).collect())
    assert kept == [1, 2, 3, 4]
    more = df.unionByName(spark.createDataFrame([(3, "h i j k l m n o", "en", "s", 13, 5), (None, "p q r s t u", "en", "s", 13, 5), (9, "p q r s t u", "en", "s", 13, 5)], df.schema))
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in by["near_dedup"](spark, more, sf).collect())
    assert kept == [(1, ""), (2, ""), (3, "a b c d e f g"), (3, "h i j k l m n o"), (4, "a@b.c"), (9, "p q r s t u")]
    assert by["decontamination"](spark, df, sf).count() == 6
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    leaky = spark.createDataFrame([(None, leak, "en", "s", 13, 5), (1, leak, "en", "s", 13, 5), (1, "clean text", "en", "s", 13, 5)], df.schema)
    assert [r["text"] for r in by["decontamination"](spark, leaky, sf).collect()] == ["clean text"]
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in by["pii"](spark, df, sf).collect()}
    assert clean[4] == ("[EMAIL]", 7) and clean[1] == (None, None) and clean[2] == ("", 0)
    assert by["packing"](spark, df, sf).count() == 6
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0
