from pyspark.sql import functions as F

from basepaths.llm import licenses as L


def test_no_short_notice_is_missed(spark):
    # one other word on each side: the window has Jaccard 1/2, and the bands lose about one in 1,000
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('w', id, ' v', id * 7, ' Released under the MIT License. x', id, ' y') as text")
    assert L.scan(docs).where("template = 'mit-notice'").count() == 20_000


def test_long_templates_still_go_through_the_bands(spark):
    long = " ".join(f"t{i}" for i in range(90))
    docs = spark.createDataFrame([(1, "a b c " + long + " d e"), (2, long[:150])], "doc_id long, text string")
    got = L.scan(docs, {"long": long, "short": "t3 t4 t5 t6 t7"}).collect()
    assert sorted((r.doc_id, r.template, r.containment) for r in got) == [(1, "long", 1.0), (1, "short", 1.0), (2, "short", 1.0)]


def test_short_templates_are_found_through_the_bands(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b Released under the MIT License. c d")], "doc_id long, text string")
    assert [r.template for r in L.scan(docs).collect()] == ["mit-notice"]
    asked = iter(range(100))
    never = lambda shingles, rows=L.ROWS: F.array(F.struct(F.lit(0).alias("band"), F.xxhash64(shingles, F.lit(next(asked))).alias("value")))
    monkeypatch.setattr(L, "bands", never)
    assert L.scan(docs).collect() == []
