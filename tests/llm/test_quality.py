"""Counts over every trusted document."""

from canopyrank.llm import quality


def test_every_trusted_document_counts(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "'word' AS text")
    counts = [20_500] + [0] * (quality.BUCKETS - 1)
    assert sorted(quality.weights(docs, docs.filter("doc_id < 20400"))) == sorted(quality.log_ratios(counts, [20_400] + counts[1:]))


def test_weights_are_the_same_without_a_broadcast(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a', id % 7, ' b', id % 11) AS text").union(spark.sql("SELECT CAST(NULL AS LONG), 'a1 c'"))
    good = docs.filter("doc_id % 3 = 0").union(docs.filter("doc_id = 3"))
    assert quality.weights(docs, good, most=10) == quality.weights(docs, good)
