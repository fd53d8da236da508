"""The verdict tells whole words apart."""

from specsift.llm.quality_rules import judge_quality


def test_words_of_like_endings_differ(spark):
    text = lambda kind: " ".join(f"{kind}{i}xing" for i in range(40))
    rows = [(i, text("a" if i < 20 else "b")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = judge_quality(docs, docs.filter("doc_id < 10")).collect()
    good, other = ({r.log_ratio for r in judged if (r.doc_id < 20) == side} for side in (True, False))
    assert min(good) > max(other)
