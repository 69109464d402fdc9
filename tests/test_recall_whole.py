"""Recall of records whose words stand late in a long text."""

from loam.operators.multipass import recall


def test_words_behind_four_hundred_characters_count(spark):
    docs = spark.createDataFrame([(1, "x1 " * 200 + "storage quota", "2024-01-01"), (2, "storage " + "x1 " * 200, "2024-01-01"), (3, "x1 " * 200, "2024-01-01")], "doc_id long, content string, mtime string")
    assert [tuple(r) for r in recall(docs, "storage quota").collect()] == [(1, 2 / 3), (2, 1 / 3)]
