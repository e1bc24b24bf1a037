"""Texts that only a stricter normal form tells apart."""

from pyspark.sql import functions as F

from tallyline.operators import curation


def test_overlap_by_lower_case_keeps_signs_and_letters_apart(spark):
    texts = spark.createDataFrame([(1, "Wie geht's?"), (2, "wie gehts"), (3, "東京"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([("WIE GEHT'S?",), ("東京",), ("",)], "text string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(curation.overlapping(texts, items, same=F.lower)) == [1, 3, 4]
    assert ids(curation.overlapping(texts, items)) == [1, 2]
