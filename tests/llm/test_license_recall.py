"""Every document of the test tables that holds licence wording is found, and no others."""

from pyspark.sql import functions as F

from lexiquarry.llm import licenses

#: What the tables' licence lines say.
WORDING = r"(?i)licensed under|released under the|all rights reserved|spdx-license|permission is hereby granted|public license"


def test_all_rights_reserved_lines_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = licenses.scan(docs, licenses.train(docs)).where(F.size("licenses") > 0)
    got = {r["doc_id"] for r in found.collect()}
    want = {r["doc_id"] for r in docs.where(F.col("text").rlike(WORDING)).select("doc_id").collect()}
    assert len(want) > 40 and got == want
