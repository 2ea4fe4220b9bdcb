import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("mention", "kind", "expected"),
    [
        ("smecta 2 gói", L.DRUG, "smecta ói"),
        ("  Amlodipine 5mg ", L.DRUG, "amlodipine"),
        ("Panadol **** 500 mg/ml", L.DRUG, "panadol"),
        ("tiểu đường tuýp 2", L.DIAGNOSIS, "đái tháo đường không phụ thuộc insuline"),
        ("Bệnh nhân bị viêm phổi, không đặc hiệu", L.DIAGNOSIS, "viêm phổi"),
        ("Cao huyết áp", L.DIAGNOSIS, "tăng huyết áp"),
        ("ho  khan", L.SYMPTOM, "ho  khan"),
    ],
)
def test_normalize_mention(spark, mention, kind, expected):
    assert one(spark, X.normalize_mention(F.col("x"), F.lit(kind)), mention) == expected


def test_marks_and_forms(spark):
    assert one(spark, X.strip_marks("x"), "Tiểu đường") == "Tieu đuong"
    assert one(spark, X.nfc("x"), unicodedata.normalize("NFD", "Tiểu")) == "Tiểu"
    assert one(spark, X.strip(F.col("x")), "  a b\n") == "a b"


def test_codes_and_glue(spark):
    df = spark.createDataFrame([(["A1*", "", "B2†", None],)], "c array<string>")
    assert df.select(X.clean_codes(F.col("c")).alias("c")).first()["c"] == ["A1", "B2"]
    assert one(spark, X.split_glued(F.col("x")), "BịChảy máu, ĐAUĐẦU") == "bị chảy máu, đau đầu"


def test_entities_from_answers(spark):
    fenced = '```json\n[{"text": "a", "type": "THUỐC", "position": [1, 2]}]\n```'
    assert [e["text"] for e in one(spark, X.parse_entities(F.col("x")), fenced)] == ["a"]
    assert one(spark, X.parse_entities(F.col("x")), "no json") == []
    around = 'Sure: [{"text": " a ", "type": "THUỐC", "assertions": ["isNegated", "other"]}, {"text": "b", "type": "?"}] done'
    found = one(spark, X.valid_entities(X.parse_embedded_entities(F.col("x"))), around)
    assert [(e["text"], e["assertions"], e["candidates"]) for e in found] == [("a", ["isNegated"], [])]
    assert one(spark, X.parse_embedded_entities(F.col("x")), "[cut") == []


def test_prompt_document_and_false_positives(spark):
    assert one(spark, X.quoted_document(F.col("x")), 'read """ the text """ now') == "the text"
    assert one(spark, X.quoted_document(F.col("x")), "nothing") == "nothing"
    assert one(spark, X.is_false_positive(F.col("x")), "Ngày 12") is True
    assert one(spark, X.is_false_positive(F.col("x")), "ho khan") is False
    assert one(spark, X.plain_words(F.col("x")), "A, b-c\n d!") == ["a", "bc", "d"]


def test_dose_pattern_matches_the_plain_rule(spark):
    rule = re.compile(r"[\d.,]+\s*(mg|ml|mcg|g|iu|%|viên|ống|gói)(/\s*(ml|kg|m2))?", re.IGNORECASE)
    for text in ["1 gram", "0.4 MG/ML x", "5%", "10 Viên 2 ống", "no dose"]:
        assert one(spark, X.strip_dose(F.col("x")), text) == rule.sub("", text)
