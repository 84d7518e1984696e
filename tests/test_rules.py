import pytest
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import money, rules


def _row(spark, **values):
    base = {"value_score": 0.0, "extraction_status": "ok", "category": "text", "error": None, "credentials": 0.0, "personal": 0.0, "financial_legal": 0.0, "original_work": 0.0, "irreplaceable": 0.0}
    v = base | values
    p = (v["credentials"], v["personal"], v["financial_legal"], v["original_work"], v["irreplaceable"], None)
    return spark.createDataFrame([(p, v["value_score"], v["extraction_status"], v["category"], v["error"])], f"probabilities {S.PROBABILITIES}, value_score double, extraction_status string, category string, error string")


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({"value_score": 2.0}, True),
        ({"value_score": 1.99}, False),
        ({"value_score": 2.5, "error": "x"}, False),
        ({"value_score": 2.5, "category": "generated"}, False),
        ({"value_score": 2.9, "extraction_status": "no_text"}, False),
        ({"value_score": 2.9, "extraction_status": None}, False),
        ({"value_score": 2.9, "extraction_status": "ocr"}, True),
        ({"credentials": 0.7, "extraction_status": "no_text"}, True),
        ({"personal": 0.7, "extraction_status": None}, True),
        ({"financial_legal": 0.69}, False),
        ({"irreplaceable": 0.7}, True),
        ({"irreplaceable": 0.9, "extraction_status": "no_text"}, False),
        ({"original_work": 1.0}, False),
        ({"value_score": None, "credentials": None, "personal": 0.8}, True),
        ({"value_score": None, "credentials": None}, False),
    ],
)
def test_inclusion(spark, values, expected):
    assert _row(spark, **values).select(rules.is_included()).first()[0] is expected


def test_categories_and_labels(spark):
    assert [rules.category_of(e) for e in ("TXT", "py", "pdf", "png", "zip", "mp3", "unity", "xyz", "")] == ["text", "code", "doc", "image", "archive", "av", "generated", "binary", "binary"]
    got = spark.createDataFrame([("TXT",), ("zz",)], "e string").select(rules.categorize(F.col("e"))).collect()
    assert [r[0] for r in got] == ["text", "binary"]
    labels = spark.createDataFrame([(None,), ("ok",), ("ocr",), ("timeout",)], "s string").select(rules.verified_label(F.col("s"))).collect()
    assert [r[0] for r in labels] == ["unknown", "content", "ocr", "name-only"]


def test_top_category_takes_the_first_of_equals(spark):
    assert _row(spark, personal=0.5, original_work=0.5).select(rules.top_category()).first()[0] == "personal"
    none = _row(spark, credentials=None, personal=None, financial_legal=None, original_work=None, irreplaceable=None)
    assert none.select(rules.top_category()).first()[0] == "-"


def test_skip_rules():
    assert rules.skips_dir("Node_Modules", []) and rules.skips_dir("Local", ["x", "AppData"]) and rules.skips_dir("log", ["var"])
    assert not rules.skips_dir("mail", ["var"]) and not rules.skips_dir("Local", ["x"]) and not rules.skips_dir("etc", [])
    assert rules.skips_beside("target", {"cargo.toml"}) and rules.skips_beside("obj", {"a.csproj"}) and not rules.skips_beside("build", {"readme"})


def test_sizes_and_tokens(spark):
    row = spark.range(1).select(
        rules.format_size(F.lit(512)).alias("a"), rules.format_size(F.lit(2048)).alias("b"), rules.format_size(F.lit(5 << 20)).alias("c"),
        money.tokens(F.lit(400)).alias("t"), money.tokens(F.lit(0)).alias("z"), money.worst_tokens(F.lit(400)).alias("w"), money.cost(F.lit(1e6)).alias("m"),
    ).first()
    assert tuple(row) == ("512B", "2KB", "5MB", 100, 1, 200, pytest.approx(0.042))


def test_sizes_of_every_unit(spark):
    sizes = [1000000, 5 << 19, 5 << 29, 1 << 40, 5 << 39, 7 << 39, 3 << 50]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(rules.format_size(F.col("n"))).collect()
    assert [r[0] for r in got] == ["977KB", "2MB", "2GB", "1TB", "2TB", "4TB", "3072TB"]  # halves to even


def test_sniff_gate(spark):
    rows = [("binary", "key", 10), ("binary", "sqlite", 10), ("binary", "", S.SNIFF_CEILING), ("binary", "", S.SNIFF_CEILING + 1), ("text", "txt", 10)]
    got = spark.createDataFrame(rows, "c string, e string, s long").select(rules.is_sniffed(F.col("c"), F.col("e"), F.col("s"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False]
