import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txmetrics.functions import text as tx
from txmetrics.functions.columns import distinct_values, to_number
from txmetrics.functions.responses import explode_lines, structured_text, vision_text


def apply(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_whitespace_set_is_complete():
    assert set(tx.WHITESPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_collapse_agree_with_python(spark):
    values = [" a\t", "\u00a0x\u3000", "\x1cy\x1f", "  hello   \t  world ", "line1\n  line2\n", "", " ", "a\x85b", "a\u2009\u00a0b", None]
    assert apply(spark, values, tx.strip) == [v if v is None else v.strip() for v in values]
    assert apply(spark, values, tx.collapse_whitespace) == [v if v is None else " ".join(v.split()) for v in values]


def test_null_tokens_match_before_stripping(spark):
    values = ["NA", "null", "None", "", " NA ", "n/a", "ok", "nan"]
    assert apply(spark, values, tx.null_tokens) == [None, None, None, None, " NA ", None, "ok", None]


@pytest.mark.parametrize("form", tx.UNICODE_FORMS)
def test_unicode_forms(spark, form):
    values = ["e\u0301", "\ufb01", "plain", "\u0f71\u0f72", "\u2003x", None]
    expected = [v if v is None else unicodedata.normalize(form, v) for v in values]
    assert apply(spark, values, lambda c: tx.unicode_normalise(c, form)) == expected


def test_normalise_order_and_defaults(spark):
    assert apply(spark, ["  he\u0301  llo "], lambda c: tx.normalise(c, whitespace=True, unicode_form="NFC")) == ["h\u00e9 llo"]
    # compatibility forms can create spaces, so they come before whitespace
    assert apply(spark, ["a\u00a0\u2003b"], lambda c: tx.normalise(c, whitespace=True, unicode_form="NFKC")) == ["a b"]
    assert apply(spark, ["  x ", None], tx.normalise) == ["  x ", ""]
    with pytest.raises(ValueError):
        tx.unicode_normalise(F.lit("x"), "NFX")


def test_script_cleanup(spark):
    values = ["\u0f40\u0f0b\u0f0b\u0f0b\u0f41", "\u0f40\u0f0b\u0f0d", "\u0f40\u200b\u0f0b\u200b\u0f0b\u0f0d"]
    assert apply(spark, values, tx.clean_script) == ["ཀ་ཁ", "ཀ།", "ཀ།"]


def test_names(spark):
    names = ["a.png", "a.b.tif", ".hidden", "plain", "x.", "dir.d/y.JPG"]
    assert apply(spark, names[:5], tx.stem) == ["a", "a.b", ".hidden", "plain", "x."]
    assert apply(spark, names, tx.suffix) == [".png", ".tif", "", "", "", ".jpg"]
    assert apply(spark, names, lambda c: tx.mime_type(c))[:2] == ["image/png", "image/tiff"]
    assert apply(spark, ["x.xyz"], tx.mime_type) == ["application/octet-stream"]
    assert apply(spark, [" a b/c\\d "], tx.safe_name) == ["a_b_c_d"]


def test_numbers(spark):
    values = ["1.5", " 2 ", "1e-3", "x", "1d", "", None, "-.5", "inf"]
    assert apply(spark, values, to_number) == [1.5, 2.0, 0.001, None, None, None, None, -0.5, float("inf")]


def test_distinct_values_is_bounded(spark):
    frame = spark.range(5).selectExpr("cast(id AS string) AS m")
    assert distinct_values(frame, "m") == list("01234")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError):
            distinct_values(frame, "m")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


LINE = '{"raw_transcription":"%s","normalized_text":"n","confidence_score":%s,"orientation":"horizontal","bounding_box":[1,2,3,4]}'


def test_structured_text(spark):
    good = '{"lines":[' + LINE % ("a", "0.5") + "," + LINE % ("b", "1") + "]}"
    out_of_range = '{"lines":[' + LINE % ("a", "2") + "]}"
    incomplete = '{"lines":[{"raw_transcription":"a"}]}'
    values = [good, out_of_range, "not json", '{"lines":[]}', incomplete, "{}"]
    assert apply(spark, values, structured_text) == ["a\nb", out_of_range, "not json", "", incomplete, "{}"]
    pages = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id INT, response STRING")
    lines = explode_lines(pages).orderBy("line_no").collect()
    assert [(r.id, r.line_no, r.raw_transcription, r.confidence_score) for r in lines] == [(0, 0, "a", 0.5), (0, 1, "b", 1.0)]


LOOSE = '{"raw_transcription":%s,"normalized_text":"n","confidence_score":%s,"orientation":"h","bounding_box":%s}'


def page(*fields, after=""):
    return '{"lines":[' + LOOSE % fields + "]}" + after


def test_structured_text_is_strict(spark):
    accepted = {
        page('"a"', "1", "[]"): "a", page('"a"', '"0.5"', "[1]"): "a", page('"a"', "0.5", '[1.0, "7", 99999999999]'): "a",
        page('"x\\ny"', "0.5", "[1]"): "x\ny", '{"lines":[],"more":1}': "", "  " + page('"a"', "0.5", "[1]") + "\n": "a",
    }
    refused = [
        page("5", "0.5", "[1]"), page("true", "0.5", "[1]"), page('{"x":1}', "0.5", "[1]"), page("null", "0.5", "[1]"),
        page('"a"', "-0.1", "[1]"), page('"a"', '"high"', "[1]"), page('"a"', "null", "[1]"), page('"a"', "0.5", "[1.5]"),
        page('"a"', "0.5", "[null]"), page('"a"', "0.5", "1"), page('"a"', "0.5", "[1]", after=" x"),
        page('"a"', "0.5", "[1]") * 2, page('"a"', "0.5", "[1]") + "," + page('"a"', "0.5", "[1]"),
        "[" + page('"a"', "0.5", "[1]") + "]", '{"lines":null}', '{"lines":{}}', '{"lines":[null]}', "{'lines':[]}", '{"LINES":[]}', "", "[]",
        '{"lines":[' + LOOSE % ('"a"', "0.5", "[1]") + "," + LOOSE % ("1", "0.5", "[1]") + "]}",
    ]
    values = [*accepted, *refused]
    assert apply(spark, values, structured_text) == [*accepted.values(), *refused]


def test_vision_text(spark):
    values = ['{"fullTextAnnotation":{"text":" x\\n"}}', "{}", '{"fullTextAnnotation":{}}', "broken"]
    assert apply(spark, values, vision_text) == ["x", "", "", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_strip_property(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert apply(spark, values, tx.strip) == [v.strip() for v in values]
