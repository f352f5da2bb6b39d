from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from fathomlake.functions import extract, rules
from fathomlake.functions.text import content_tokens, first_words, fold, has_marks, strip_marks


def one(spark, c, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(c(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("Đăng ký KẾT HÔN, lệ phí?", "dang ky ket hon le phi"), ("  Thủ tục – khai sinh!  ", "thu tuc khai sinh"), ("", ""), (None, "")])
def test_fold(spark, text, want):
    assert one(spark, fold, text) == want
    assert one(spark, fold, unicodedata.normalize("NFD", text) if text else text) == want


def test_marks(spark):
    assert one(spark, has_marks, "đá") and one(spark, has_marks, "Đ") and not one(spark, has_marks, "da ?")
    assert one(spark, strip_marks, "Đường PHỐ.") == "Duong PHO."
    assert one(spark, content_tokens, "tôi có gì") == ["toi", "co", "gi"]
    assert one(spark, content_tokens, "tôi khai sinh") == ["khai", "sinh"]
    assert one(spark, first_words, "một hai ba bốn năm sáu bảy") == "một hai ba bốn năm sáu"


@pytest.mark.parametrize(("text", "want"), [("", "hello"), ("a", "hello"), ("hi", "hello"), ("??", None), (None, "hello"), ("Bạn là ai?", "who"), ("cảm ơn", "thanks"), ("xem đất", None)])
def test_small_talk(spark, text, want):
    assert one(spark, rules.small_talk, text) == want


def test_traffic_is_a_substring_test(spark):
    assert one(spark, rules.is_traffic, "xem lịch")


@pytest.mark.parametrize(("text", "days", "vnd"), [("Từ 03 - 05 ngày làm việc", 5, None), ("Giải quyết ngay trong ngày làm việc", 1, None), ("Theo quy định hiện hành", None, None), ("Miễn phí", None, 0), ("50.000 đồng", 0, 50000), ("1.000.000đ", None, 1000000), ("50000đ", None, None)])
def test_numbers(spark, text, days, vnd):
    if days is not None or "quy định" in text:
        assert one(spark, extract.duration_days, text) == days
    assert one(spark, extract.fee_vnd, text) == vnd


def test_levels_and_once(spark):
    assert one(spark, extract.admin_level, "", "Công an xã") == "Cấp Xã"
    assert one(spark, extract.admin_level, "", "x") == "Cấp Tỉnh"
    assert one(spark, lambda c: extract.once(F.split(c, ",")), "a,B,A,b,c") == ["a", "B", "c"]
