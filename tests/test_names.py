"""Golden cases of the normalisers."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import names as N

CASES = [
    (N.strict_norm, "广州市执信中学（执信路校区）", "执信中学执信路校区"),
    (N.strict_norm, "广东实验中学越秀学校(天胜校区)", "广东实验中学越秀学校天胜校区"),
    (N.strict_norm, "广州 市第 一中学", "广州市第一中学"),
    (N.loose_norm, "学校", ""),
    (lambda c: N.loose_norm(c, keep_one=True), "学校", "学校"),
    (N.percentage, "特控率60%", 60.0),
    (N.percentage, "超75%", 75.0),
    (N.percentage, "九成", 90.0),
    (N.percentage, "提升4%", None),
    (N.percentage, "没有", None),
    (N.chinese_ordinal, "113中学", "第一一三中学"),
    (N.chinese_ordinal, "89中", "第八十九中"),
    (N.chinese_ordinal, "10中", "第十中"),
    (N.chinese_ordinal, "0中", "0中"),
    (N.chinese_number, "十一", 11),
    (N.chinese_number, "十", 10),
    (N.chinese_number, "七", 7),
    (N.chinese_number, "百", 0),
    (N.group_label, "第 三 组", "电脑派位第3组"),
    (N.group_label, "1组电脑派位", "电脑派位第1组"),
    (N.group_label, "电脑派位", "电脑派位"),
    (N.match_norm, "白云区第七中学", "白云第七中学"),
    (N.match_norm, "广州市白云广大附中实验中学", "广大附中实验中学"),
    (N.match_norm, "广州中学", "广州中学"),
    (N.match_norm, "某中学(建设中)", "某中学"),
    (N.match_norm, "甲小学(拟建)", "甲小学"),
    (N.match_norm, "甲小学（暂停营业）", "甲小学"),
    (N.strip_generic, "越秀附属中学", "越秀"),
    (N.short_name, "广州大学附属中学", "广州大学附属中学"),
    (N.short_name, "广州市第六中学", "第六中学"),
    (N.strip_generic, "白云广大附中实验中学", "白云广大附中"),
    (N.strip_generic, "XX(小学部)", "XX"),
    (N.strip_project, "铁一中学（越秀校区）（舞蹈）", "铁一中学（越秀校区）"),
    (N.strip_project, "铁一中学（越秀校区", "铁一中学"),
    (N.fold_unicode, "Ａ學校", "A学校"),
    (N.repair_name, "市广\n东仲元中学", "广东仲元中学"),
    (N.repair_name, None, ""),
    (N.strip_list_numbers, "1.凡小区； 3.市桥富豪", "凡小区；市桥富豪"),
    (N.strip_joiner, "方案。、房地产", "方案。房地产"),
    (N.strip_attachments, "甲（见附件3）乙附件1 #2 丙", "甲乙丙"),
    (N.dash_as_null, "—", None),
    (N.digits_only, " 12 ", 12),
    (N.campus_short, "某校（石牌校区）", "石牌"),
    (N.repair_suffix, "执信中学（执信路校区，“领军龙”学校）", "执信中学（执信路校区）"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_golden(spark, k):
    f, text, want = CASES[k]
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(f(F.col("s")).alias("out")).first().out == want


def test_variants_and_similarity(spark):
    df = spark.createDataFrame([("113 中学（本部）", "abcd", "abxd")], "s string, a string, b string")
    out = df.select(N.name_variants(F.col("s")).alias("v"), N.similarity("a", "b").alias("r"), N.near_distance(F.col("a"), F.lit("a")).alias("d")).first()
    assert out.v[:2] == ["113 中学（本部）", "113 中学"] and out.v[-1] == "第一一三 中学"
    assert out.r == 0.75 and out.d == 9


def test_rounding(spark):
    df = spark.createDataFrame([(2.5, -2.5)], "a double, b double")
    r = df.select(geo.round_half_up(F.col("a"), 0), geo.round_half_up(F.col("b"), 0), geo.round_half_even(F.col("a"), 0)).first()
    assert tuple(r) == (3.0, -2.0, 2.0)
