"""Whole answers, worked by hand."""

from ferrovia.operators import answers

KIND = "train_code string, train_class string, from_station string, to_station string, stations array<string>, station_details array<struct<name:string,arrive:string,depart:string,no:int>>"


def _tables(spark):
    details = spark.createDataFrame([("G1", "高速", "甲", "乙", ["甲", "乙"], [("甲", "", "08:00", 1), ("乙", "09:00", None, 2)])], KIND)
    basic = spark.createDataFrame([("G1", "高速", "甲", "乙", ["甲", "乙"], None), ("K2", None, "甲", "乙", list("甲bcdef乙"), None), ("D3", "动车", "甲", "乙", ["甲", "乙"], None), ("G9", "x", "乙", "丙", None, None)], KIND)
    return details, basic


G1 = "🚄 G1 (高速)\n  起讫站: 甲 → 乙\n  经停 2 站:\n    1. 甲 到:---- 发:08:00\n    2. 乙 到:09:00 发:----"


def test_train_info_answers(spark):
    asked = [(1, [" g1", "x7", None, "d3 ", "x8"]), (2, []), (3, None), (4, ["q"]), (5, ["G1", "g1"])]
    got = {r[0]: r[1] for r in answers.train_info_answers(spark.createDataFrame(asked, "question long, codes array<string>"), *_tables(spark)).collect()}
    d3 = "🚄 D3 (动车)\n  起讫站: 甲 → 乙\n  经停 2 站:\n    1. 甲\n    2. 乙"
    assert got == {1: f"{G1}\n\n{d3}\n\n\n❌ 未找到以下车次信息: X7, X8", 2: "未找到任何车次信息", 3: "未找到任何车次信息", 4: "\n❌ 未找到以下车次信息: Q", 5: f"{G1}\n\n{G1}"}


def test_route_answers(spark):
    asked = spark.createDataFrame([("甲", "乙"), ("甲", "乙"), ("乙", "甲"), (None, "乙")], "from_station string, to_station string")
    got = {tuple(r[:2]): r[2] for r in answers.route_answers(asked, *_tables(spark)).collect()}
    d3 = "🚄 D3 (动车)\n  起讫站: 甲 → 乙\n  经停 2 站: 甲 → 乙"
    k2 = "🚄 K2 ()\n  起讫站: 甲 → 乙\n  经停 7 站: 甲 → b → c → d → e ... → 乙"
    assert got == {("甲", "乙"): f"从「甲」到「乙」的 3 个车次:\n{G1}\n\n{d3}\n\n{k2}", ("乙", "甲"): "未找到从「乙」到「甲」的车次。"}
    assert answers.route_answers(asked.limit(0), *_tables(spark)).count() == 0
