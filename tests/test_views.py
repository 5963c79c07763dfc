"""Views and back-fills against cases written out."""

import json

from tessera.operators import feeds, graph
from tessera.plans import entities, linkage
from tessera.sources import tables


def test_reverse_backfill(spark):
    kind = "row int, id string, ids array<string>, mechanism string, scope map<string, array<string>>"
    rows = [
        (1, "m1", None, "zone", None), (2, "m1", ["m2"], "pool", {}), (3, None, ["m2", "m2"], "zone", None), (4, "m1", [], "zone", {"x": ["y"]}), (5, "m9", None, "zone", None), (6, None, None, "zone", None),
    ]
    feeds = [("p1", {"zone": ["m1"], "pool": ["m2", "m1"]}), ("p2", {"pool": ["m2"]}), ("p3", {"zone": ["m1", "m2"]}), ("p4", None)]
    names = [("p1", "甲小"), ("p2", "乙小"), ("p4", "丁小")]
    out = graph.reverse_backfill(spark.createDataFrame(rows, kind), spark.createDataFrame(feeds, "id string, by_mechanism map<string, array<string>>"), spark.createDataFrame(names, "id string, name string"))
    want = {1: {"甲小": ["p1"], "p3": ["p3"]}, 2: {"甲小": ["p1"], "乙小": ["p2"]}, 3: {"p3": ["p3"]}, 4: {"x": ["y"]}, 5: None, 6: None}
    assert {r.row: r.scope for r in out.collect()} == want


CAMPUSES = [("gz-1", "甲中学（东校区）", "甲中学", 0), ("gz-2", "甲中学（西校区）", "甲中学", 1), (None, "乙中学（花都校区）", "乙中学", 2), ("gz-4", "丁中学", "丁中学", 3)]
ENTITIES = [("gz-1", "甲中学(东校区)"), ("gz-2", "甲中学(西校区)"), ("gz-3", "丙中学"), ("gz-4", "丁中学")]


def _bases(spark):
    return spark.createDataFrame(CAMPUSES, "id string, name string, school string, ord int"), spark.createDataFrame(ENTITIES, "id string, name string")


def test_middle_linkage(spark):
    c, e = _bases(spark)
    quota = [("m", "gz-1", 2), ("m", "gz-2", 5), ("m", "gz-4", 0), ("m", "乙中学（花都校区）", 5), ("n", "gz-4", 1)]
    batch = [("m", "gz-1", 700, 0), ("m", "乙中学（花都校区）", 650, 1), ("m", "gz-3", 600, 2), ("m", "丁中学", 690, 3), ("m", "戊中学", None, 4)]
    district = [("m", "gz-3", 3, 0), ("m", "戊中学", 9, 1), ("m", "己中学", 3, 2)]
    places = [("甲中学(东校区)", "甲中学(东校区)"), ("乙中学", "错的"), ("丁中学", "丁中学"), ("己中学", "己中学本部")]
    frame = spark.createDataFrame
    out = linkage.middle_linkage(
        frame(quota, "middle string, key string, n int"), frame(batch, "middle string, key string, score int, ord int"), frame(district, "middle string, key string, n int, ord int"), c, e, frame(places, "name string, poi string")
    )
    got = sorted((r.middle, r.part, r.place, r.key, r.name, r.school, r.poi, r.n, r.score) for r in out.collect())
    assert got == [
        ("m", "batch", 1, "gz-2", "甲中学(西校区)", "甲中学", "甲中学(西校区)", 5, None),
        ("m", "batch", 2, "乙中学（花都校区）", "乙中学（花都校区）", "乙中学", None, 5, 650),
        ("m", "batch", 3, "gz-1", "甲中学(东校区)", "甲中学", "甲中学(东校区)", 2, 700),
        ("m", "batch", 4, "gz-4", "丁中学", "丁中学", "丁中学", None, 690),
        ("m", "district", 1, "戊中学", "戊中学", None, None, 9, None),
        ("m", "district", 2, "gz-3", "丙中学", None, "丙中学", 3, 600),
        ("m", "district", 3, "己中学", "己中学", None, "己中学本部", 3, None),
        ("n", "batch", 1, "gz-4", "丁中学", "丁中学", "丁中学", 1, None),
    ]


def test_high_linkage(spark):
    c, e = _bases(spark)
    coverage = [("gz-1", "m", None, 2, "越秀", 0), ("gz-1", "n", "gz-9", 4, "天河", 1), ("gz-2", "m", "gz-8", 3, "越秀", 2), ("gz-2", "m", "gz-7", 1, None, 3), ("gz-4", "m", None, 1, "番禺", 4)]
    coverage += [("gz-4", f"s{k:02}", None, 1, None, 10 + k) for k in range(40)]
    near = [("甲中学", "m", "gz-8", 6, 0), ("甲中学", "k", None, 7, 1), ("别的", "m", None, 1, 2)]
    targets = [(1, "甲中学（东校区）"), (2, "甲中学"), (3, "丁中学"), (4, "没有"), (5, None), (6, "乙中学")]
    frame = spark.createDataFrame
    out = linkage.high_linkage(
        frame(targets, "qid int, name string"), c, e, frame(coverage, "campus string, school string, school_id string, n int, area string, ord int"), frame(near, "target string, school string, school_id string, n int, ord int")
    )
    rows = {}
    for r in out.orderBy("place").collect():
        rows.setdefault((r.qid, r.part), []).append((r.school, r.school_id, r.n, r.areas))
    assert rows.pop((3, "quota")) == [("m", None, 1, ["番禺"])] + [(f"s{k:02}", None, 1, []) for k in range(29)]
    assert rows == {
        (1, "quota"): [("n", "gz-9", 4, ["天河"]), ("m", None, 2, ["越秀"])],
        (2, "quota"): [("m", "gz-8", 6, ["越秀"]), ("n", "gz-9", 4, ["天河"])],
        (2, "district"): [("k", None, 7, []), ("m", "gz-8", 6, [])],
    }


def test_plan_notes(spark):
    df = spark.createDataFrame([(1, ["领军龙", "体育后备人才基地"]), (2, ["领军龙计划", None]), (3, []), (4, None)], "k int, notes array<string>")
    assert {r.k: r.o for r in df.select("k", linkage.plan_notes("notes").alias("o")).collect()} == {1: ["reserve", "lingjun"], 2: ["lingjun"], 3: [], 4: []}


def test_place_card(spark):
    kind = (
        "name string, school_id string, area_name string, stages array<string>, main_stage string, ids map<string, string>, has_record boolean, scores array<struct<label: string, value: string>>, "
        "top_rate string, high_share string, classes int, zone string, route string, feeders array<string>"
    )
    rows = [
        ("甲 (东)", "gz-1", "越秀", ["primary", "middle"], "middle", {"primary": "gz-p"}, None, None, None, None, 4, "", "直升", ["a", "b", "c", "d"]),
        ("乙", "gz-2", None, ["middle"], "middle", {}, None, None, None, None, 9, "不算", "不算", None),
        ("丙", None, "天河", ["high"], "high", {"high": "gz-3"}, True, [("2026", "700")], "90%", None, None, None, None, None),
        ("丁", None, "", ["high"], "high", None, False, None, "80%", None, None, None, None, None),
    ]
    got = {r.name: ([tuple(x) for x in r.rows], r.note, [tuple(x) for x in r.links]) for r in linkage.place_card(spark.createDataFrame(rows, kind)).collect()}
    assert got["甲 (东)"] == (
        [("学部", "小学、初中", False), ("所在区", "越秀", False), ("2026班数", "4 个班", True), ("升学路线", "直升", False), ("生源小学", "a、b、c 等 4 所", True)],
        None,
        [("查看小学部详情 →", "/school/%E7%94%B2%20(%E4%B8%9C)?stage=primary&id=gz-p"), ("查看初中部详情 →", "/school/%E7%94%B2%20(%E4%B8%9C)?stage=middle")],
    )
    assert got["乙"][0] == [("学部", "初中", False), ("所在区", "—", False), ("生源小学", linkage.NO_FEEDERS, False)]
    assert got["乙"][2] == [("查看学校详情 →", "/school/%E4%B9%99?stage=middle")]
    assert got["丙"] == ([("2026", "700", False), ("特控线上线率 2026", "90%", False)], linkage.HIGH_NOTE, [("查看学校详情 →", "/school/%E4%B8%99?stage=high&id=gz-3")])
    assert got["丁"][:2] == ([("学部", "高中", False), ("所在区", "—", False)], linkage.NO_RECORD_NOTE)


def test_campus_lines(spark):
    records = [(1, ["a", "b"], "明德校区：甲小、乙小\n同德校区:丙小;丁小\n明德校区：戊小\n说明：无\n没有标签"), (2, ["c", "d"], " 南校区：己小 "), (3, ["b"], "南校区：己小"), (4, ["d"], "北校区：庚小"), (5, ["a"], None), (6, None, "明德校区：x")]
    entities = [("a", "六十五中学（明德校区）"), ("b", "六十五中学(同德校区)"), ("c", "竹料一中（北校区）"), ("d", "竹料一中")]
    out = feeds.campus_lines(spark.createDataFrame(records, "row int, ids array<string>, scope string"), spark.createDataFrame(entities, "id string, name string"))
    got = sorted((r.row, r.id, r.pos, r.name) for r in out.collect())
    assert got == [(1, "a", 0, "甲小"), (1, "a", 1, "乙小"), (1, "a", 2, "戊小"), (1, "b", 0, "丙小"), (1, "b", 1, "丁小"), (2, "d", 0, "己小")]


def test_group_plans(spark):
    groups = spark.createDataFrame([(1, ["甲", "乙 "]), (2, ["甲"]), (3, [])], "gid int, members array<string>")
    plan = spark.createDataFrame([("甲 ", 4), ("乙", 5), ("丙", 6)], "name string, plan int")
    got = {(r.gid, r.name, r.plan, r.mechanism, tuple(r.members or ())) for r in feeds.group_plans(groups, plan, "pool", "zone").collect()}
    assert got == {(1, "甲", 4, "pool", ("甲", "乙 ")), (1, "乙 ", 5, "pool", ("甲", "乙 ")), (2, "甲", 4, "pool", ("甲",)), (None, "丙", 6, "zone", ())}


def test_year_rows(spark):
    rows = [(1, "广州市一中（初中校区）"), (2, "一中"), (3, "旧名"), (4, "三中"), (5, "实体名"), (6, "六中"), (7, "另名")]
    queries = [(1, "一中"), (2, "新名"), (3, "三中（初中部）"), (4, "查无"), (5, "六中"), (6, "没有"), (7, None), (8, "")]
    other = [("新名", "另名", 1), ("新名", "旧名", 0), ("六中", "旧名", 0)]
    resolved = [(4, "实体名"), (4, "一中"), (5, "实体名")]
    frame = spark.createDataFrame
    out = feeds.year_rows(frame(queries, "qid int, name string"), frame(rows, "row int, name string"), frame(other, "name string, other string, ord int"), frame(resolved, "qid int, name string"))
    assert sorted((r.qid, r.row) for r in out.collect()) == [(1, 1), (1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6)]


def test_district_feeds(spark):
    frame = spark.createDataFrame
    entities = [("s1", "沙面小学(岭南校区)", ["沙面小学"], 0), ("s2", "沙面小学(御景校区)", [], 1), ("p1", "培正小学", [], 2), ("q1", "协和学校小学部", [], 3), ("r1", "民办小学", [], 4), ("t1", "新小学", [], 5)]
    e = frame([(i, n, a, "primary", "103", None, o) for i, n, a, o in entities], "id string, name string, aliases array<string>, stage string, area string, policy_area string, ord int")
    official = [
        (0, "沙面小学（岭南校区）", "103", 1, "中学甲", False, None), (1, "沙面小学", "103", 2, "中学丁", True, None), (2, "培正小学", "103", 2, "中学丙", True, False), (3, "协和学校小学部", "103", None, "协和", None, None),
        (4, "查无此校名", "103", 1, None, None, None), (5, "新小学", "103", 1, None, None, True),
    ]
    groups = [("103", 1, ["中学甲", "中学乙"]), ("103", 2, ["中学丙"])]
    points = [(i, n, "103") for i, n, _, _ in entities] + [("z", "别区小学", "999")]
    out = feeds.district_feeds(
        frame(official, "ord int, name string, area string, group_no int, direct string, direct_joins boolean, refused boolean"), frame(groups, "area string, group_no int, feed array<string>"), frame(points, "id string, name string, area string"),
        frame([("103", "民办小学", "民办")], "area string, name string, reason string"), e, frame([], "name string, id string"), {},
    )
    got = {(r.status, r.id, tuple(r.feed or ()), r.gap, r.official) for r in out.collect()}
    assert got == {
        ("record", "s1", ("中学甲", "中学乙"), None, "沙面小学（岭南校区）"), ("record", "s2", ("中学丁", "中学丙"), None, "沙面小学"), ("record", "p1", ("中学丙",), None, "培正小学"), ("record", "q1", ("协和",), None, "协和学校小学部"),
        ("gap", "r1", (), "民办", None), ("missing", "t1", (), None, None), ("unresolved", None, (), None, "查无此校名"), ("unresolved", None, (), None, "新小学"),
    }


def test_name_counts(spark):
    words = [(1, 0, 10.0, 30.0, "甲"), (1, 1, 20.0, 30.2, "中"), (1, 2, 190.0, 30.1, "12"), (1, 3, 200.0, 30.0, "7"), (1, 4, 400.0, 30.0, "x"), (1, 5, 190.0, 60.0, "abc"), (1, 6, 190.0, 90.0, "12345"), (1, 7, 10.0, 4.5, "a"), (1, 8, 185.0, 7.5, "3"), (2, 0, 1.0, 30.0, "乙")]
    out = tables.name_counts(spark.createDataFrame(words, "page int, o int, x double, y double, t string"), "page", "o", "x", "y", "t")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, "a", 3), (1, 10, "甲中", 7), (2, 10, "乙", None)]


def test_line_cache(spark, tmp_path):
    for name, lines in (("a", [{"x": 1, "y": 2.5, "text": "甲"}, {"x": 3, "y": 4}]), ("b", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(lines, indent=1), encoding="utf-8")
    assert [tuple(r)[1:] for r in tables.read_line_cache(spark, f"file://{tmp_path}/*.json").collect()] == [(0, 1.0, 2.5, "甲")]


def test_layouts(spark):
    layouts = {(2025, None): ({"school": 1, "award": 0, "area": 2}, 1), (2026, "middle"): ({"school": 0, "award": 1}, 0), (2026, None): ({"school": 2, "award": 0}, 2)}
    rows = [(2025, "high", 0, ["奖", "校", "区"]), (2025, "high", 1, [" 一 ", "甲", "越秀"]), (2025, "high", 2, ["一", " ", "越秀"]), (2026, "middle", 0, ["乙", "二"]), (2026, "high", 1, ["a", "b", "c"]), (2026, "high", 2, ["三", "b", "丙"]), (2026, "high", 3, ["三"]), (2024, "high", 9, ["x", "y", "z"])]
    out = tables.laid_out(spark.createDataFrame(rows, "year int, stage string, n int, cells array<string>"), "cells", "n", "year", "stage", layouts, "school")
    assert sorted((r.year, r.stage, r.school, r.award, r.area) for r in out.collect()) == [(2025, "high", "甲", "一", "越秀"), (2026, "high", "丙", "三", ""), (2026, "middle", "乙", "二", "")]


def test_entity_table(spark):
    points = [
        (0, "广州市甲小学", "104", "primary", "gz-104-a"), (1, "甲小学(东校区)", "104", "primary", "gz-104-a"), (2, "乙中学（南校区）", "104", "middle", "gz-104-b"), (3, "丙中学（一校区）", "104", "middle", "gz-104-c"), (4, "丙中学（二校区）", "104", "middle", "gz-104-d"),
        (5, "停车场", "104", "middle", None), (6, "错名中学", "105", "middle", "gz-105-e"), (7, "景泰中学", "111", "middle", "gz-111-f"), (8, "白云湖校区", "111", "middle", "gz-111-g"), (9, "高中甲", "111", "middle", "gz-111-h"), (10, "无号小学", "104", "primary", None),
    ]
    attached = [
        (0, "middle", "白云湖校区", "景泰中学", False), (1, "middle", "白云湖校区", "白云区景泰分校", False), (2, "primary", "错名已改中学", "越秀区某中学", False), (3, "high", "景泰中学", "共名中学", False), (4, "middle", "白云湖校区", "共名中学", False),
        (5, "middle", "高中甲", "共名中学", True), (6, "middle", "查无", "x", True), (7, "middle", "高中甲", "白云区留名学校", False), (8, "middle", "景泰中学", "白云区去名学校", False), (9, "middle", "高中甲", "高中甲", True),
    ]
    frame = spark.createDataFrame
    out = entities.entity_table(
        frame(points, "ord int, name string, area string, stage string, id string"), frame([("停车场",)], "name string"), frame([("错名中学", "错名已改中学")], "name string, fixed string"), frame([("高中甲", "111", "high")], "name string, area string, right string"),
        frame(attached, "ord int, stage string, name string, alias string, force boolean"), frame([("gz-111-h", "白云区留名学校")], "id string, alias string"), frame([("gz-104-b",)], "id string"), {"104": "越秀", "111": "白云", "105": "海珠"},
    )
    got = {r.ord: (r.id, r.stage, r.name, r.aliases, r.nature) for r in out.collect()}
    key = got.pop(10)
    assert key[0].startswith("gz-104-") and key[1:] == ("primary", "无号小学", [], None)
    assert got == {
        0: ("gz-104-a", "primary", "广州市甲小学", ["甲小学东校区"], None),
        2: ("gz-104-b", "middle", "乙中学（南校区）", ["乙中学"], "民办"),
        3: ("gz-104-c", "middle", "丙中学（一校区）", [], None),
        4: ("gz-104-d", "middle", "丙中学（二校区）", [], None),
        6: ("gz-105-e", "middle", "错名已改中学", ["越秀区某中学"], None),
        7: ("gz-111-f", "middle", "景泰中学", ["共名中学"], None),
        8: ("gz-111-g", "middle", "白云湖校区", [], None),
        9: ("gz-111-h", "high", "高中甲", ["白云区留名学校", "共名中学"], None),
    }
