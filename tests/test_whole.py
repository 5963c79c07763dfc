"""Queries over whole tables, against brute force."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import campuses, contains, joins, ranking, resolve
from tessera.queries import QUERIES


def column(spark, sf, table, name):
    return [r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(name).collect()]


def test_corpus_hits_whole(spark, sf):
    parts = column(spark, sf, "part", "p_name")
    names = {*parts, *column(spark, sf, "customer", "c_name"), *(w for p in parts for w in p.split(" "))}
    texts = column(spark, sf, "documents", "text")
    got = {r.name: r.hit for r in QUERIES["corpus_hits"](spark, sf).collect()}
    assert got == {n: int(any(n in t for t in texts if t is not None)) for n in names}


def test_corpus_hits_odd_names(spark, sf, monkeypatch):
    texts = [t for t in column(spark, sf, "documents", "text") if t][:40] + [None, "", "aaaa", "zürich 越秀区小学"]
    names = {t[k : k + n] for t in texts if t for k, n in ((0, 12), (5, 1), (7, 33), (20, 300))}
    names = sorted(names | {n + "~" for n in names} | {"", "aa", "aaaaa", "秀区", "ü"})
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(contains, "BLOCK", 4000)
    got = {r.name: r.hit for r in joins.corpus_hits(df, "name", corpus, "text").collect()}
    assert got == {None: 0} | {n: int(any(n in t for t in texts if t is not None)) for n in names}
    assert sum(got.values()) not in (0, len(got))


def test_resolution_whole(spark, sf):
    """Every row of part is a query."""
    run = lambda name: QUERIES[name](spark, sf).collect()
    p = spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").collect()
    assert len({r.p_size % 30 for r in p}) > 10
    asked = {(r.p_name, r.p_brand) for r in p}
    by_name, by_both = {}, {}
    for r in p:
        by_name.setdefault(r.p_name, []).append(r)
        by_both.setdefault((r.p_name, r.p_brand), []).append(r)
    assert {(r.name, r.area): (r.id, r.tier) for r in run("resolve_two_tier")} == {k: (by_both[k][0].p_partkey, 0) for k in asked}

    def unique(k):
        tiers = [by_both[k], by_name[k[0]]]
        return next(((t[0].p_partkey, n) for n, t in enumerate(tiers) if len(t) == 1), (None, None))

    assert {(r.name, r.area): (r.id, r.tier) for r in run("resolve_cascade")} == {k: unique(k) for k in asked}
    first = min(r.p_type for r in p)

    def pick(k):
        left = by_name[k[0]]
        for keep in (lambda r: True, lambda r: r.p_brand == k[1], lambda r: r.p_type == first, lambda r: r.p_partkey % 2 == 0):
            some = [r for r in left if keep(r)]
            if len(some) == 1:
                return some[0].p_partkey
            left = some or left

    assert {(r.name, r.area): r.id for r in run("pick_unique")} == {k: pick(k) for k in asked}
    word = lambda r: r.p_name.split(" ")[0]
    holds = lambda w, r: len(w) >= 4 and len(r.p_name) >= 4 and (w in r.p_name or r.p_name in w)
    want = {(word(q), q.p_brand): next((r.p_partkey for r in p if r.p_brand == q.p_brand and holds(word(q), r)), None) for q in p}
    assert {(r.w, r.area): r.id for r in run("contains_fallback")} == want
    scores = {}
    for q in p:
        near = [(-1000 if r.p_name == q.p_name else -800, r.p_partkey) for r in p if r.p_brand == q.p_brand and r is not q and word(r) == word(q)]
        if near:
            scores[q.p_partkey] = (min(near)[1], -min(near)[0])
    assert {r.q: (r.id, r.score) for r in run("score_match")} == scores


def test_brief_lists_whole(spark, sf):
    def brief(text):
        words = text.split(" ")
        return "、".join(words[:4]) + ("等" if len(words) > 4 else "")

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: "未查到" if r.text is None else brief(r.text) for r in docs}
    cut = {r.doc_id: "未查到" if r.text is None else brief(r.text[:40]) for r in docs}
    assert want != cut
    assert {r.id: r.out for r in QUERIES["brief_lists"](spark, sf).collect()} == want


def test_group_match(spark):
    """An equal core wins over earlier rows; then prefix or suffix either way, not any substring, from four characters."""
    e = spark.createDataFrame([(1, "第一中学东校"), (2, "第一中学"), (3, "广州市越秀"), (4, "甲乙丙丁戊己"), (5, "中学")], "id int, core string")
    q = spark.createDataFrame([("第一中学",), ("越秀区第一中学",), ("广州市越秀区",), ("乙丙丁戊",), ("丙丁戊己",), ("甲乙丙丁",), ("乙丙",), ("中学",), (None,)], "q string")
    got = {r.q: r.id for r in resolve.group_match(q, "q", e, "core", "id", "id").collect()}
    assert got == {"第一中学": 2, "越秀区第一中学": 2, "广州市越秀区": 3, "乙丙丁戊": None, "丙丁戊己": 4, "甲乙丙丁": 4, "乙丙": None, "中学": 5, None: None}


def test_global_ranks(spark):
    """A global order over several partitions numbers every row once."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(200_000).select("id", (F.col("id") * 7919 % 5003).alias("m"), F.repeat(F.lit("wide"), 50).alias("pad"))
        out = ranking.ranked(rows.repartition(7), [F.desc("m"), F.col("id")])
        assert out.rdd.getNumPartitions() > 8
        got = out.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
        assert tuple(got) == (200_000, 200_000, 1, 200_000)
        wrong = out.join(out.select((F.col("rank") + 1).alias("rank"), F.col("m").alias("m0"), F.col("id").alias("id0")), "rank").filter("m > m0 or (m = m0 and id < id0)")
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_generic_suffixes_go_until_none_is_left(spark):
    rng = random.Random(1)
    parts = [*N.GENERIC, "(", "（", "(小学部)", "（学校）", "（小学)", "甲", "乙校", "越秀"]
    texts = sorted({"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(400)})

    def strip(t):
        for w in N.GENERIC:
            for form in (w, f"({w})", f"（{w}）"):
                if len(t) > len(form) and t.endswith(form):
                    return strip(t.removesuffix(form))
        return strip(t[:-1]) if t and t[-1] in "(（" else t

    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.out for r in df.select("s", N.strip_generic(F.col("s")).alias("out")).collect()}
    assert got == {t: strip(t) for t in texts}


def test_scope_with_many_commas(spark):
    text = "甲小学（a、b，c、d；e、f,g小学）、乙学校(x)，丙路；丁小学"
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(N.scope_parts(F.col("s"), ["地段生"], ["小学", "学校", "校区"], ["面向"]).alias("o")).first().o
    assert got == ["甲小学（a、b、c、d、e、f、g小学）", "丁小学"]


def test_fuzzy_fix(spark):
    names = ["番禺区天荣中学", "铁一小学", "邝维煜纪念中学", "天河区华阳小学", "越秀"]
    reads = {"番遇区天荣中学": (None, None), "越秀区天荣中学": ("番禺区天荣中学", 1), "天荧中学": ("番禺区天荣中学", 2), "朝天小学": (None, None), "闻维爆纪念中学": ("邝维煜纪念中学", 2), "完全不同": (None, None)}
    reads.pop("番遇区天荣中学")
    c = spark.createDataFrame(list(enumerate(names)), "o int, c string")
    q = spark.createDataFrame([(r,) for r in [*reads, None]], "q string")
    got = {r.q: (r.fixed, r.rule) for r in N.fuzzy_fix(q, "q", c, "c", "o").collect()}
    assert got.pop(None) == (None, None)
    import difflib

    for read, (fixed, rule) in reads.items():
        body = lambda t: re.sub("^(?:" + "|".join(N.DISTRICTS) + ")区?(?=.)", "", t)
        ratios = {n: difflib.SequenceMatcher(None, body(read), body(n)).ratio() for n in names}
        if rule == 2 and max(ratios.values()) < 0.75:
            rule = 3
        assert got[read] == (fixed, rule), (read, ratios)


AREAS = {"荔湾": "103", "越秀": "104", "海珠": "105", "天河": "106", "白云": "111", "黄埔": "112", "番禺": "113", "花都": "114"}
SITES = [
    ("a1", "广东实验中学(越秀校区)", ["广东实验中学"], "middle", "104"),
    ("a2", "广东实验中学(荔湾校区)", ["广东实验中学"], "high", "103"),
    ("b1", "五一小学", [], "primary", "111"),
    ("b2", "五一小学(红英校区)", ["五一小学"], "primary", "111"),
    ("c1", "海珠实验小学", [], "primary", "105"),
    ("c2", "天河实验小学", [], "primary", "106"),
    ("d1", "华阳教育集团高塘石小学", [], "primary", "106"),
    ("d2", "华阳小学(华成校区)", [], "primary", "106"),
    ("e1", "培英中学", ["培英学校"], "middle", "103"),
    ("f1", "星执学校", [], "middle", "112"),
    ("g1", "第三中学", [], "middle", "104"),
    ("h1", "邝维煜纪念中学停车场", [], "middle", "114"),
    ("i1", "白云广大附中实验中学", [], "middle", "111"),
    ("i2", "广大附中实验中学", [], "middle", "104"),
]
ASKED = [  # name, area, stage -> id, how
    ("广东实验中学", "104", None, "a1", "exact"),
    ("广东实验中学", "106", None, None, "missing"),
    ("广东实验中学", None, "high", "a2", "exact"),
    ("五一小学", None, None, "b1", "exact"),
    ("海珠区实验小学", None, None, "c1", "alias"),
    ("高塘石小学", "106", None, "d1", "contained"),
    ("培英学校", "111", None, "e1", "alias"),
    ("星执学校", None, "primary", "f1", "alias"),
    ("增城新塘镇第三中学", None, None, None, "far"),
    ("邝维煜纪念中学", "114", None, None, "missing"),
    ("另一名称", None, None, "g1", "override"),
    ("完全没有的学校", "104", None, None, "missing"),
    ("", None, None, None, "missing"),
    (None, "104", None, None, "missing"),
]


def test_cascade(spark):
    e = spark.createDataFrame(SITES, "id string, name string, aliases array<string>, stage string, area string")
    q = spark.createDataFrame([(k, *row[:3]) for k, row in enumerate(ASKED)], "qid int, name string, area string, stage string")
    o = spark.createDataFrame([("另一名称", "g1")], "name string, id string")
    got = {r.qid: (r.id, r.how) for r in resolve.cascade(q, e, o, AREAS).collect()}
    assert got == {k: row[3:] for k, row in enumerate(ASKED)}
    none = resolve.cascade(q.limit(0), e, o, AREAS)
    assert none.collect() == [] and resolve.cascade(q, e.limit(0), o.limit(0), {}).filter("id is not null").count() == 0


def test_a_tier_that_stops(spark):
    """An ambiguous tier falls through, or ends the search if it is marked so."""
    strict = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, id int")
    loose = spark.createDataFrame([("x", 4), ("y", 5), ("z", 6)], "k string, id int")
    q = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "k string")
    for stops, x in ((False, (4, 1)), (True, (None, None))):
        got = {r.k: (r.id, r.tier) for r in resolve.unique_tiers(q, "k", [(strict, "k", stops), (loose, "k", False)], "id").collect()}
        assert got == {"x": x, "y": (3, 0), "z": (6, 1), "w": (None, None)}


def test_exempt_pairs(spark):
    points = spark.createDataFrame([(k, 113.0 + k * 0.0005, 23.0, "s") for k in range(4)], "id int, lng double, lat double, stage string")
    exempt = spark.createDataFrame([(1, 2)], "i int, j int")
    got = {(r.i, r.j) for r in joins.proximity_pairs(points, 60.0, ["stage"], "id", exempt).collect()}
    assert got == {(0, 1), (2, 3)}


def test_family_by_alias(spark):
    e = spark.createDataFrame([(1, "甲第一中学", [], 1), (2, "乙学校", ["甲第一中学(东校区)"], 2), (3, "甲第一中学西校区", [], 3), (4, "甲第一中学附近", [], 4)], "id int, name string, aliases array<string>, ord int")
    keys = spark.createDataFrame([("甲第一中学",)], "key string")
    assert {r.id for r in resolve.family(keys, "key", e, "name", "aliases", "id", "ord").collect()} == {1, 2, 3}


def test_nearest_value_ties(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 0.0), (3, "b", 1.0), (4, "a", None), (5, "c", 1.0)], "l int, area string, v double")
    right = spark.createDataFrame([(9, "a", 4.0), (8, "a", 6.0), (7, "a", 6.0), (6, "b", None), (5, "b", 1.0)], "r int, area string, w double")
    got = {r.l: (r.r, r.gap) for r in joins.nearest_value(left, right, "area", "l", "v", "r", "w").collect()}
    assert got == {1: (7, 1.0), 2: (9, 4.0), 3: (5, 0.0)}


def test_roster_status(spark):
    held = [
        ("a", "广州市第一中学", ["一中"], "middle", "104"), ("b", "第二中学(高中部)", [], "high", "104"), ("c", "第三中学（东校区）", [], "middle", "103"),
        ("d", "第四小学", [], "primary", "104"), ("e", "第五中学(南校区)", [], "high", "104"), ("f", "第五中学(北校区)", [], "middle", "104"),
    ]
    asked = [
        ("第一中学", "104", None, True, "MATCHED"), ("一中", "104", None, True, "MATCHED"), ("第二中学", "104", None, True, "ONLY_HIGH"), ("第二中学", "104", None, False, "MATCHED"),
        ("第三中学", "104", None, True, "CROSS"), ("第四小学", "104", None, True, "MISSING"), ("第四小学", "104", None, False, "MATCHED"), ("第五中学", "104", None, True, "MATCHED"),
        ("第五中学(南校区)", "104", "南校区", True, "ONLY_HIGH"), (None, "104", None, True, "MISSING"),
    ]
    e = spark.createDataFrame(held, "id string, name string, aliases array<string>, stage string, area string")
    q = spark.createDataFrame([(k, *row[:4]) for k, row in enumerate(asked)], "qid int, name string, area string, campus string, expected boolean")
    assert {r.qid: r.status for r in resolve.roster_status(q, e).collect()} == {k: row[4] for k, row in enumerate(asked)}


def test_affix_status(spark):
    points = ["第一中学", "第二中学东校区", "一二", "甲乙丙", "很长的名字" + "一" * 9, "另一个" + "一" * 8 + "学校", "远" * 2 + "一" * 16 + "校区"]
    asked = {"第一中学": 0, "天河区第一中学": 2, "某镇第一中学": 2, "某某第一中学": 9, "第一中学（南）": 3, "第二中学": 1, "区一二": 9, "区甲乙丙": 2, "很长的名字": 9, "另一个": 1, "远远": 9, "": 9, None: 9}
    n = spark.createDataFrame([("a", k) for k in asked] + [("b", "第一中学")], "area string, name string")
    p = spark.createDataFrame([("a", x) for x in [*points, "", None]], "area string, p string")
    got = {(r.area, r.name): r.status for r in resolve.affix_status(n, "name", p, "p", "area").collect()}
    assert got == {("a", k): v for k, v in asked.items()} | {("b", "第一中学"): 9}


def test_nearest_by_rings(spark):
    """Near, far, equally near, across the 180th meridian, by the pole and without a place."""
    from math import asin, cos, radians, sin, sqrt

    rng = random.Random(3)
    sites = [(k, "ab"[k % 2], rng.uniform(113, 113.2), rng.uniform(23, 23.2)) for k in range(60)]
    sites += [(70, "a", 179.999, 10.0), (71, "a", 0.0, 89.99), (72, "b", 120.0, 23.0), (73, "a", -60.0, -30.0), (74, "c", 113.0, None), (76, "d", 1.0, 0.0), (75, "d", -1.0, 0.0)]
    points = [(k, "ab"[k % 2], rng.uniform(112.9, 113.3), rng.uniform(22.9, 23.3)) for k in range(200)]
    points += [(300, "a", -179.999, 10.0), (301, "a", 170.0, 89.98), (302, "b", 119.0, 24.0), (303, "a", 100.0, -40.0), (304, "a", None, 1.0), (305, "c", 113.0, 23.0), (306, "d", 0.0, 0.0), (307, "e", 0.0, 0.0)]

    def metres(p, s):
        h = sin(radians(s[3] - p[3]) / 2) ** 2 + cos(radians(p[3])) * cos(radians(s[3])) * sin(radians(s[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000 * asin(sqrt(h))

    want = {}
    for p in points:
        own = [(metres(p, s), s[0]) for s in sites if s[1] == p[1] and s[3] is not None and p[2] is not None]
        if own:
            want[p[0]] = min(own)
    kind = "int, area string, lng double, lat double"
    got = {r.id: (r.metres, r.sid) for r in joins.nearest(spark.createDataFrame(points, "id " + kind), spark.createDataFrame(sites, "sid " + kind), "area", "id", "sid", "sid").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-3 for k in want)


def test_list_options(spark):
    want = {
        "校本部、岭南校区、御景校区": ["校本部", "岭南校区", "御景校区"], "第一、二、三小学部": ["第一小学部", "第二小学部", "第三小学部"], "1、2、3校区": ["1校区", "2校区", "3校区"],
        "东、西、北校区": ["东校区", "西校区", "北校区"], "一、二": ["一", "二"], "第一、二，初中部": ["第一初中部", "第二初中部"], " 东 , 本部、西分校": ["东分校", "本部", "西分校"], "南": ["南"], "、": [], "": [],
    }
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.o for r in df.select("s", campuses.options(F.col("s")).alias("o")).collect()} == want


LEGAL = [  # id, name, aliases, stage, area, policy_area
    ("s1", "沙面小学(本校区)", ["沙面小学"], "primary", "103", None),
    ("s2", "沙面小学(岭南校区)", [], "primary", "103", None),
    ("s3", "沙面小学御景校区", [], "primary", "104", "103"),
    ("s4", "沙面小学(大坦沙校区)", [], "primary", "105", None),
    ("t1", "真光实验学校(一德西校区)", [], "primary", "104", None),
    ("t2", "真光实验学校(一德西校区)", [], "middle", "104", None),
    ("u1", "培正明星中学", [], "middle", "104", None),
]


def _legal(spark):
    rows = [(*row, k) for k, row in enumerate(LEGAL)]
    return spark.createDataFrame(rows, "id string, name string, aliases array<string>, stage string, area string, policy_area string, ord int")


def test_legal_campuses(spark):
    asked = [
        ("沙面小学", None, None, {"s1", "s2", "s3", "s4"}), ("沙面小学", "103", None, {"s1", "s2", "s3"}), ("沙面小学", "103", "middle", {"s1"}), ("沙面小学（岭南校区）", "103", None, {"s2"}),
        ("沙面小学（不存在校区）", None, None, set()), ("沙面小学御景校区", None, None, {"s3"}), ("真光实验学校", "104", "middle", {"t2"}), ("培正明星中学", None, None, {"u1"}), ("别的锚定名", "999", None, {"u1", "s4"}), ("", None, None, set()), (None, None, None, set()),
    ]
    q = spark.createDataFrame([(k, *row[:3]) for k, row in enumerate(asked)], "qid int, name string, area string, stage string")
    o = spark.createDataFrame([("别的锚定名", "u1"), ("别的锚定名", "s4"), ("别的锚定名", "gone")], "name string, id string")
    got = {}
    for r in campuses.campuses(q, _legal(spark), o, {}).collect():
        assert r.id not in got.setdefault(r.qid, set())
        got[r.qid].add(r.id)
    assert got == {k: row[3] for k, row in enumerate(asked) if row[3]}
    assert campuses.campuses(q, _legal(spark).limit(0), o.limit(0), {}).collect() == []


def test_listed_campuses(spark):
    asked = [
        ("沙面小学（校本部、岭南校区、御景校区）", None, None, {"s1", "s2", "s3"}), ("沙面小学（岭南、大坦沙校区）", None, None, {"s2", "s4"}), ("沙面小学（大坦沙校区）", "103", None, {"s4"}), ("真光实验学校（小学部）", None, "primary", {"t1"}),
        ("真光实验学校（第一、二小学部）", None, "primary", set()), ("培正明星中学（本部）", None, None, {"u1"}), ("培正明星中学", None, None, set()), ("锚定（东校区）", None, None, {"u1"}), (None, None, None, set()),
    ]
    q = spark.createDataFrame([(k, *row[:3]) for k, row in enumerate(asked)], "qid int, name string, area string, stage string")
    o = spark.createDataFrame([("锚定（东校区）", "u1")], "name string, id string")
    got = {}
    for r in campuses.campus_sites(q, _legal(spark), o, {}).collect():
        got.setdefault(r.qid, set()).add(r.id)
    assert got == {k: row[3] for k, row in enumerate(asked) if row[3]}


def test_scored_rounds(spark):
    points = [(1, "星光小学", "学校", "a", 2), (2, "星光小学", "学校", "a", 1), (3, "星光小学(公交站)", "交通", "a", 0), (4, "月亮小学", "科教", "b", 3), (5, "番禺区云镇小学校", None, "a", 4), (6, "花店", "商铺", "a", 5)]
    p = spark.createDataFrame(points, "id int, name string, kind string, area string, ord int")
    m = spark.createDataFrame([(9, "太阳中学初中部", 1), (8, "小学", 0)], "id int, name string, ord int")
    asked = [("星光小学", "a", 2, 1000, 1), ("月亮小学", "a", 4, 1000, 3), ("云小学", "a", 5, 1000, 1), ("太阳中学（小学部）", "a", 9, 900, 2), ("花店", "a", None, None, None), (None, "a", None, None, None), ("小学", "a", None, None, None)]
    q = spark.createDataFrame([(k, *row[:2]) for k, row in enumerate(asked)], "qid int, name string, area string")
    assert {r.qid: (r.point, r.score, r.round) for r in resolve.scored_rounds(q, p, m).collect()} == {k: row[2:] for k, row in enumerate(asked)}


def test_fact_row(spark):
    rows = spark.createDataFrame([(1, "a", ["a", "b"], None), (2, "c", [], None), (3, None, None, "海外学校"), (4, None, None, "广州海外学校"), (5, "d", ["b"], None)], "row int, id string, ids array<string>, name string")
    e = spark.createDataFrame([("a", "甲校", ["甲"], 0), ("b", "乙校", [], 1), ("c", "丙中学初中部", [], 2), ("z", "海外", [], 3)], "id string, name string, aliases array<string>, ord int")
    index = spark.createDataFrame([("官方名", "c"), ("空名", "nowhere"), ("新校", "a")], "name string, id string")
    asked = [("官方名", 2, 0), ("海外学校", 3, 1), ("甲", 1, 2), ("广州市乙校", 1, 3), ("丙中学", 2, 2), ("海外小学", 3, 4), ("空名", None, None), ("新校", None, None), ("", None, None), (None, None, None)]
    q = spark.createDataFrame([(k, row[0]) for k, row in enumerate(asked)], "qid int, name string")
    got = resolve.fact_row(q, spark.createDataFrame([("新校",)], "name string"), index, rows, e).collect()
    assert {r.qid: (r.row, r.tier) for r in got} == {k: row[1:] for k, row in enumerate(asked)}


def test_gaps(spark):
    official = spark.createDataFrame([("省", "一中"), ("省", "二中"), ("市", "一中"), ("市", None)], "list string, name string")
    held = spark.createDataFrame([("省", 1, "第一中学", ["广州市一中"]), ("省", 2, "三中", []), ("市", 3, "四中", None)], "list string, id int, name string, aliases array<string>")
    got = {tuple(r) for r in joins.listed_gap(official, held).collect()}
    assert got == {("省", "official_only", "二中"), ("省", "held_only", "三中"), ("市", "official_only", "一中"), ("市", "official_only", None), ("市", "held_only", "四中")}
    official = spark.createDataFrame([("甲集团", "广州市一中（东）"), ("甲集团", "二中"), ("乙集团", "一中"), ("乙集团", "五中")], "group string, member string")
    held = spark.createDataFrame([("广州甲集团", "一中", ["二中 "]), ("乙集团", "五", None)], "group string, member string, campuses array<string>")
    e = spark.createDataFrame([(7, "一中", []), (6, "x", ["广州一中", "一中"]), (5, "五", [])], "id int, name string, aliases array<string>")
    assert {(r.group, r.member): r.ids for r in joins.member_gap(official, held, e).collect()} == {("乙集团", "一中"): [6, 7], ("乙集团", "五中"): []}
