"""Many rows of few names: what operators join and shuffle grows with the rows, not with their pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import campuses, feeds, graph, resolve
from tessera.operators.common import materialised
from tessera.queries import QUERIES

COPIES = 500


def most(df, metric, of=max):
    """The largest value of a metric over all nodes of the plan that was run, or their sum."""
    rows = df.collect()

    def nodes(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from nodes(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from nodes(plan.plan())
        else:
            found = plan.metrics().get(metric)
            if found.isDefined():
                yield found.get().value()
            for k in range(plan.children().size()):
                yield from nodes(plan.children().apply(k))

    return rows, of(nodes(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def copies(spark):
    return spark.range(COPIES).select(F.col("id").cast("int").alias("qid"), F.lit("第一中学").alias("name"))


def test_levels_of_copies(copies):
    levels = copies.select("name", (F.col("qid") + 5).alias("level"), "qid")
    rows, joined = most(resolve.first_level(copies.withColumnRenamed("qid", "key"), "key", levels, "name", "level", "qid"), "numOutputRows")
    assert len(rows) == COPIES and {r.level for r in rows} == {5} and joined <= 4 * COPIES


def test_group_match_of_copies(spark, copies):
    q = spark.createDataFrame([("第一中学东",), ("第一中学",)], "q string").crossJoin(spark.range(COPIES).select("id"))
    rows, joined = most(resolve.group_match(q, "q", copies, "name", "qid", "qid"), "numOutputRows")
    assert len(rows) == 2 * COPIES and {r.qid for r in rows} == {0} and joined <= 4 * COPIES


def test_roster_status_of_copies(copies):
    held = copies.select(F.col("qid").alias("id"), "name", F.array("name").alias("aliases"), F.lit("middle").alias("stage"), F.lit("a").alias("area"))
    q = copies.select("qid", "name", F.lit("a").alias("area"), F.lit(None).cast("string").alias("campus"), F.lit(True).alias("expected"))
    rows, joined = most(resolve.roster_status(q, held), "numOutputRows")
    assert len(rows) == COPIES and {r.status for r in rows} == {"MATCHED"} and joined <= 8 * COPIES


def test_fact_row_of_copies(copies):
    e = copies.select(F.col("qid").alias("id"), "name", F.array().cast("array<string>").alias("aliases"), F.col("qid").alias("ord"))
    rows = copies.select(F.col("qid").alias("row"), F.col("qid").alias("id"), F.array("qid").alias("ids"), F.lit(None).cast("string").alias("name"))
    out, joined = most(resolve.fact_row(copies, copies.limit(0), e.select("name", "id").limit(0), rows, e), "numOutputRows")
    assert {(r.row, r.tier) for r in out} == {(0, 2)} and len(out) == COPIES and joined <= 8 * COPIES


def test_backfill_of_copies(copies):
    rows = copies.select(F.col("qid").alias("row"), F.lit("m").alias("id"), F.lit(None).cast("array<string>").alias("ids"), F.lit("zone").alias("mechanism"), F.lit(None).cast("map<string, array<string>>").alias("scope"))
    to = copies.select(F.col("qid").cast("string").alias("id"), F.create_map(F.lit("zone"), F.array(F.lit("m"))).alias("by_mechanism"))
    out, joined = most(graph.reverse_backfill(rows, to, to.select("id", F.lit("甲").alias("name"))), "numOutputRows")
    assert len(out) == COPIES and {len(r.scope["甲"]) for r in out} == {COPIES} and joined <= 4 * COPIES


def test_backfill_of_equal_names(spark, sf, tmp_path):
    """Senders of one name are listed one by one, as in the SQL."""
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    to = spark.read.parquet(f"{sf}/customer.parquet").filter("c_mktsegment = 'BUILDING' and c_custkey % 2 = 0").first().c_nationkey
    s = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey = 1").withColumn("s_nationkey", F.lit(to))
    s.union(s.withColumn("s_suppkey", s.s_suppkey + 3)).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.scope for r in QUERIES["reverse_backfill"](spark, str(tmp_path)).collect()}
    name = s.first().s_name
    assert got - {"", "x=y"} == {f"{name}=s1,{name}=s4"}


def test_score_match_of_copies(spark, sf, tmp_path):
    p = spark.read.parquet(f"{sf}/part.parquet")
    p.crossJoin(spark.range(20).withColumnRenamed("id", "k")).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("k")).drop("k").write.parquet(f"{tmp_path}/part.parquet")
    rows, joined = most(QUERIES["score_match"](spark, str(tmp_path)), "numOutputRows")
    assert len(rows) == 20 * p.count() and {r.score for r in rows} == {1000} and joined <= 6 * len(rows)


def test_score_match_moves_rows_once(spark, tmp_path):
    """Repeated ids, missing values and names that end in their first word; an exchange takes no row more than once."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a", "a b", "a c", "b a", " a"]), rng.choice([None, "x", "y"])) for _ in range(200)]
    rows += [(1000 + k, "w z", "z") for k in range(300)] + [(2000, "alone", "z"), (2000, "alone", "z")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for q, name, brand in set(rows):
        for other, name2, brand2 in set(rows):
            if None not in (q, other, name, name2, brand) and brand == brand2 and q != other and name.split(" ")[0] == name2.split(" ")[0]:
                want[q] = min(want.get(q, (0, 0)), (-1000 if name == name2 else -800, other))
    got, shuffled = most(QUERIES["score_match"](spark, str(tmp_path)), "shuffleRecordsWritten")
    assert sorted((r.q, r.id, r.score) for r in got) == sorted((q, other, -points) for q, (points, other) in want.items())
    assert shuffled <= len(rows)


@pytest.mark.parametrize("most_bytes", [None, -1])
def test_score_match_without_automatic_broadcasts(spark, tmp_path, monkeypatch, most_bytes):
    """Rows are dealt by their own id only, once, whatever Spark's threshold; names of any size give the same rows."""
    if most_bytes is not None:
        monkeypatch.setattr(resolve, "BROADCAST_BYTES", most_bytes)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", "a", "b c", "b d", f"{rng.choice('efgh')} {k}"]), rng.choice([None, "x", "y"])) for k in range(300)]
    rows += [(1000 + k, f"w {k % 3}", "z") for k in range(3000)] + [(5000, "alone 1", "z"), (5000, "alone 2", "z"), (5001, "alone 1", "y")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    groups, want = {}, {}
    for row in {r for r in rows if None not in r}:
        groups.setdefault((row[2], row[1].split(" ")[0]), []).append(row)
    for group in groups.values():
        for q, name, _ in group:
            for other, name2, _ in group:
                if q != other:
                    want[q] = min(want.get(q, (0, 0)), (-1000 if name == name2 else -800, other))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, shuffled = most(QUERIES["score_match"](spark, str(tmp_path)), "shuffleRecordsWritten", sum)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.q, r.id, r.score) for r in got) == sorted((q, other, -points) for q, (points, other) in want.items())
    assert most_bytes == -1 or shuffled <= 1.5 * len(rows)


def test_year_rows_of_copies(spark, copies):
    rows = copies.withColumnRenamed("qid", "row")
    none = copies.limit(0)
    out, shuffled = most(feeds.year_rows(copies, rows, none.select("name", F.col("name").alias("other"), F.col("qid").alias("ord")), none), "shuffleRecordsWritten")
    assert len(out) == COPIES * COPIES and shuffled <= 8 * COPIES


def test_year_rows_shuffled(spark, copies, monkeypatch):
    """Names are looked up once, and queries meet rows in blocks: over all steps each row is dealt a few times."""
    dealt = []

    def kept(df):
        dealt.append(most(df, "shuffleRecordsWritten", sum)[1])
        return materialised(df)

    monkeypatch.setattr(feeds, "materialised", kept)
    none = copies.limit(0)
    rows = copies.limit(3).withColumnRenamed("qid", "row")
    out, shuffled = most(feeds.year_rows(copies, rows, none.select("name", F.col("name").alias("other"), F.col("qid").alias("ord")), none), "shuffleRecordsWritten", sum)
    assert sorted((r.qid, r.row) for r in out) == [(k, r) for k in range(COPIES) for r in range(3)]
    assert shuffled + sum(dealt) <= 2.5 * COPIES


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that resolution writes on its way."""
    sizes = []

    def counted(df):
        out = materialised(df)
        sizes.append(out.count())
        return out

    for module in (resolve, campuses):
        monkeypatch.setattr(module, "materialised", counted)
    return sizes


def _schools(copies, name):
    return copies.select(F.col("qid").alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("middle").alias("stage"), F.lit("a").alias("area"), F.lit(None).cast("string").alias("policy_area"), F.col("qid").alias("ord"))


def test_cascade_of_copies(copies, written):
    asked = [("第一中学", "exact"), ("广州第一中学", "alias"), ("第一中学东", "contained"), ("花都第一中学", "far"), ("第九小学", "missing")]
    e = _schools(copies.limit(1), F.col("name")).union(_schools(copies, F.lit("某某中学")).withColumn("id", F.col("id") + COPIES))
    names = F.explode(F.array(*[F.lit(n) for n, _ in asked], F.lit("某某中学"), F.lit("某中学某某"))).alias("name")
    q = copies.select(names, F.lit("a").alias("area"), F.lit("middle").alias("stage"), "qid").withColumn("qid", F.col("qid") + COPIES * F.hash("name").cast("long"))
    rows = resolve.cascade(q, e, e.select("name", "id").limit(0), {}).collect()
    assert len(rows) == 7 * COPIES and {(r.name, r.id) for r in rows if r.id is not None} <= {(n, 0) for n, _ in asked} and max(written) <= 8 * COPIES
    assert ("第一中学", "exact", 0) in {(r.name, r.how, r.id) for r in rows} and {r.id for r in rows if r.name.startswith("某")} == {None}


def test_legal_campuses_of_copies(copies, written):
    e = _schools(copies, F.concat("name", F.lit("（"), "qid", F.lit("校区）")))
    q = copies.select("qid", "name", F.lit("a").alias("area"), F.lit("middle").alias("stage"))
    rows = campuses.campuses(q, e, e.select("name", "id").limit(0), {}).select("qid", "id").distinct()
    assert rows.count() == COPIES * COPIES and max(written) <= 8 * COPIES


def test_legal_campuses_of_areas(spark, copies, written):
    """What a name leads to is found once for all areas, and each area's queries get what lies there by place or by policy."""
    areas = 25
    e = _schools(copies, F.concat("name", F.lit("（"), "qid", F.lit("校区）"))).withColumn("area", (F.col("id") % areas).cast("string")).withColumn("policy_area", F.when(F.col("id") < areas, "0"))
    q = spark.range(areas + 1).select(F.col("id").cast("int").alias("qid"), F.lit("第一中学").alias("name"), F.when(F.col("id") < areas, F.col("id").cast("string")).alias("area"), F.lit("middle").alias("stage"))
    got = sorted((r.qid, r.id) for r in campuses.campuses(q, e, e.select("name", "id").limit(0), {}).collect())
    assert got == sorted((k, i) for k in range(areas + 1) for i in range(COPIES) if k == areas or i % areas == k or (k == 0 and i < areas)) and max(written) <= 8 * COPIES


def test_campus_lists_of_copies(copies, written):
    e = _schools(copies, F.concat("name", F.lit("（"), "qid", F.lit("校区）")))
    listed = copies.select("qid", F.concat("name", F.lit("（"), F.col("qid") + 1000, F.lit("、"), "qid", F.lit("校区）")).alias("name"), F.lit("a").alias("area"), F.lit("middle").alias("stage"))
    rows, joined = most(campuses.campus_sites(listed, e, e.select("name", "id").limit(0), {}), "numOutputRows")
    assert {(r.qid, r.id) for r in rows} == {(k, k) for k in range(COPIES)} and len(rows) == COPIES and max(written) <= 8 * COPIES and joined <= 16 * COPIES


def test_fuzzy_fix_of_long_names(spark):
    """Names that share letters only, and are too long for a ratio, never meet; short ones get what brute force finds."""
    long = spark.range(COPIES).select("id", F.md5(F.col("id").cast("string")).alias("c"))
    rows, joined = most(N.fuzzy_fix(long.select(F.reverse("c").alias("q")), "q", long, "c", "id"), "numOutputRows")
    assert len(rows) == COPIES and {r.fixed for r in rows} == {None} and joined <= 16 * COPIES
    pick = random.Random(5)
    names = ["".join(pick.choices("abcd", k=pick.randint(1, 13))) for _ in range(120)]
    reads = ["".join(pick.choices("abcd", k=pick.randint(1, 13))) for _ in range(120)]
    c, q = spark.createDataFrame(list(enumerate(names)), "o int, c string"), spark.createDataFrame([(r,) for r in reads], "q string")
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    for r in N.fuzzy_fix(q, "q", c, "c", "o").collect():
        hits = [(1, 0.0, k) for k, n in enumerate(names) if n == r.q]
        hits += [(2, -ratio(r.q, n), k) for k, n in enumerate(names) if min(len(n), len(r.q)) <= 10 and ratio(r.q, n) >= 0.75]
        hits += [(3, 0.0, k) for k, n in enumerate(names) if len(n) == len(r.q) >= 5 and n[-3:] == r.q[-3:] and sum(x != y for x, y in zip(n, r.q, strict=True)) <= 2]
        best = min(hits, default=None)
        assert (r.fixed, r.rule) == ((names[best[2]], best[0]) if best else (None, None))
