"""Entity resolution of whole columns of names: ranked tiers, unique or nothing.

A tier is a set of candidate rows (name key -> entity). Tiers are tried in order, but an ambiguous tier may either stop
the search or let it fall through; both are expressed by counting distinct entities per (name, tier) before the lowest
accepted tier is taken. Nothing is looked up row by row: candidates come from equi-joins, and prefix and containment
tiers are bounded by an area and a least length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import names as N
from tessera.operators.common import BROADCAST_BYTES, asked_once, cols, exploded_substrings, holding, materialised, measured_bytes, small, to_all, two_of_each


def tiered(queries: DataFrame, query: str, tiers: Sequence[tuple[DataFrame, str | Sequence[str]]], entity: str, order: str) -> DataFrame:
    """The first entity of the first tier that has any: queries with ``entity`` and ``tier``.

    Each tier is (candidates with entity and order, join keys that queries has as well).
    """
    found = None
    for k, (table, keys) in enumerate(tiers):
        hit = queries.select(query, *[c for c in cols(keys) if c != query]).distinct().join(table.select(*cols(keys), F.col(entity).alias("_e"), F.col(order).alias("_o")), cols(keys))
        hit = hit.select(query, F.struct(F.lit(k).alias("tier"), "_o", "_e").alias("c"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(query).agg(F.min("c").alias("c")).select(query, F.col("c._e").alias(entity), F.col("c.tier").alias("tier"))
    return queries.join(best, query, "left")


def unique_tiers(queries: DataFrame, query: str, tiers: Sequence[tuple[DataFrame, str | Sequence[str], bool]], entity: str) -> DataFrame:
    """The entity of the first tier that has exactly one; a tier marked True stops the search when it has several.

    Each tier is (candidates with entity, join keys, stops when ambiguous).
    """
    found = None
    for k, (table, keys, stops) in enumerate(tiers):
        hit = queries.select(query, *[c for c in cols(keys) if c != query]).distinct().join(table.select(*cols(keys), F.col(entity).alias("_e")).distinct(), cols(keys))
        one = hit.groupBy(query).agg(F.min("_e").alias("_e"), F.max("_e").alias("_m"))
        kept = one.filter(F.lit(stops) | (F.col("_e") == F.col("_m")))
        row = kept.select(query, F.struct(F.lit(k).alias("tier"), F.when(F.col("_e") == F.col("_m"), F.col("_e")).alias("_e")).alias("c"))
        found = row if found is None else found.unionByName(row)
    best = found.groupBy(query).agg(F.min_by("c", F.col("c.tier")).alias("c")).select(query, F.col("c._e").alias(entity), F.when(F.col("c._e").isNotNull(), F.col("c.tier")).alias("tier"))
    return queries.join(best, query, "left")


def converge(candidates: DataFrame, query: str, entity: str, in_area: Column, in_stage: Column, is_main: Column) -> DataFrame:
    """Candidates of a query narrowed step by step - all, own area, own stage, main rows without a bracket - until one entity is left; else null."""
    c = candidates.groupBy(query, entity).agg(F.max(in_area.cast("int")).alias("_a"), F.max(in_stage.cast("int")).alias("_s"), F.max(is_main.cast("int")).alias("_m"))
    own = W.partitionBy(query)
    keep = F.lit(True)
    picks = [F.when(F.count("*").over(own) == 1, F.min(entity).over(own))]
    for flag in ("_a", "_s", "_m"):
        narrowed = keep & (F.col(flag) == 1)
        n = F.sum(narrowed.cast("int")).over(own)
        one = F.min(F.when(narrowed, F.col(entity))).over(own)
        c = c.withColumn(f"{flag}n", n).withColumn(f"{flag}e", one)
        picks.append(F.when(F.col(f"{flag}n") == 1, F.col(f"{flag}e")))
        c = c.withColumn(f"{flag}k", F.when(F.col(f"{flag}n") > 0, narrowed).otherwise(keep))
        keep = F.col(f"{flag}k")
    return c.withColumn("_pick", F.coalesce(*picks)).groupBy(query).agg(F.min("_pick").alias(entity))


#: Words of places that are out of reach, words too weak to attract a name, and endings of names that are no schools.
FAR_WORDS = ("花都", "南沙", "增城", "从化", "英德", "清远", "佛山", "东莞", "韶关", "梅州", "河源", "惠州", "汕头", "湛江", "肇庆", "江门", "阳江", "茂名", "揭阳", "潮州", "汕尾", "云浮", "珠海", "中山")
WEAK_CORES = (*N.LEADING_DISTRICTS, "第一", "第二", "第三", "第四", "第五", "第六", "第七", "第八", "第九", "第十")
NO_SCHOOL = ("充电站", "停车场", "广场", "大厦", "中心", "公园", "小区", "花园", "银行", "医院", "超市", "餐厅", "酒店", "公司", "商厦")
KIND_ENDINGS = ("小学", "中学", "初中", "高中", "学校")


def _ends(s: Column, words: Sequence[str]) -> Column:
    return F.coalesce(s.rlike(f"(?:{'|'.join(words)})$"), F.lit(False))


def picked(candidates: DataFrame, guard: bool) -> DataFrame:
    """J28 of the cascade: (qid, id) of queries whose candidates come down to one.

    Candidates have qid, id, the flags in_area, in_stage, is_main, and of the query whether it has an area and names
    another one. The only one of the area wins. With ``guard`` a query with an area stays in it: the only one of the
    area's by stage, or by being a main site; candidates elsewhere only if the name itself states another area. Else all
    candidates: the only one by stage, by being a main site, or at all.
    """
    flags = ("in_area", "in_stage", "is_main", "has_area", "other_area")
    one = candidates.groupBy("qid", "id").agg(*[F.max(f).alias(f) for f in flags])
    area, stage, main = F.col("in_area"), F.col("in_stage"), F.col("is_main")
    sets = {"every": F.lit(True), "area": area, "area_stage": area & stage, "area_main": area & main, "stage": stage, "main": main}
    counted = one.groupBy("qid").agg(
        F.max("has_area").alias("has"), F.max("other_area").alias("other"), *[F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in sets.items()], *[F.min(F.when(c, F.col("id"))).alias(k) for k, c in sets.items()]
    )
    only = lambda *names: F.coalesce(*[F.when(F.col(f"n_{k}") == 1, F.col(k)) for k in names])
    anywhere = only("stage", "main", "every")
    own = F.when(F.col("n_area") > 0, only("area_stage", "area_main")).when(F.col("other"), anywhere)
    pick = F.when(F.col("has") & (F.col("n_area") == 1), F.col("area")).when(F.col("has") & F.lit(guard), own).otherwise(anywhere)
    return counted.select("qid", pick.alias("id")).filter("id is not null")


def cascade(queries: DataFrame, entities: DataFrame, overrides: DataFrame, areas: dict[str, str], far: Sequence[str] = FAR_WORDS) -> DataFrame:
    """Adds ``id`` and ``how`` to queries (qid, name, area, stage; area and stage may be null).

    ``entities`` has id, name, aliases, stage and area; ``overrides`` name and id; ``areas`` leads from a district's word to
    its area. Tiers, each for the names that none before has resolved or stopped:

    - ``override``: the table of overrides by the plain name;
    - the area, where none is given, is that of a leading district word;
    - ``exact``: equal after normalisation (N2) with a name or alias, entities of the very same name alone if there are
      any; picked within the area; not if it is of another stage than the wanted one;
    - ``alias``: an alias by the first of three looser keys that is known; entities of the wanted stage alone if there
      are any; picked in any area, or the main site's only campus in the area; then, with an area, an only entity;
      without an area the search stops as ``variant``, without an id;
    - ``far``: a name that holds a far word stops here, without an id;
    - ``contained``: entities whose name holds the query's whole bare name, else its core, else whose core the query holds;
      of these, those of the same kind; picked within the area;
    - ``missing``.

    Containment goes through exploded substrings of the shorter table of names: equi-joins only. Queries that agree in
    name, area and stage are looked up once, among two of the entities that agree in all that counts: only whether there is
    one, and which, matters.
    """
    by = ["name", "area", "stage"]
    once = materialised(asked_once(queries.select("qid", *by).filter("name <> ''"), by))
    entities = two_of_each(entities.select("id", "name", "aliases", "stage", "area"), ["name", "aliases", "stage", "area"], "id")
    words = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv]) if areas else F.create_map(F.lit(""), F.lit(""))
    lead = F.nullif(F.regexp_extract("name", f"^({'|'.join(areas)})", 1), F.lit("")) if areas else F.lit(None).cast("string")
    q = once.select("qid", "name", F.coalesce("area", F.element_at(words, lead)).alias("area"), "stage")
    own_word = F.element_at(F.create_map(*[F.lit(x) for k, v in areas.items() for x in (v, k)]), F.col("area")) if areas else F.lit("")
    stated = F.filter(F.array(*map(F.lit, N.LEADING_DISTRICTS)), lambda w: F.contains(F.replace("name", F.lit(N.CITY), F.lit("")), F.concat(w, F.lit("区"))) & ~w.eqNullSafe(own_word))
    q = q.withColumn("has_area", F.col("area").isNotNull()).withColumn("other_area", F.size(stated) > 0)
    q = q.withColumn("norm", N.strict_norm_spaces(F.col("name"))).withColumn("match", N.match_norm(F.col("name"))).withColumn("flat", F.translate("match", "()", ""))
    q = materialised(q)
    bare = lambda c: F.regexp_replace(c, r"[(（][^()（）]*[)）]", "")
    e = entities.select(F.col("id"), F.col("name").alias("e_name"), "aliases", F.col("stage").alias("e_stage"), F.col("area").alias("e_area"))
    e = e.withColumn("e_match", N.match_norm(F.col("e_name"))).withColumn("e_bare", bare(F.col("e_match")))
    e = materialised(e)

    def flagged(pairs: DataFrame) -> DataFrame:
        return pairs.select(
            "qid", "id", "has_area", "other_area", F.coalesce(F.col("e_area") == F.col("area"), F.lit(False)).alias("in_area"),
            F.coalesce(F.col("e_stage") == F.col("stage"), F.lit(False)).alias("in_stage"), (~F.col("e_name").rlike("[(（]")).alias("is_main"),
        )

    def prefer(pairs: DataFrame, flag: Column) -> DataFrame:
        """Of each query the pairs with the flag alone, if there are any."""
        some = F.max(flag.cast("int")).over(W.partitionBy("qid"))
        return pairs.withColumn("_flag", flag).withColumn("_some", some).filter("_some = 0 or _flag").drop("_flag", "_some")

    step = lambda found, how: found.select("qid", "id", F.lit(how).alias("how"))
    rest = lambda done: q.join(done.select("qid"), "qid", "left_anti")
    done = step(q.join(overrides.groupBy("name").agg(F.min("id").alias("id")), "name"), "override")
    keys = e.select("id", "e_name", "e_stage", "e_area", "e_match", "e_bare", F.explode(F.array_distinct(F.concat(F.array("e_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("key"))
    keys = keys.withColumn("key", N.strict_norm_spaces(F.col("key"))).dropDuplicates(["id", "e_name", "e_stage", "key"])
    # exact
    pairs = prefer(rest(done).join(keys, F.col("norm") == F.col("key")), F.col("e_name") == F.col("name"))
    exact = picked(flagged(pairs), True).join(pairs.select("qid", "id", "stage", "e_stage").distinct(), ["qid", "id"])
    exact = exact.groupBy("qid", "id").agg(F.max(F.col("stage").isNull() | (F.col("stage") == F.col("e_stage"))).alias("fits")).filter("fits")
    done = done.union(step(exact, "exact"))
    # alias: of three forms of the name the first that some entity has
    forms = rest(done).select("*", F.posexplode(F.array("norm", "match", "flat")).alias("form_no", "form"))
    hits = forms.join(keys, F.col("form") == F.col("key"))
    first = F.min("form_no").over(W.partitionBy("qid"))
    hits = hits.withColumn("_first", first).filter("form_no = _first")
    hits = materialised(prefer(hits, F.coalesce(F.col("e_stage") == F.col("stage"), F.lit(False))).drop("_first"))
    alias = picked(flagged(hits), False)
    open_ = hits.join(alias, "qid", "left_anti")
    sites = open_.filter(~F.col("e_name").rlike("[(（][^()（）]*校区[)）]") & (F.length("e_bare") >= 4)).select("qid", "name", "area", "stage", "has_area", "other_area", F.col("e_bare").alias("base")).distinct()
    sites = materialised(sites)
    begun = exploded_prefixes(e.drop("aliases"), "e_match", 4, "base")
    bases = sites.select("base").distinct()
    if measured_bytes(bases) <= BROADCAST_BYTES:  # prefixes that no site has are left out before they are shuffled
        begun = begun.join(F.broadcast(bases), "base", "left_semi")
    # exploded tables are larger than the optimizer thinks, so they are never broadcast
    campus = begun.hint("merge").join(sites, "base").filter(~F.col("has_area") | (F.col("e_area") == F.col("area")))
    campus = picked(flagged(campus), True)
    lone = open_.join(campus, "qid", "left_anti").groupBy("qid").agg(F.max("has_area").alias("has"), F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    done = done.union(step(alias.union(campus), "alias")).union(step(lone.filter("has and n = 1"), "alias"))
    done = done.union(lone.filter("not has").select("qid", F.lit(None).cast(entities.schema["id"].dataType).alias("id"), F.lit("variant").alias("how")))
    several = lone.filter("has and n > 1").select("qid", F.lit(True).alias("several"))
    # far
    beyond = rest(done).filter(F.col("name").rlike("|".join(far))) if far else rest(done).limit(0)
    done = materialised(done.union(beyond.select("qid", F.lit(None).cast(entities.schema["id"].dataType).alias("id"), F.lit("far").alias("how"))))
    # contained
    left = rest(done).join(several, "qid", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    left = left.withColumn("core", N.strip_generic(F.col("match"))).withColumn("bare", bare(F.col("match")))
    left = left.filter("match <> ''").withColumn("kind", F.regexp_extract("match", f"({'|'.join(KIND_ENDINGS)})$", 1))
    core = N.strip_generic(F.col("e_bare"))
    able = e.filter((F.col("e_match") != "") & ~_ends(bare(F.col("e_name")), NO_SCHOOL))
    able = able.drop("aliases").dropDuplicates(["id", "e_name", "e_stage"]).withColumn("e_core", F.when(core.isin(*WEAK_CORES), "").otherwise(core))
    able = able.withColumn("main", ~F.col("e_name").rlike("[(（]")).withColumn("whole", ~F.col("e_match").rlike("[(（]")).withColumn("group", F.when(F.col("e_bare").contains("集团"), F.col("e_match")))
    able = materialised(two_of_each(able, ["e_bare", "e_core", "e_area", "e_stage", "main", "whole", "group"], "id"))
    strong = (~F.col("several") | (F.length("core") >= 4)) & (F.length("core") >= 3) & ~F.col("core").isin(*WEAK_CORES)
    parts = exploded_substrings(able, "e_bare", 3, "part").hint("merge")
    whole = left.filter((F.length("bare") >= 4) & (F.col("bare") != F.col("core"))).join(parts, F.col("bare") == F.col("part")).withColumn("branch", F.lit(0))
    short = left.filter((F.length("core") < 3) & (F.length("bare") >= 4)).join(parts, F.col("bare") == F.col("part")).withColumn("branch", F.lit(1))
    held = left.filter(strong).join(parts, F.col("core") == F.col("part")).withColumn("branch", F.lit(1))
    inside = exploded_substrings(left.filter(~F.col("several") | (F.length("core") >= 4)), "match", 2, "part").hint("merge").join(able.filter(F.length("e_core") >= 2), F.col("part") == F.col("e_core")).withColumn("branch", F.lit(2))
    found = whole.unionByName(short).unionByName(held).unionByName(inside)
    campus_only = (F.col("match") != F.col("bare")) & F.col("match").contains("校区") & ~F.col("e_match").rlike("[(（]")
    foreign = F.col("e_bare").contains("集团") & ~(F.startswith("e_match", "bare") | F.endswith("e_match", "bare"))
    found = found.filter(~campus_only & ~foreign).dropDuplicates(["qid", "id", "e_name", "e_stage", "branch"])
    found = materialised(found)
    contained = picked(flagged(found.filter("branch = 0")), True)
    later = found.join(contained, "qid", "left_anti").filter("branch > 0")
    later = later.withColumn("_least", F.min("branch").over(W.partitionBy("qid"))).filter("branch = _least")
    same_kind = (F.col("kind") != "") & F.endswith("e_bare", "kind")
    contained = contained.union(picked(flagged(prefer(later, same_kind)), True))
    done = done.union(step(contained, "contained"))
    return to_all(queries, once, done, by, how="left").withColumn("how", F.coalesce("how", F.lit("missing")))


def containment(queries: DataFrame, query: str, entities: DataFrame, name: str, entity: str, order: str, least: int = 4, area: str | None = None) -> DataFrame:
    """Of each query the first entity one of whose names holds the other; both have ``least`` characters at least."""
    by = [area] if area else []
    e = entities.filter(F.length(name) >= least).select(*by, F.col(name).alias("_n"), F.col(entity).alias("_e"), F.col(order).alias("_o"))
    pairs = holding(queries.filter(F.length(query) >= least), query, e, "_n", by, least).join(e, [*by, "_n"])
    best = pairs.groupBy(*by, query).agg(F.min_by("_e", "_o").alias(entity))
    return queries.join(best, [*by, query], "left")


def exploded_prefixes(df: DataFrame, name: str, least: int = 1, out: str = "prefix") -> DataFrame:
    """A row for each prefix of a name, so that a starts-with join becomes an equi-join."""
    return df.withColumn(out, F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length(name), F.lit(least))), lambda n: F.substring(F.col(name), F.lit(1), n))))


def group_match(queries: DataFrame, query: str, entities: DataFrame, name: str, entity: str, order: str, least: int = 4) -> DataFrame:
    """Of each query the first entity of an equal name, else the first of whose name and the query one begins or ends with the other; then both have ``least`` characters at least."""
    q = queries.select(F.col(query).alias("_q")).distinct()
    # of one name only the first entity can be found; exploded tables are larger than the optimizer thinks, so they are never broadcast
    e = entities.groupBy(F.col(name).alias("_n")).agg(F.min(F.struct(F.col(order).alias("_o"), F.col(entity).alias("_e"))).alias("c")).select("_n", "c.*")
    found = q.join(e, F.col("_q") == F.col("_n")).select("_q", F.struct(F.lit(0).alias("tier"), "_o", "_e").alias("c"))
    long_q, long_e = q.filter(F.length("_q") >= least), e.filter(F.length("_n") >= least)
    for turned in (lambda c: F.col(c), F.reverse):
        a, b = long_q.withColumn("_k", turned("_q")), long_e.withColumn("_k", turned("_n"))
        for left, right in ((exploded_prefixes(a, "_k", least), b.withColumn("prefix", F.col("_k"))), (a.withColumn("prefix", F.col("_k")), exploded_prefixes(b, "_k", least))):
            hit = left.drop("_k").hint("merge").join(right.drop("_k"), "prefix")
            found = found.unionByName(hit.select("_q", F.struct(F.lit(1).alias("tier"), "_o", "_e").alias("c")))
    best = found.groupBy("_q").agg(F.min("c").alias("c")).select(F.col("_q").alias(query), F.col("c._e").alias(entity))
    return queries.join(best, query, "left")


def family(keys: DataFrame, key: str, entities: DataFrame, name: str, aliases: str, entity: str, order: str, endings: Sequence[str] = ("校区", "分校", "教学点", "分教点", "分部")) -> DataFrame:
    """All entities of a legal key: by the key of a name or an alias, or with a core name that starts with the key and ends as a campus does."""
    own = entities.select(N.legal_key(F.col(name)).alias(key), entity, order)
    other = entities.select(F.explode(aliases).alias("_a"), entity, order).select(N.legal_key(F.col("_a")).alias(key), entity, order)
    core = entities.withColumn("_core", N.match_norm(N.core_campus_name(F.col(name)))).filter(F.col("_core").rlike(f"(?:{'|'.join(endings)})$"))
    long = exploded_prefixes(core, "_core", out=key).filter(F.length(key) < F.length("_core")).select(key, entity, order)
    every = own.unionByName(other).unionByName(long)
    return keys.select(key).distinct().join(every.hint("merge"), key).groupBy(key, entity).agg(F.min(order).alias(order))


def roster_status(official: DataFrame, held: DataFrame, skipped: Sequence[str] = ("primary",), wanted: str = "middle") -> DataFrame:
    """Adds ``status`` to official rows (qid, name, area, campus, expected) by entities (id, name, aliases, stage, area).

    A name meets an entity by the strict or loose form of one among the strict or loose forms of the other's names, or
    by its core name among the strict forms and core names. Entities of the skipped stages don't count; with a campus,
    those that name it count alone, if there are any. Rows and entities that agree in all that counts meet once. MATCHED: the area has one of the wanted stage, or none is
    expected; ONLY_HIGH: the area has other stages only; CROSS: only other areas have any; MISSING: none has.
    """
    strict, loose, core = N.strict_norm_spaces, lambda c: N.loose_norm(c, keep_one=True), N.core_campus_name

    def forms(c: Column, kinds: Sequence[tuple[str, Callable[[Column], Column]]]) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.struct(F.lit(use).alias("use"), f(c).alias("key")) for use, f in kinds]))).alias("form")

    by = ["name", "area", "campus"]
    once = materialised(asked_once(official, by))
    q = once.select("qid", "name", "area", "campus", forms(F.col("name"), [("whole", strict), ("whole", loose), ("core", core)])).select("qid", "area", "campus", "form.*")
    e = held.filter(~F.col("stage").isin(*skipped)).withColumn("names", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    flat = e.select("names", "stage", F.col("area").alias("e_area")).distinct().select("*", F.explode("names").alias("n"))
    flat = flat.select("names", "stage", "e_area", forms(F.col("n"), [("whole", strict), ("whole", loose), ("core", strict), ("core", core)])).select("names", "stage", "e_area", "form.*").distinct()
    pairs = q.join(flat, ["use", "key"]).filter("key <> ''")
    named = F.coalesce(F.exists("names", lambda n: (F.col("campus") != "") & n.contains(F.col("campus"))), F.lit(False))
    pairs = pairs.select("qid", "stage", F.col("e_area").eqNullSafe(F.col("area")).alias("own"), named.alias("named")).distinct()
    pairs = pairs.withColumn("some", F.max(F.col("named").cast("int")).over(W.partitionBy("qid", "own"))).filter("some = 0 or named")
    facts = pairs.groupBy("qid").agg(F.max("own").alias("own"), F.max(F.col("own") & (F.col("stage") == wanted)).alias("right"))
    status = (
        F.when(F.col("own") & (F.col("right") | ~F.col("expected")), "MATCHED").when(F.col("own"), "ONLY_HIGH").when(F.col("own").isNotNull(), "CROSS").when(F.col("expected"), "MISSING").otherwise("MATCHED")
    )
    return to_all(official, once, facts, by, how="left").withColumn("status", status).drop("own", "right")


def policy_area(df: DataFrame, policy: DataFrame, key: str, area: str) -> DataFrame:
    """Adds ``policy_area``: the area that rules say, else the physical one."""
    return df.join(small(policy.select(key, F.col("policy_area").alias("_p"))), key, "left").withColumn("policy_area", F.coalesce("_p", area)).drop("_p")


def best_tier_rows(df: DataFrame, query: str, tier: str) -> DataFrame:
    """All rows of each query's lowest tier."""
    return df.withColumn("_r", F.rank().over(W.partitionBy(query).orderBy(tier))).filter("_r = 1").drop("_r")


def verified_area(df: DataFrame, entity: str, area: str, wanted: str) -> DataFrame:
    """The entity only where its area is the wanted one."""
    return df.withColumn(entity, F.when(F.col(area) == F.col(wanted), F.col(entity)))


def brand_of(points: DataFrame, name: str, units: DataFrame, brand: str, unit_name: str, unit_names: str, order: str) -> DataFrame:
    """The first brand one of whose names equals the point's after normalisation; an empty name has none."""
    flat = units.select(brand, order, F.explode(F.concat(F.array(unit_name), F.coalesce(unit_names, F.array().cast("array<string>")))).alias("_n"))
    keys = flat.select(N.strict_norm(F.col("_n")).alias("_k"), brand, order).filter("_k <> ''")
    first = keys.groupBy("_k").agg(F.min_by(brand, order).alias(brand))
    return points.withColumn("_k", N.strict_norm(F.col(name))).join(small(first), "_k", "left").drop("_k")


def owner(members: DataFrame, entity: str, group: str, source_rank: str, order: str) -> DataFrame:
    """Each entity's first group: by the rank of the source, then by order."""
    return members.groupBy(entity).agg(F.min_by(group, F.struct(source_rank, order)).alias(group))


def first_level(candidates: DataFrame, key: str, levels: DataFrame, name: str, level: str, order: str) -> DataFrame:
    """Of each key the first level any of whose names is among the key's names; both tables are long (key/level, name)."""
    firsts = levels.groupBy(name).agg(F.min_by(F.struct(F.col(order).alias("_o"), F.col(level).alias("_l")), order).alias("_f"))
    return candidates.join(firsts, name).groupBy(key).agg(F.min_by("_f", F.col("_f._o")).alias("_f")).select(key, F.col("_f._l").alias(level))


def first_others(rows: DataFrame, identity: str, area: str, name: str, wider: Sequence[Column], points: Sequence[int]) -> DataFrame:
    """J42 where points depend on equal keys only: (q, id, score), the best other row of the same area for each id that has one.

    Keys are the name and then ``wider`` ones that follow from it, each for fewer points. Of several the smallest id counts. Rows only meet their
    name's smallest id and are then dealt by their own id; all the rest is done once for each name, in tables that are broadcast where the names'
    measured size allows.
    """
    rows = rows.select(area, name, identity).dropna()
    one = materialised(rows.groupBy(area, name).agg(F.min(identity).alias("_one")))
    # four tables of about this size are broadcast
    near = F.broadcast if 4 * measured_bytes(one) <= BROADCAST_BYTES else lambda df: df
    met = rows.join(near(one), [area, name])
    two = met.filter(F.col(identity) > F.col("_one")).groupBy(area, name).agg(F.min(identity).alias("_two"))
    keys = [f"_k{k}" for k in range(1, len(points))]
    groups = one.join(near(two), [area, name], "left").withColumns(dict(zip(keys, wider, strict=True)))
    # what the smallest id of each name finds; every other id finds that one
    found = groups.withColumnsRenamed({"_one": "q", "_two": "_id0"})
    ids = groups.select(area, *keys, F.explode(F.array("_one", "_two")).alias("_id")).filter("_id is not null")
    for k in range(1, len(points)):
        by = [area, *keys[k - 1 :]]
        place = F.dense_rank().over(W.partitionBy(*by).orderBy("_id"))
        ids = ids.select(*by, "_id", place.alias("_r")).filter("_r <= 2").groupBy(*by).agg(F.min("_id").alias("_least"), F.max("_id").alias("_next"))
        other = F.when(F.col("q") != F.col("_least"), F.col("_least")).when(F.col("_least") != F.col("_next"), F.col("_next"))
        found = found.join(near(ids), by, "left").withColumn(f"_id{k}", other).drop("_least", "_next")
        ids = ids.select(*by, F.explode(F.array("_least", "_next")).alias("_id"))
    found = found.groupBy("q").agg(*[F.min(f"_id{k}").alias(f"_id{k}") for k in range(len(points))])
    best = met.groupBy(F.col(identity).alias("q")).agg(F.min(F.when(F.col(identity) != F.col("_one"), F.col("_one"))).alias("_other"))
    best = best.join(near(found), "q", "left").withColumn("_id0", F.least("_other", "_id0"))
    hits = [F.col(f"_id{k}") for k in range(len(points))]
    score = reduce(lambda t, k: F.when(hits[k].isNotNull(), points[k]).otherwise(t), reversed(range(len(points))), F.lit(None).cast("int"))
    return best.select("q", F.coalesce(*hits).alias("id"), score.alias("score")).filter("id is not null")


def scored(pairs: DataFrame, query: str, rules: Sequence[tuple[Column, int]], least: int, order: Sequence[str | Column]) -> DataFrame:
    """Pairs with the points of the first rule that holds; of each query the best pair with ``least`` points or more."""
    score = F.lit(0)
    for condition, points in reversed(rules):
        score = F.when(condition, points).otherwise(score)
    rows = pairs.withColumn("score", score).filter(F.col("score") >= least)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), *order))).filter("_r = 1").drop("_r")


#: Words a school's point has in its kind or name, and words of points that are none; what names lose before they are compared.
POINT_KINDS = ("学校", "小学", "附小", "教育")
NO_POINTS = ("培训", "托辅", "托管", "辅导", "自习", "成长中心", "学习中心", "文具", "书店", "幼儿园", "工地", "公交", "地铁", "路口", "停车场", "小区", "花园", "站")
POINT_NAMES = (("番禺区", ""), ("番禺", ""), ("小学校", "小学"), ("镇", ""))
REUSED_POINTS, EQUAL_POINTS = 900, 1000


def _point_name(c: Column) -> Column:
    return F.trim(reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), POINT_NAMES, N.strict_norm_spaces(c)))


def scored_rounds(queries: DataFrame, points: DataFrame, reusable: DataFrame) -> DataFrame:
    """Adds ``point``, ``score`` and ``round`` to queries (qid, name, area).

    ``points`` has id, name, kind, area and ord; ``reusable``, points of another stage, id, name and ord. What a match
    has to score, 900 or more, only equal names do, so each round is an equi-join, for the names that none before has
    resolved: 1, the points of the area; 2, another stage's point (900) whose core name equals, holds or is held by the
    query's; 3, the points anywhere. Points that are no schools by kind or name don't count; of several the first by ord.
    """
    q = queries.filter("name <> ''").select("qid", "area", _point_name(F.col("name")).alias("key"), F.regexp_replace("name", r"（小学部）|\(小学部\)", "").alias("base"))
    q = q.withColumn("core", F.replace(_point_name(F.col("base")), F.lit("小学"), F.lit(""))).filter("key <> ''")
    p = points.withColumn("key", _point_name(F.col("name")))
    schools = F.col("kind").rlike("|".join(POINT_KINDS)) | F.col("key").rlike("|".join(POINT_KINDS))
    p = p.filter(F.coalesce(schools, F.lit(False)) & ~F.col("name").rlike("|".join(NO_POINTS)))
    firsts = lambda *keys: p.groupBy(*keys).agg(F.min_by("id", "ord").alias("point"))
    one = q.join(firsts("area", "key"), ["area", "key"]).select("qid", "point", F.lit(EQUAL_POINTS).alias("score"), F.lit(1).alias("round"))
    open_ = q.join(one, "qid", "left_anti")
    cores = reusable.select("id", "ord", F.replace(F.replace(_point_name(F.col("name")), F.lit("初中部"), F.lit("")), F.lit("小学"), F.lit("")).alias("r"))
    held = holding(open_.filter("core <> ''"), "core", cores.filter("r <> ''"), "r", []).join(cores, "r").groupBy("core").agg(F.min_by("id", "ord").alias("point"))
    two = open_.join(held, "core").select("qid", "point", F.lit(REUSED_POINTS).alias("score"), F.lit(2).alias("round"))
    three = open_.join(two, "qid", "left_anti").join(firsts("key"), "key").select("qid", "point", F.lit(EQUAL_POINTS).alias("score"), F.lit(3).alias("round"))
    return queries.join(one.unionByName(two).unionByName(three), "qid", "left")


def fact_row(queries: DataFrame, denied: DataFrame, index: DataFrame, rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``row`` and ``tier`` to queries (qid, name): the fact row of a name, unless the name is denied.

    ``rows`` has row (unique, in order) and either id and ids, the members of a legal entity, or a name; ``index`` name
    and id; ``entities`` id, name, aliases and ord. Tiers: 0 the index's id, 1 a row of that very name, 2 the row of the
    entity's id, 3 the first row that has the entity among its members, 4 the first row of an equal plain name (N12).
    The entity of a name is the first with an equal strict form (N1) of a name or alias, else loose form (N5). Of rows
    with the same id or name the last one counts.
    """
    q = queries.filter("name <> ''").join(denied.select("name").distinct(), "name", "left_anti").select("qid", "name")
    by_id = rows.filter("id is not null").groupBy("id").agg(F.max("row").alias("row"))
    by_name = rows.filter("id is null and name is not null").groupBy("name").agg(F.max("row").alias("row"))
    flat = entities.select("id", "ord", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    forms = lambda c: F.inline(F.array(*[F.struct(F.lit(k).alias("form"), f(c).alias("key")) for k, f in enumerate((N.strict_norm, N.loose_norm))]))
    firsts = flat.select("id", "ord", forms(F.col("n"))).groupBy("form", "key").agg(F.min_by(F.struct("ord", "id"), F.struct("ord")).alias("f")).select("form", "key", "f.*")
    found = q.select("qid", forms(F.col("name"))).join(firsts, ["form", "key"])
    entity = found.groupBy("qid").agg(F.min_by("id", F.struct("form", "ord")).alias("id"))
    members = rows.filter("id is not null").select("row", "id", F.explode("ids").alias("member")).groupBy("member").agg(F.min_by("id", "row").alias("id"))
    plain = rows.filter("id is null").select("row", "name", N.plain_school_name(F.col("name")).alias("key")).filter("key <> ''").groupBy("key").agg(F.min_by("name", "row").alias("name"))
    tiers = [
        q.join(index.groupBy("name").agg(F.max("id").alias("id")), "name").join(by_id, "id"),
        q.join(by_name, "name"),
        entity.join(by_id, "id"),
        entity.withColumnRenamed("id", "member").join(members, "member").join(by_id, "id"),
        q.select("qid", N.plain_school_name(F.col("name")).alias("key")).join(plain, "key").join(by_name, "name"),
    ]
    every = reduce(DataFrame.unionByName, [t.select("qid", F.struct(F.lit(k).alias("tier"), "row").alias("c")) for k, t in enumerate(tiers)])
    best = every.groupBy("qid").agg(F.min("c").alias("c")).select("qid", "c.row", "c.tier")
    return queries.join(best, "qid", "left")


def classified(df: DataFrame, score: str, metres: str, sure: int = 900, near: float = 200.0) -> Column:
    """Same, near, far or none, by a match's points and distance."""
    return F.when(F.col(score).isNull(), "none").when(F.col(score) >= sure, "same").when(F.col(metres) <= near, "near").otherwise("far")


#: What marks the rest of a longer name as a campus, and what a district before a name ends in.
CAMPUS_WORDS = ("校区", "分校", "初中部", "高中部", "小学部", "本部", "校本部", "中学部", "东校区", "西校区", "南校区", "北校区", "首校区", "新校区", "实验学校", "学校")
AREA_ENDINGS = ("区", "镇", "街道", "街")
CAMPUS_SHORT, CAMPUS_LONG, AFFIXED_LEAST = 8, 15, 3


def affix_status(names: DataFrame, name: str, points: DataFrame, point: str, area: str) -> DataFrame:
    """Of each name its best status in its area: 0 equal, 1 the point is the name and a campus, 2 the name is a district and the point, 3 the name is the point and a campus; 9 none.

    A campus is a rest of at most eight characters, or of at most fifteen with a campus word; a point behind a district
    has three characters or more. Null and empty names have status 9. Only equi-joins: of a longer name, the parts that
    are left without up to fifteen last characters, or without a district, are looked up.
    """
    n = names.select(area, F.col(name).alias("_n")).filter("_n <> ''").distinct()
    p = points.select(area, F.col(point).alias("_p")).filter("_p <> ''").distinct()

    def shortened(df: DataFrame, c: str) -> DataFrame:
        """A row for each part of a name that a campus follows, as ``part``."""
        ends = F.sequence(F.greatest(F.length(c) - CAMPUS_LONG, F.lit(1)), F.length(c) - 1)
        cut = df.filter(F.length(c) > 1).withColumn("at", F.explode(ends))
        rest = F.substring(F.col(c), F.col("at") + 1, F.length(c))
        return cut.filter((F.length(rest) <= CAMPUS_SHORT) | rest.rlike("|".join(CAMPUS_WORDS))).withColumn("part", F.substring(F.col(c), F.lit(1), F.col("at")))

    behind = n.filter(F.length("_n") > AFFIXED_LEAST).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("_n") - AFFIXED_LEAST)))
    behind = behind.filter(_ends(F.substring(F.col("_n"), F.lit(1), F.col("at")), AREA_ENDINGS)).withColumn("part", F.substring(F.col("_n"), F.col("at") + 1, F.length("_n")))
    parts = [n.withColumn("part", F.col("_n")), behind, shortened(n, "_n")]
    looked = reduce(DataFrame.unionByName, [df.select(area, "_n", "part", F.lit(rank).alias("rank")) for df, rank in zip(parts, (0, 2, 3), strict=True)])
    found = looked.join(p.withColumnRenamed("_p", "part"), [area, "part"], "left_semi").select(area, "_n", "rank")
    longer = shortened(p, "_p").select(area, F.col("part").alias("_n"), F.lit(1).alias("rank"))
    best = found.union(longer).groupBy(area, "_n").agg(F.min("rank").alias("status"))
    return names.join(best.withColumnRenamed("_n", name), [area, name], "left").withColumn("status", F.coalesce("status", F.lit(9)))
