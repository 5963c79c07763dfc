"""Name normalisers and text extractors as Column functions.

Several normalisers look alike and differ in one rule; each is its own function. A null name gives null unless said
otherwise. Only :func:`fold_unicode`, :func:`similarity` and :func:`fuzzy_fix` need Python (Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

# Suffixes, prefixes and word lists that results depend on.
CITY = "广州市"
CITY_SHORT = "广州"
PROVINCE = "广东"
LOOSE_SUFFIXES = ("初中部", "高中部", "小学部", "校区", "分校", "学校", "部")
PLAIN_SUFFIXES = ("小学", "学校", "校区", "中学", "初中")
PART_SUFFIXES = ("初中部", "高中部", "小学部")
DISTRICTS = ("越秀", "海珠", "天河", "荔湾", "白云", "黄埔", "番禺", "南沙", "增城", "从化", "花都", "萝岗")
LEADING_DISTRICTS = ("白云", "越秀", "海珠", "天河", "荔湾", "黄埔", "番禺", "萝岗")
GENERIC = ("实验中学", "附属实验学校", "外国语实验学校", "实验学校", "外国语学校", "附属中学", "中学", "附属小学", "小学", "学校", "初中部", "小学部", "高中部")
STATUS_WORDS = ("建设中", "在建", "筹建", "规划", "拟建", "待建", "新开办", "暂定", "筹办", "装修", "工地", "选址", "暂停营业")
NUMERALS = "一二三四五六七八九"
VARIANTS = {"穂": "穗", "敎": "教", "學": "学", "朮": "术", "甦": "苏"}
MECHANISM_ORDER = ("zhi_sheng", "single_zone", "group_paidui", "single_paidui", "single_chouqian", "min_zi_zhu")


def _alternatives(words: Sequence[str]) -> str:
    return "(" + "|".join(words) + ")"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def unify_brackets(s: Column) -> Column:
    """Full-width round brackets become half-width."""
    return F.translate(s, "（）", "()")


def strict_norm(s: Column) -> Column:
    """Every city word goes, brackets are unified and dropped, then all white space (also U+3000)."""
    return F.regexp_replace(F.translate(F.replace(s, F.lit(CITY), F.lit("")), "（）()", ""), r"(?U)\s+", "")


def strict_norm_spaces(s: Column) -> Column:
    """As N1 with square brackets too, but of white space only the space and U+3000; null gives ''."""
    return F.coalesce(F.translate(F.replace(F.translate(s, "（）", "()"), F.lit(CITY), F.lit("")), "[]() 　", ""), F.lit(""))


def prefix_norm(s: Column) -> Column:
    """The city word goes only as a prefix, after the brackets are unified; null gives ''."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(unify_brackets(s), f"^{CITY}", ""), r"(?U)[()\s]", ""), F.lit(""))


def loose_norm(s: Column, keep_one: bool = False) -> Column:
    """N1 and one of seven suffixes dropped; with ``keep_one`` (N2, the other edition) only if something is left before it."""
    if keep_one:
        return F.regexp_replace(strict_norm_spaces(s), f"(?<=.){_alternatives(LOOSE_SUFFIXES)}$", "")
    return F.regexp_replace(strict_norm(s), f"{_alternatives(LOOSE_SUFFIXES)}$", "")


def is_generic_core(s: Column, generic: Sequence[str] = GENERIC) -> Column:
    """Whether a name without ordinal and modifier is only a generic word."""
    core = F.regexp_replace(s, f"^第?[{NUMERALS}十0-9]+", "")
    return F.regexp_replace(core, "^(实验|附属|外国语|外语)", "").isin(*generic)


def match_norm(s: Column, generic: Sequence[str] = GENERIC, status: Sequence[str] = STATUS_WORDS) -> Column:
    """Status brackets go, campus brackets stay; known district and city prefixes go unless the rest is generic; null gives ''."""
    t = F.translate(F.trim(s), "（）【】", "()[]")
    t = F.regexp_replace(t, rf"[\(\[][^()\[\]]*{_alternatives(status)}[^()\[\]]*[\)\]]", "")
    t = F.replace(t, F.lit(CITY), F.lit(""))
    t = F.regexp_replace(t, f"{_alternatives(DISTRICTS)}区", "$1")

    def without(lead: str) -> Callable[[Column], Column]:
        def step(x: Column) -> Column:
            rest = F.substring(x, 3, 10_000)
            special = is_generic_core(F.regexp_replace(rest, r"[\(\[].*$", ""), generic)
            return F.when(x.rlike(lead) & (F.length(rest) >= 4) & ~special, rest).otherwise(x)

        return step

    t = _let(_let(t, without("^" + _alternatives(LEADING_DISTRICTS))), without("^" + CITY_SHORT))
    return F.coalesce(F.regexp_replace(t, r"(?U)\s+", ""), F.lit(""))


def brand_norm(s: Column) -> Column:
    """City words, all brackets and spaces go; null gives ''."""
    t = F.replace(F.replace(s, F.lit(CITY), F.lit("")), F.lit(CITY_SHORT), F.lit(""))
    return F.coalesce(F.translate(t, "（）()[] 　", ""), F.lit(""))


def brand_core(s: Column) -> Column:
    """N7 without bracketed parts: what names of groups and members are compared by."""
    t = F.translate(F.regexp_replace(s, "[（(][^）)]*[）)]", ""), " 　", "")
    return F.replace(F.replace(t, F.lit(CITY), F.lit("")), F.lit(CITY_SHORT), F.lit(""))


def strip_generic(s: Column, generic: Sequence[str] = GENERIC) -> Column:
    """Generic suffixes, plain or in brackets, and a bracket left open go until none is left; a name of one suffix only loses what fits behind a first character."""
    words = "|".join(generic)
    return F.regexp_replace(F.regexp_replace(s, rf"(?<=.)(?:\((?:{words})\)|（(?:{words})）|{words}|[（(])+$", ""), "^[（(]$", "")


def core_campus_name(s: Column) -> Column:
    """Without bracketed parts; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(s, "[（(][^）)]*[）)]", "")), F.lit(""))


def legal_key(s: Column) -> Column:
    """The core name without a department suffix, normalised by N6."""
    return match_norm(F.regexp_replace(core_campus_name(s), "(小学|初中|高中|中职)部$", ""))


@F.pandas_udf(T.StringType())
def fold_unicode(s: pd.Series) -> pd.Series:
    """NFKC and a table of variant characters."""
    import unicodedata

    table = str.maketrans(VARIANTS)
    return s.map(lambda x: unicodedata.normalize("NFKC", x).translate(table), na_action="ignore")


def plain_school_name(s: Column) -> Column:
    """City prefix, bracketed parts and one suffix go."""
    t = F.regexp_replace(s, f"^({CITY}|{CITY_SHORT})", "")
    t = F.regexp_replace(F.regexp_replace(t, "（[^）]*）", ""), r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(t, f"{_alternatives(PLAIN_SUFFIXES)}$", ""))


def without_brackets(s: Column) -> Column:
    """Without bracketed parts."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, "（[^）]*）", ""), r"\([^)]*\)", ""))


def base_name(s: Column) -> Column:
    """Without bracketed parts and one department suffix."""
    t = F.regexp_replace(F.regexp_replace(s, "（[^）]*）", ""), r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(t, f"{_alternatives(PART_SUFFIXES)}$", ""))


def campus_short(s: Column) -> Column:
    """What stands in the first full-width brackets, without 校区; '' without brackets."""
    return F.regexp_replace(F.regexp_extract(s, "（([^）]+)）", 1), "校区$", "")


def short_name(s: Column, keep_middle: bool = False) -> Column:
    """Without a city or province prefix if three characters or more stay and no university does; ``keep_middle`` also keeps what would start with 中学."""
    n = F.trim(s)
    rest = F.substring(n, 3, 10_000)
    good = (F.length(rest) >= 3) & ~rest.startswith("大学")
    if keep_middle:
        good = good & ~rest.startswith("中学")
    return (
        F.when(n.startswith(CITY), F.substring(n, 4, 10_000))
        .when(n.startswith(PROVINCE), rest)
        .when(n.startswith(CITY_SHORT) & good, rest)
        .otherwise(n)
    )


def subject_prefix(s: Column) -> Column:
    """广东, 广州 (not the city word) or ''."""
    return F.when(s.startswith(PROVINCE), PROVINCE).when(s.startswith(CITY_SHORT) & ~s.startswith(CITY), CITY_SHORT).otherwise("")


def initials_key(s: Column, table: Mapping[str, str], most: int = 6) -> Column:
    """The table's initials of a name's characters, at most six; characters outside the table are skipped."""
    chars = "".join(table)
    kept = F.regexp_replace(F.coalesce(s, F.lit("")), f"[^{chars}]", "")
    return F.translate(F.substring(kept, 1, most), chars, "".join(table.values()))


def chinese_ordinal(s: Column) -> Column:
    """The first run of digits as an ordinal: 1-99 by tens, longer ones digit by digit; 0 stays."""
    digits = F.regexp_extract(s, r"\d+", 0)
    n = digits.try_cast("int")
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    numeral = lambda k: F.when(k > 0, F.substring(F.lit(NUMERALS), k, F.lit(1))).otherwise("")
    small = F.concat(F.when(tens > 1, numeral(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), numeral(ones))
    written = F.when(n >= 100, F.translate(digits, "123456789", NUMERALS)).otherwise(small)
    return F.when((digits == "") | (n == 0), s).otherwise(F.regexp_replace(s, r"^(\D*)\d+", F.concat(F.lit("$1第"), written)))


def chinese_number(s: Column) -> Column:
    """一 to 十九 as a number, else 0."""
    digit = lambda c: F.call_function("locate", c, F.lit(NUMERALS))
    teens = F.when(s.startswith("十"), 10 + digit(F.substring(s, 2, 1))).otherwise(0)
    return F.when(s == "十", 10).when(F.length(s) == 1, digit(s)).otherwise(teens).cast("int")


def name_variants(s: Column) -> Column:
    """Ever looser variants in order, without repeats: as it is, without brackets, without a department word (4 characters or more stay), with ordinals."""
    bare = F.trim(F.regexp_replace(s, "[（(].*?[)）]", ""))
    plain = F.array(s, F.when(bare != "", bare))
    trimmed = F.transform(plain, lambda b: F.trim(F.regexp_replace(b, "(本部|初中部|初中)$", "")))
    all_plain = F.concat(plain, F.filter(trimmed, lambda t: F.length(t) >= 4))
    return F.array_distinct(F.array_compact(F.concat(all_plain, F.transform(all_plain, chinese_ordinal))))


def percentage(s: Column) -> Column:
    """率N%, else 超N%, else N成 as tens, else a bare N% that no word of change precedes."""
    number = lambda pattern: F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("double")
    tenths = F.nullif(F.regexp_extract(s, f"([0-9{NUMERALS}]+)\\s*成", 1), F.lit(""))
    in_tens = F.when(tenths.rlike("^[0-9]+$"), tenths.try_cast("double")).when(F.length(tenths) == 1, F.call_function("locate", tenths, F.lit(NUMERALS)).cast("double")) * 10
    return F.coalesce(
        number(r"(?:特控|上线|重本|一本|高优|本科)率[^0-9]{0,6}?(\d+(?:\.\d+)?)\s*%"),
        number(r"(?:超|达|约|近)\s*(\d+(?:\.\d+)?)\s*%"),
        in_tens,
        number(r"(?<![提升增长降低减少多同])(\d+(?:\.\d+)?)\s*%"),
    )


def first_integer(s: Column) -> Column:
    """The first run of digits as a number, null without one."""
    return F.nullif(F.regexp_extract(s, r"\d+", 0), F.lit("")).try_cast("int")


def dash_as_null(s: Column) -> Column:
    """A number, null for '', dashes and None."""
    return F.when(~s.isin("", "--", "—", "None"), s).try_cast("int")


def digits_only(s: Column) -> Column:
    """A number if the trimmed text is digits only."""
    return F.when(F.trim(s).rlike(r"^\d+$"), F.trim(s)).try_cast("int")


def strip_year(s: Column, year: int = 2026) -> Column:
    """Without the year prefix."""
    return F.trim(F.regexp_replace(s, f"^{year}年", ""))


def strip_project(s: Column) -> Column:
    """Without the last bracketed part, or what follows a last bracket left open."""
    p = F.trim(s)
    return F.when(p.endswith("）"), F.regexp_replace(p, "（[^（）]*）$", "")).otherwise(F.regexp_replace(p, "(?<=.)（[^（]*$", ""))


def strip_list_numbers(s: Column) -> Column:
    """List numbers before text go; the punctuation before them stays."""
    return F.regexp_replace(s, "(^|[；;，,、。）(（:：])\\s*\\d{1,2}\\.(?=[\\u4e00-\\u9fff0-9“”\"A-Za-z（(])", "$1")


def strip_joiner(s: Column) -> Column:
    """An enumeration comma right after other punctuation goes."""
    return F.regexp_replace(s, r"([。；;，,！？!?])\s*、", "$1")


def strip_attachments(s: Column) -> Column:
    """References to attachments go."""
    return F.regexp_replace(F.regexp_replace(s, r"附件\d+\s*#\d+\s*", ""), r"（[^（）]*附件\d+[^（）]*）", "")


def expand_references(s: Column, notes: Mapping[int, str]) -> Column:
    """见说明N becomes note N, for each match of its own; unknown notes stay."""
    out = s
    for n, text in sorted(notes.items(), reverse=True):
        out = F.regexp_replace(out, f"见?说明{n}(?!\\d)", text.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def scope_parts(s: Column, conditions: Sequence[str], endings: Sequence[str], blocked: Sequence[str]) -> Column:
    """A list of names out of running text.

    Commas inside brackets don't split; brackets with a condition word go; what does not end as a name or holds a blocking word is left out.
    """
    pieces = F.regexp_extract_all(s, F.lit("(?:[（(][^（）()\n]*[）)]|[^、，,;；\n])+"), 0)
    parts = F.transform(pieces, lambda p: F.translate(F.trim(p), "，,;；", "、、、、"))
    words = "|".join(conditions)
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, f"[（(][^（）()]*(?:{words})[^（）()]*[）)]", "")))
    return F.filter(clean, lambda p: p.rlike(f"(?:{'|'.join(endings)})[）)]?$") & ~p.rlike("|".join(blocked)))


def group_label(s: Column) -> Column:
    """电脑派位第N组 from a note with a group number, 电脑派位 without."""
    raw = F.coalesce(
        F.nullif(F.regexp_extract(s, f"第\\s*([{NUMERALS}十\\d]+)\\s*组", 1), F.lit("")),
        F.nullif(F.regexp_extract(s, f"([{NUMERALS}十\\d]+)\\s*组", 1), F.lit("")),
    )
    n = F.when(raw.rlike(r"^\d+$"), raw.try_cast("int")).otherwise(chinese_number(raw))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(F.lit("电脑派位第"), n.cast("string"), F.lit("组"))).otherwise("电脑派位")


def mechanisms(s: Column) -> Column:
    """The admission mechanisms that a text names, in the fixed order; a negated 派位 does not count; null gives an empty array."""
    negated = s.contains("不参加") | s.contains("不参与")
    tianhe, straight = s.contains("天河区"), s.contains("对口直升")
    nine = (s.contains("九年制") | s.contains("十二年制")) & ~s.contains("单校（")
    attachment = s.contains("附件10") & tianhe
    draw = s.contains("电脑抽签")
    flags = {
        "zhi_sheng": (straight & ~tianhe) | s.contains("内部直升") | nine,
        "single_zone": (straight & tianhe) | s.rlike("单校划片|单校（|（单校）"),
        "group_paidui": s.contains("市桥城区") | s.contains("亚运城") | (~attachment & ~draw & s.contains("电脑派位") & ~negated) | s.contains("多校") | s.contains("部分毕业生"),
        "single_chouqian": ~attachment & draw,
        "min_zi_zhu": attachment,
    }
    found = F.array_compact(F.array(*[F.when(flags[m], m) for m in MECHANISM_ORDER if m in flags]))
    none = s.isNull() | s.contains("不参与公办") | s.contains("待核")
    return F.when(none, F.array().cast("array<string>")).otherwise(found)


def medal(s: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The first medal of the table one of whose words the text holds."""
    out = F.lit(None).cast("string")
    for name, words in reversed(list(table.items())):
        out = F.when(s.rlike("|".join(words)), name).otherwise(out)
    return out


def split_remark(s: Column, gap: str) -> Column:
    """Struct (gap, note): the part that the pattern's first group matches, and the rest without hanging separators."""
    found = F.regexp_extract(F.coalesce(s, F.lit("")), gap, 1)
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), gap, ""), "^[;； ]+|[;； ]+$", "")
    return F.struct(found.alias("gap"), rest.alias("note"))


def surrogate_key(area: Column, *parts: Column, prefix: str = "gz") -> Column:
    """Prefix-area-(8 hex digits of sha1 over the |-joined parts)."""
    return F.concat(F.lit(prefix + "-"), area, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8))


def key_area(key: Column) -> Column:
    """The area inside a surrogate key."""
    return F.split_part(key, F.lit("-"), F.lit(2))


def near_distance(a: Column, b: Column) -> Column:
    """Edit distance, 9 where lengths differ by more than one."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 1, 9).otherwise(F.levenshtein(a, b))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two strings."""
    import difflib

    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def without_area(s: Column, areas: Sequence[str] = DISTRICTS) -> Column:
    """The name behind a leading district, with or without 区, if something is left."""
    return F.regexp_replace(s, f"^(?:{'|'.join(areas)})区?(?=.)", "")


def fuzzy_fix(df: DataFrame, name: str, candidates: DataFrame, candidate: str, order: str) -> DataFrame:
    """Adds ``fixed`` and ``rule``: a misread name's right form among the candidates, null for none.

    By the names' bodies, without their district: 1 an equal body; else 2 the most similar one, of a ratio of 0.75 or
    more, where the shorter body has at most ten characters; else 3 an equally long body of five characters or more
    that ends in the same three and differs in two places at most. Of several candidates the first by ``order`` counts.
    All rules are equi-joins of distinct bodies, and 2 and 3 are for those without an equal one. A ratio of 0.75 needs
    lengths of 3/5 of each other or more, so both are at most 16, and 3/5 of a body's characters in common (repeated
    ones counted), so in one order, rare ones first, two bodies share one of the characters before the last 3/5, that
    one included. Of three parts of a body before its end, rule 3 needs one to be equal.
    """
    q = df.select(F.col(name).alias("_q")).filter("_q is not null").distinct().withColumn("_b", without_area(F.col("_q")))
    c = candidates.groupBy(F.col(candidate).alias("_c")).agg(F.min(order).alias("_o")).filter("_c is not null").withColumn("_d", without_area(F.col("_c")))
    c = c.groupBy("_d").agg(F.min(F.struct("_o", "_c")).alias("_f")).select("_d", "_f.*")
    bodies = q.select("_b").distinct()
    found = lambda pairs, rule, less: pairs.select("_b", F.struct(F.lit(rule).alias("rule"), less.alias("less"), "_o", "_c").alias("hit"))
    equal = found(bodies.join(c, F.col("_b") == F.col("_d")), 1, F.lit(0.0))
    rest = bodies.join(equal.select("_b"), "_b", "left_anti")
    # rule 2
    sizes = F.length("_b") + F.length("_d")
    near = F.least(F.length("_b"), F.length("_d"))

    def letters(body: str) -> Column:
        """Each character with how often it has come so far."""
        every = F.transform(F.sequence(F.lit(1), F.length(body)), lambda k: F.substring(F.col(body), k, F.lit(1)))
        return _let(every, lambda own: F.transform(own, lambda x, k: F.concat(x, F.size(F.filter(F.slice(own, F.lit(1), k + 1), lambda y: y == x)).cast("string"))))

    lettered = lambda t, body: t.filter(F.length(body).between(1, 16)).withColumn(f"{body}s", letters(body)).withColumn("_l", F.explode(f"{body}s"))
    often = lettered(c, "_d").groupBy("_l").agg(F.count("*").alias("_n"))

    def first(t: DataFrame, body: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(body).orderBy(F.coalesce("_n", F.lit(0)), "_l"))
        least = F.floor((3 * F.length(body) + 4) / 5)
        return lettered(t, body).join(often, "_l", "left").withColumn("_p", place).filter(F.col("_p") <= F.length(body) - least + 1).drop("_n", "_p")

    able = first(rest, "_b").join(first(c, "_d"), "_l").filter((near <= 10) & (2 * near >= 0.75 * sizes))
    able = able.filter(2 * F.size(F.array_intersect("_bs", "_ds")) >= 0.75 * sizes).select("_b", "_d", "_o", "_c").distinct()
    alike = able.withColumn("_r", similarity("_b", "_d")).filter("_r >= 0.75")
    # rule 3

    def parted(t: DataFrame, body: str) -> DataFrame:
        third = F.floor((F.length(body) - 1) / 3).cast("int")  # of the characters before the last three, rounded up
        parts = F.array(*[F.struct(F.lit(k).alias("_k"), F.substring(F.substring(F.col(body), F.lit(1), F.length(body) - 3), third * k + 1, third).alias("_s")) for k in range(3)])
        return t.filter(F.length(body) >= 5).select("*", F.substring(body, -3, 3).alias("_t"), F.length(body).alias("_z"), F.inline(parts))

    differ = F.size(F.filter(F.arrays_zip(F.split("_b", "").alias("x"), F.split("_d", "").alias("y")), lambda p: p["x"] != p["y"]))
    two = parted(rest, "_b").join(parted(c, "_d"), ["_t", "_z", "_k", "_s"]).filter((F.levenshtein("_b", "_d", 2) >= 0) & (differ <= 2))  # the cheap bound first
    hits = equal.unionByName(found(alike, 2, -F.col("_r"))).unionByName(found(two, 3, F.lit(0.0)))
    best = q.join(hits.groupBy("_b").agg(F.min("hit").alias("hit")), "_b").select("_q", "hit")
    return df.join(best, F.col(name) == F.col("_q"), "left").withColumn("fixed", F.col("hit._c")).withColumn("rule", F.col("hit.rule")).drop("_q", "hit")


def source_label(url: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The label of the first rule all of whose parts the address holds."""
    out = F.lit(default)
    for parts, label in reversed(rules):
        held = F.lit(True)
        for p in parts:
            held = held & F.coalesce(url.contains(p), F.lit(False))
        out = F.when(held, label).otherwise(out)
    return out


def brief_list(items: Column, most: int = 4, joiner: str = "、", more: str = "等", none: str = "未查到") -> Column:
    """The first items joined, with a word for more."""
    short = F.concat(F.array_join(F.slice(items, 1, most), joiner), F.when(F.size(items) > most, more).otherwise(""))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, short).otherwise(none)


def repair_name(s: Column) -> Column:
    """A name broken over lines: joined, junk before it dropped, a doubled or lost first character put right; null gives ''."""
    n = F.regexp_replace(F.replace(s, F.lit("\n"), F.lit("")), "^(市|州|区|委|考|试|生|招|员|公|办|室|会)+", "")
    n = F.regexp_replace(n, "^([广州市])\\1+(?=.{2})", "$1")
    n = F.when(n.startswith("广") & ~n.rlike("^广(东南大|州市)"), F.substring(n, 2, 10_000)).otherwise(n)
    lost = n.startswith("州") | (n.startswith("东") & ~n.startswith("东莞")) | n.startswith("大附中")
    return F.coalesce(F.trim(F.when(lost, F.concat(F.lit("广"), n)).otherwise(n)), F.lit(""))


def query_scalar(s: Column, allowed: Sequence[str], fallback: str) -> Column:
    """The value if it is allowed, else the fallback."""
    return F.when(s.isin(*allowed), s).otherwise(fallback)


def query_set(s: Column, allowed: Sequence[str] | None = None) -> Column:
    """The allowed members of a comma list; null (no limit) if there are none."""
    items = F.filter(F.array_distinct(F.split(s, ",")), lambda x: x != "")
    if allowed is not None:
        items = F.filter(items, lambda x: x.isin(*allowed))
    return F.when(F.size(items) > 0, items)


def repair_suffix(s: Column, mark: str = "领军龙") -> Column:
    """Without a trailing mark in brackets; a bracket that stays open is closed."""
    t = F.regexp_replace(F.trim(s), f"[，,][“\"]{mark}[”\"]学校[)）]$", "")
    t = F.regexp_replace(t, f"[（(][“\"]{mark}[”\"]学校[)）]$", "")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return F.when(count("（") > count("）"), F.concat(t, F.lit("）"))).otherwise(t)


def labelled_segments(s: Column, labels: Sequence[str]) -> Column:
    """The values of a ;-separated remark's segments that start with a label and a colon, with the label; null without any."""
    parts = F.filter(F.transform(F.split(s, "[;；]"), lambda p: F.trim(p)), lambda p: p.rlike(f"^(?:{'|'.join(labels)}):\\s*\\S"))
    shown = F.transform(parts, lambda p: F.regexp_replace(p, ":\\s*", "："))
    return F.nullif(F.array_join(shown, "；"), F.lit(""))


def phrase_list(s: Column, phrase: str, joiners: str = "[、和]") -> Column:
    """The items in the brackets that follow a fixed phrase."""
    inside = F.regexp_extract(s, f"{phrase}（([^）]+)）", 1)
    return F.filter(F.transform(F.split(inside, joiners), lambda p: F.trim(p)), lambda p: p != "")
