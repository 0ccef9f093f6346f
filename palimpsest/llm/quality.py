"""Problem 9: statistics that tell natural prose from lists, tables and junk, and how far a text lies from prose.

Every line is read once, by JVM expressions only: its characters and words are counted, and lines in the form of an
item, a row of cells or machine output are told from open text. For each language and class of length the mean and
covariance of the statistics are estimated robustly over all documents (medians and median deviations first, then
concentration steps until no document changes sides), and every document gets its squared Mahalanobis distance with
the share of each statistic in it. What holds no form and lies far from prose is junk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch, spread

STATISTICS = (
    "punctuation_ratio", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_share", "common_word_share",
    "word_share", "repeated_share", "misread_ratio", "long_token_share",
)
# Chi-square quantiles (0.975, 0.999) with len(STATISTICS) = 10 degrees of freedom.
TRIM, BOUND = 20.48, 29.59
# Least standard deviation of each statistic; lines may be wrapped or not, so their ends say least.
SPREAD = (0.02, 0.1, 0.02, 0.05, 0.35, 0.05, 0.05, 0.1, 0.02, 0.05)
LENGTHS = {"en": (60, 250, 1200), "zh": (25, 100, 500)}  # classes of length in characters: shares of a short text scatter more

# What page navigation consists of.
NAVIGATION = (
    "home|login|log in|logout|sign in|sign up|register|cart|rss|share|export|cite|cited|pdf|help|menu|tweet|alerts?|top|prev|previous|next"
    "|items?|search|contact|about|privacy|terms|cookies?|subscribe|print|email|download|back|more|faq|sitemap"
    "|首页|登录|注册|购物车|分享|导出|引用|帮助|菜单|搜索|上一页|下一页|返回|更多|收藏|打印|下载"
)
PAGE = r"(?i)\bcookies (?:are|is) (?:needed|used|required)|\bsign in or buy\b|enable javascript|all rights reserved\.?\s*$|subscribe to our newsletter"
UNPLAIN = (
    r"^\s*(?:[^\p{L}]|[A-Z]{2}|[A-Z]\d|\p{IsHan}\d|第|[一二三四五六七八九十]{1,3}[、.．]|[a-zA-Z][.)）]|[ivxIVX]{1,5}[.)])|[|\t{}<>=\\\[\]]|\.\.|…|\d{4}|:\s*[\"“(]|\s{2}"
    r"|(?i:cookies|sign in|javascript|rights reserved|newsletter|keyword|key words|index terms|关键|主题词)"
)
REPEATED = r"^\s*(\S.{2,80}?)\s*\1\s*\1\s*\1\s*\1"
PUNCTUATED = r"[.!?。！？…:：][\s\])}\"'”’」]*$"
BULLET = (
    r"^\s*(?:(?:[-*•·–—▪◦‣●○■□☐☑☒✓✔➤]|\[[ xX✓]?\])\s*(?=\S)|\[\d{1,4}\]\s+\S|[一二三四五六七八九十]{1,3}[、.．]|第\S{1,4}[章节条])"
)
NUMBERED = r"^\s*(?:\(?\d{1,4}[.)、）．]\s*[^\d\s]|（\d{1,4}）|\(?[a-zA-Z][.)）]\s|\(?[ivxIVX]{1,5}[.)]\s|\d{1,3}(?:\.\d{1,3}){1,4}\s)"
REFERENCE = r"\((?:19|20)\d\d\)|\b(?:19|20)\d\d[;,]\s*\d+\s*\(\d+\)|[,，.]\s*(?:19|20)\d\d[.。]?\s*$"
QUERY_LINE = r"\b(?:all|ti|abs|au|cat|title|kw|su|tka)\s*[:=]\s*[\"“(]|\b(?:AND|OR|ANDNOT|NOT) \w+:"
GLOSSARY = r"^\s*(?:[A-Z]{2,}[A-Z0-9-]{0,8}|[A-Z]{1,3}\d{1,2}|\p{IsHan}\d{1,2})\s*(?:[=:：-]|->|→)\s*\S"
LEADER = r"(?:\.\s?){4,}\s*\d*\s*$|…{2,}\s*\d*\s*$"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_facts(line: Column, common_en: str, common_zh: str) -> Column:
    """What is counted in one line; a line of ASCII (as many bytes as characters) is not searched for anything else."""
    ascii_ = F.length(line) == F.octet_length(line)
    return F.struct(
        line.alias("t"),
        F.length(line).alias("n"),
        F.when(ascii_, 0).otherwise(_without(line, r"\p{IsHan}")).alias("han"),
        _without(line, r"[\s\p{Z}]").alias("blank"),
        line.rlike(r"[\p{L}\p{N}]").alias("text"),
        _without(line, r"[.,;:!?。，；：！？、]").alias("stops"),
        _without(line, r"\d").alias("digits"),
        _without(line, r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-–—%°。，；：！？、（）“”‘’《》]").alias("symbols"),
        F.when(ascii_, 0).otherwise(_without(line, "[\\u0080-\\u00bf\\u00c2\\u00c3\\u00e2-\\u00ef\\u20ac\\ufffd]")).alias("misread"),
        _count(line, r"\S+").alias("tokens"),
        _count(line, r"(?<!\S)[(\"“'\[]*\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}]*)*[.,;:!?)\"”'\]]*(?!\S)").alias("words"),
        (_count(F.lower(line), rf"(?<![\p{{L}}\p{{N}}])(?:{common_en})(?![\p{{L}}\p{{N}}])") if common_en else F.lit(0)).alias("common"),
        (F.when(ascii_, 0).otherwise(_count(line, common_zh)) if common_zh else F.lit(0)).alias("common_zh"),
        _without(line, r"\S{30,}").alias("long"),
    )


def line_kind(f: Column) -> Column:
    """list, table or junk (machine output) by its form, bare (short, unended), blank, or open: any other text."""
    t, n, tokens, words, han = f["t"], f["n"], f["tokens"], f["words"], f["han"]
    ink = n - f["blank"]
    latin = han * 3 < ink
    blank = ink == 0
    nav = F.length(F.regexp_replace(t, rf"(?i)(?<![\p{{L}}])(?:{NAVIGATION})(?![\p{{L}}])|[\s>|/·•«»‹›\d,:-]+", "")) == 0
    border = t.rlike(r"^\s*(?:\+[-=]+[-=+]*\+|\|[-:| ]+\|)\s*$")
    hard = (
        t.rlike(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d\S* ")
        | t.rlike(r"^[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s+){3}")
        | t.rlike(r"^\s*Traceback \(|^\s*File \"[^\"]*\", line \d+|^\s+at [\w.$<>]+\(|^\s{2,}\w+ = \w+(?:\[\d+\])?\.\w+\(|^\w+(?:Error|Exception)\b")
        | (t.rlike(r"(?i)</?(?:div|span|script|style|meta|link|img|br|ul|li|p|a|nav|iframe)\b") & ~t.rlike(r"(?i)<t[rdh]\b"))
        | (t.rlike(r"^\s*[\[{]") & (_count(t, r"\"\s*:") >= 2))
        | t.rlike(PAGE)
    )
    cells = lambda sep: F.size(F.split(t, sep))
    lean = f["common"] * 8 < F.greatest(tokens, F.lit(1))
    table = (
        t.rlike(r"^\s*\|.*\|\s*$")
        | t.rlike(r"(?i)<t[rdh]\b|</t(?:r|d|h|able|body|head)>")
        | t.rlike(r"\\\\\s*$|\\(?:begin|end)\{tabular|\\hline")
        | (t.rlike(r"\S\t+\S") & lean)
        | ((cells(r"(?<=\S)\s{2,}(?=\S)") >= 2) & lean & (f["symbols"] * 12 < ink) & (tokens * 2 <= cells(r"(?<=\S)\s{2,}(?=\S)") * 3 + 1))
        | ((_count(t, r"[^\s=]+=\S+") >= 2) & (_count(t, r"[^\s=]+=\S+") * 2 >= tokens))
        | ((cells(";") >= 3) & (tokens * 2 <= cells(";")) & latin)
        | ((cells(";") >= 3) & (tokens <= 2))
        | ((cells(",") >= 3) & (tokens <= 2) & ((f["digits"] > 0) | (cells(",") >= 4)))
        | ((cells(r"(?<=\S)\s*\|\s*(?=\S)") >= 3) & (f["digits"] * 6 > ink))
    )
    talk = F.when(latin, (words >= 6) & (f["common"] * 9 >= words)).otherwise((han >= 12) & (t.rlike("[。！？，；]") | (f["common_zh"] * 25 >= han)))
    items = (
        t.rlike(LEADER)
        | t.rlike(QUERY_LINE)
        | t.rlike(REFERENCE) & ~t.rlike(r"^\s*(?:User|Assistant|Reader|System|Q|A)\s*[:：]")
        | t.rlike(GLOSSARY)
        | t.rlike(BULLET)
        | t.rlike(NUMBERED) & ~(talk & latin)  # a wrapped sentence may begin with a number
    )
    ended = t.rlike(r"[.!?。！？]\s*$")
    inline = lean & F.when(latin, (f["symbols"] * 10 < ink) & (words * 2 + 1 >= tokens)).otherwise(f["symbols"] * 3 < ink) & (
        (cells(r"\s+[/|·•>→]\s+") >= 4)
        | ((cells(r"\s*[;；]\s*") >= 4) & ~t.rlike(r"[。]"))
        | ((cells(r"\s*,\s+") >= 6) & (f["common"] * 20 < F.greatest(tokens, F.lit(1))) & latin)
        | (~latin & (cells("[、，,/|·；]") >= 5) & (_count(t, "[。！？]") == 0) & (f["common_zh"] * 40 < han))
        | t.rlike(r"(?i)^\s*(?:keywords?|key words|index terms|tags|topics|关键词|关键字|主题词)\s*[:：]")
    )
    # most lines are plain sentences: no rule but the last can hold for them, so they need not try the others
    plain = ~t.rlike(UNPLAIN) & F.when(latin, (words >= 6) & (f["common"] * 6 >= tokens) & (words * 4 >= tokens * 3)).otherwise((han >= 12) & t.rlike("。"))
    plain = plain & (f["misread"] == 0) & (f["symbols"] == 0) & (f["long"] == 0)
    return (
        F.when(blank, "blank").when(plain, "open").when(border, "table").when(~f["text"], "open").when(nav & (ink >= 2), "junk").when(hard, "junk").when(table, "table")
        .when(items, "list").when(inline, "list").when(talk | (ended & (words >= 4)) | (f["symbols"] * 10 >= ink) | (f["misread"] * 8 >= ink) | (words * 2 < tokens) | ~f["text"], "open")
        .otherwise("bare")
    )


def profile(texts: DataFrame, key: str, column: str, common: DataFrame) -> DataFrame:
    """(key, language, length, form, the STATISTICS, chars of each form), one row a document with anything in it.

    ``language`` is zh where Han characters outnumber a third of the others, else en: the text decides, not
    a label. ``form`` is that of most characters outside headings. Null, empty and blank texts have no
    row; extra columns are ignored; texts of any length are read whole; an empty table gives no rows.
    """
    words = common.where("word IS NOT NULL AND lang IN ('en', 'zh')").groupBy("lang").agg(F.sort_array(F.collect_set(F.lower("word"))).alias("w"))
    by = {r["lang"]: r["w"] for r in words.collect()}  # a fixed list of frequent words
    en = "|".join(w for w in by.get("en", []) if w.isalpha() and len(w) > 1)  # single letters are cells, too
    zh = "|".join(sorted((w for w in by.get("zh", []) if w.isalpha()), key=len, reverse=True))
    text = spread(texts.select(F.col(key).alias("k"), F.col(column).alias("text"))).where(F.col("text").rlike(r"[^\s\p{Z}]"))
    facts = text.select("k", F.transform(F.split("text", r"\r\n|\n|\r|\x{2028}|\x{0b}|\x0c"), lambda x: line_facts(x, en, zh)).alias("f"))
    facts = facts.select("k", F.filter("f", lambda x: x["n"] > x["blank"]).alias("f"))
    # rules between lines of text are no part of it, unless they are most of it
    ink = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"] - x["blank"])
    said = F.filter("f", lambda x: x["text"])
    facts = facts.select("k", F.when(ink(said) * 2 >= ink(F.col("f")), said).otherwise(F.col("f")).alias("f"))
    kinds = facts.select("k", F.transform("f", lambda x: F.struct(line_kind(x).alias("kind"), x["t"].rlike(PUNCTUATED).alias("ended"), x.alias("f"))).alias("l"))
    return _summarise(kinds)


def _summarise(kinds: DataFrame) -> DataFrame:
    ink = lambda x: x["f"]["n"] - x["f"]["blank"]
    total = lambda which: F.aggregate(F.filter("l", which), F.lit(0), lambda a, x: a + ink(x))
    add = lambda name: F.aggregate("l", F.lit(0), lambda a, x: a + x["f"][name])
    first = F.element_at("l", 1)
    heading = (F.size("l") > 1) & ~first["ended"] & first["kind"].isin("open", "bare")
    heading = heading | ((F.size("l") > 1) & first["f"]["t"].rlike(r"(?i)^\s*(?:table|figure|fig\.|表|图)\s*\d+"))
    bare = F.size(F.filter("l", lambda x: x["kind"] == "bare"))
    bare_ink = total(lambda x: x["kind"] == "bare")
    head = F.when(heading, ink(first)).otherwise(0)
    # three or more different short unended lines are items; fewer are headings
    bare_left = bare_ink - F.when(heading & (first["kind"] == "bare"), head).otherwise(0)
    different = F.size(F.array_distinct(F.transform(F.filter("l", lambda x: x["kind"] == "bare"), lambda x: F.trim(x["f"]["t"]))))
    items = (bare - F.when(heading & (first["kind"] == "bare"), 1).otherwise(0) >= 3) & (different * 3 > bare)
    copies = F.size("l") - F.size(F.array_distinct(F.transform("l", lambda x: F.trim(x["f"]["t"]))))
    again = lambda t: F.position(F.substring(t, 1, 3), t, F.lit(4)) > 0  # noqa: E731  # spares most lines the search for a repeated unit
    out = kinds.select(
        "k",
        add("han").alias("han"), add("n").alias("n"), add("blank").alias("blank"), add("digits").alias("digits"), add("stops").alias("stops"), add("symbols").alias("symbols"),
        add("tokens").alias("tokens"), add("words").alias("words"), add("common").alias("common"), add("common_zh").alias("common_zh"), add("long").alias("long"),
        F.size("l").alias("lines"), total(lambda x: x["ended"]).alias("ended"), head.alias("head"), add("misread").alias("misread"),
        (copies / F.size("l")).alias("copies"), total(lambda x: again(F.trim(x["f"]["t"])) & x["f"]["t"].rlike(REPEATED)).alias("repeated"),
        (total(lambda x: x["kind"] == "open") - F.when(heading & (first["kind"] == "open"), head).otherwise(0) + F.when(items, 0).otherwise(bare_left)).alias("open_chars"),
        (total(lambda x: x["kind"] == "list") + F.when(items, bare_left).otherwise(0)).alias("list_chars"),
        total(lambda x: x["kind"] == "table").alias("table_chars"),
        total(lambda x: x["kind"] == "junk").alias("junk_chars"),
    )
    ink_all = (F.col("n") - F.col("blank")).alias("ink")
    zh = F.col("han") * 4 >= ink_all
    length = F.when(zh, sum(((F.col("n") - F.col("blank") > n).cast("int") for n in LENGTHS["zh"]), F.lit(0))).otherwise(sum(((F.col("n") - F.col("blank") > n).cast("int") for n in LENGTHS["en"]), F.lit(0)))
    formed = F.greatest("junk_chars", "table_chars", "list_chars")
    form = F.when(F.col("open_chars") >= F.col("junk_chars") + F.col("table_chars") + F.col("list_chars"), "open").when(F.col("junk_chars") == formed, "junk").when(F.col("table_chars") == formed, "table").otherwise("list")
    return out.select(
        "k",
        F.when(zh, "zh").otherwise("en").alias("language"),
        length.alias("length"),
        form.alias("form"),
        _share(F.col("stops"), ink_all).alias("punctuation_ratio"),
        F.when(zh, 0.0).otherwise(F.log1p(_share(ink_all, F.col("tokens")))).alias("mean_word_length"),
        _share(F.col("symbols"), ink_all).alias("symbol_ratio"),
        _share(F.col("digits"), ink_all).alias("digit_ratio"),
        _share(F.col("ended"), ink_all).alias("ended_share"),
        F.when(zh, _share(F.col("common_zh"), F.col("han"))).otherwise(_share(F.col("common"), F.col("tokens"))).alias("common_word_share"),
        F.when(zh, _share(F.col("han"), ink_all)).otherwise(_share(F.col("words"), F.col("tokens"))).alias("word_share"),
        F.greatest("copies", _share(F.col("repeated"), ink_all)).alias("repeated_share"),
        _share(F.col("misread"), ink_all).alias("misread_ratio"),
        F.when(zh, 0.0).otherwise(_share(F.col("long"), ink_all)).alias("long_token_share"),
        "open_chars", "list_chars", "table_chars", "junk_chars",
    )


def _start(profiles: DataFrame) -> dict[tuple, tuple[list, list]]:
    """Medians, and inverse squares of the scaled median deviations, of a language for all its lengths; one row a language and statistic reaches the driver."""
    long = profiles.select("language", F.posexplode(F.array(*STATISTICS)).alias("i", "x"))
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    mid = long.groupBy("language", "i").agg(median("x").alias("m"))
    away = long.join(F.broadcast(mid), ["language", "i"]).groupBy("language", "i").agg(F.first("m").alias("m"), median(F.abs(F.col("x") - F.col("m"))).alias("d"))
    at = {(r["language"], r["i"]): (float(r["m"]), 1.0 / ((1.4826 * r["d"]) ** 2 + SPREAD[r["i"]] ** 2)) for r in away.collect()}
    out = {}
    for language in {x for x, _ in at}:
        mean, scale = zip(*[at[language, i] for i in range(len(STATISTICS))])
        out |= {(language, n): (list(mean), np.diag(scale).tolist()) for n in range(len(LENGTHS[language]) + 1)}
    return out


def _fit(profiles: DataFrame) -> tuple[tuple, dict[tuple, tuple[list, list]]]:
    """(mark of the rows, mean and inverse covariance) by language and length; one row a class reaches the driver."""
    p = len(STATISTICS)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)]
    sums += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"c{i}_{j}") for i, j in pairs]
    out, rows, mark = {}, 0, 0
    found = profiles.groupBy("language", "length").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("mark"), *sums)
    for r in found.collect():
        n = r["rows"]
        rows, mark = rows + n, mark + r["mark"]
        mean = np.array([r[f"s{i}"] for i in range(p)], float) / n
        cov = np.diag(np.square(SPREAD))
        for i, j in pairs:
            c = r[f"c{i}_{j}"] / n - mean[i] * mean[j]
            cov[i, j] += c
            cov[j, i] = cov[i, j]
        if n > p:  # fewer do not span a covariance; the medians stay
            out[r["language"], r["length"]] = [float(x) for x in mean], np.linalg.inv(cov).tolist()
    return (rows, mark), out


def _distance(profiles: DataFrame, fits: dict) -> DataFrame:
    """Profiles with ``parts``, the part of each statistic in the squared distance (null without a fit), and ``distance``, their sum."""
    if not fits:
        return profiles.withColumn("parts", F.lit(None).cast("array<double>")).withColumn("distance", F.lit(None).cast("double"))
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    table = F.create_map(*[x for (language, n), (mean, inverse) in sorted(fits.items()) for x in (F.lit(f"{language}{n}"), F.struct(numbers(mean).alias("mean"), F.array(*map(numbers, inverse)).alias("inverse")))])
    out = profiles.withColumn("_fit", F.element_at(table, F.concat("language", F.col("length").cast("string"))))
    out = out.withColumn("_off", F.zip_with(F.array(*STATISTICS), "_fit.mean", lambda x, m: x - m))
    dot = lambda row: F.aggregate(F.zip_with(row, "_off", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    out = out.withColumn("parts", F.zip_with("_off", F.transform("_fit.inverse", dot), lambda x, y: x * y))
    return out.withColumn("distance", F.aggregate("parts", F.lit(0.0), lambda t, x: t + x)).drop("_fit", "_off")


def outlierness(texts: DataFrame, key: str, column: str, common: DataFrame) -> DataFrame:
    """(key, language, length, form, statistics, distance, outlier, part_<statistic>..., kind) of every text with content.

    The first fit takes medians and median deviations of all documents, the next ones the documents within the 0.975
    bound of the fit before, until these are the same ones; ``outlier`` is beyond the 0.999 bound. ``kind`` is the form
    of most characters where they have one; open text is junk if it is an outlier, else prose.
    """
    keep = Scratch(texts.sparkSession, "quality")
    profiles = keep.cut(profile(texts, key, column, common), "profiles")
    fits, before = _start(profiles), set()
    while fits:
        rows, new = _fit(_distance(profiles, fits).where(F.col("distance") <= TRIM))
        if rows in before:  # stable, or a choice that was there before
            break
        before.add(rows)
        fits = fits | new
    named = [F.col("parts")[i].alias(f"part_{s}") for i, s in enumerate(STATISTICS)]
    far = _distance(profiles, fits).withColumn("outlier", F.coalesce("distance", F.lit(float("inf"))) > BOUND).select("*", *named).drop("parts")
    kind = F.when(F.col("form") != "open", F.col("form")).when(F.col("outlier"), "junk").otherwise("prose")
    return far.withColumn("kind", kind).withColumnRenamed("k", key)
