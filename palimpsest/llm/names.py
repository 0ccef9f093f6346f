"""Problem 3: linking the spellings of one person or organisation.

Entries are parsed into full words, initials and a kind. Words within one edit of each other (also a
swap of neighbours) are found by a trie join: words are sharded by a piece that an edit must leave
whole, every shard becomes a trie, and every word walks the tries of its shards with a Levenshtein
automaton. Persons are unordered pairs of words, so the order of parts does not matter; initials are
resolved within the bearers of a family name.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.components import connected_groups
from palimpsest.runtime import Scratch, width

SHARD = 4_000  # words of one trie

# Short forms of given names.
NICKNAMES = {
    "gabi": "gabriela", "gabby": "gabriela", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "etta": "henrietta",
    "hetty": "henrietta", "sascha": "alexander", "sasha": "alexander", "alex": "alexander", "kit": "christopher", "chris": "christopher",
    "fanny": "francesca", "hans": "johannes", "inge": "ingeborg", "bob": "robert", "rob": "robert", "bobby": "robert", "ted": "theodore",
    "teddy": "theodore", "theo": "theodore", "lenny": "leonard", "len": "leonard", "leo": "leonard", "liz": "elisabeth", "lisa": "elisabeth",
    "beth": "elisabeth", "betty": "elisabeth", "uli": "ulrike", "dick": "richard", "rick": "richard", "rich": "richard", "dora": "dorothea",
    "dorothy": "dorothea", "thea": "dorothea", "basti": "sebastian", "seb": "sebastian", "vlad": "vladislav", "bill": "william",
    "will": "william", "billy": "william", "kolya": "nikolai", "niko": "nikolai", "kate": "katherine", "katie": "katherine",
    "kathy": "katherine", "kat": "katherine", "jim": "james", "jimmy": "james", "joe": "joseph", "tom": "thomas", "mike": "michael",
    "dave": "david", "dan": "daniel", "sam": "samuel", "ben": "benjamin", "tony": "anthony", "steve": "stephen", "andy": "andrew",
    "ed": "edward", "fred": "frederick", "nick": "nicholas", "pete": "peter", "matt": "matthew", "greg": "gregory", "sue": "susan",
    "jenny": "jennifer", "becky": "rebecca", "vicky": "victoria", "ossi": "oskar", "jo": "josephine",
}
PARTICLES = {"von", "van", "der", "den", "de", "la", "le", "al", "di", "da", "del", "du", "dos", "el", "zu", "ter", "ten", "bin"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "phd"}
NOBODY = {"", "et al", "et al.", "and others", "others", "anonymous", "anon", "anon.", "unknown", "n/a", "na", "none", "-", "等", "佚名", "匿名", "not provided"}
ORGANISATION = re.compile(
    r"\b(laborator(y|ies)|labs?|institutes?|inst|departments?|dept|consorti(um|a)|consort|collaborations?|collab|groups?|university|univ"
    r"|cent(er|re)|committee|council|agency|office|team|network|society|association|foundation|survey|project|programme|program|facility)\b"
)
SMALL = {"of", "the", "for", "on", "and", "behalf", "in", "at"}


def fold(text: str) -> str:
    """Lower case without accents; ae, oe and ue written for an umlaut count as the bare vowel."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("’", "'")
    return re.sub(r"(?<=[a-z])([ou])e(?=[a-z])", r"\1", text)


def parse(entry: str) -> tuple[str, list[str], str]:
    """(kind, words, rest): kind none, han, org, full (given and family in either order; rest: middle initials),
    init (family; rest: all initials) or other."""
    text = unicodedata.normalize("NFKC", entry).strip()
    text = re.sub(r"\((?:on behalf of|corresponding author|通讯作者)\)|（通讯作者）|[*†‡§¶]+|\s*\d+(?:,\d+)*\s*$", " ", text).strip()
    if text.casefold() in NOBODY or not re.search(r"\w", text):
        return "none", [], ""
    if re.search(r"[㐀-鿿豈-﫿]", text):
        return "han", [re.sub(r"[^\w]", "", text).casefold()], ""
    flat = re.sub(r"\bwg\b", "working group", fold(text))
    if ORGANISATION.search(flat):
        words = [w for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*\.?", flat.replace("-", " ")) if w.rstrip(".") not in SMALL]
        return "org", words, ""
    shouting = text.isupper()
    head, comma, tail = text.partition(",")
    side = []  # (word, is initials, before comma)
    for part, before in ((head, True), (tail, False)):
        for w in re.findall(r"(?:[^\W\d_]\.-?)+(?=[^\W\d_]{2})|[^\s.]+\.?(?:-?[^\W\d_]\.)*", part):
            bare = fold(w).strip(".'-,;")
            bare = re.sub(r"^(al|el|d|l|o)[-'](?=\w{3})", "", bare)
            compact = w.isalpha() and w.isupper() and len(w) <= 3 and not shouting
            if not bare or bare in PARTICLES or (bare in TITLES and not compact):
                continue
            letters = re.sub(r"[^a-z]", "", bare)
            dotted = "." in w and all(len(x) == 1 for x in re.split(r"[.\-\s]+", fold(w).strip(".-")) if x)
            if w.endswith(".") and 2 <= len(letters) <= 4 and not dotted:
                side.append(("=" + letters, True, before))  # a given name cut short
                continue
            if w.islower() and len(w) <= 4 and side and before and not shouting and not text.islower():
                continue  # a particle, perhaps misspelt
            side.append((letters if dotted or len(bare) == 1 or compact else bare, dotted or len(bare) == 1 or compact, before))
    words = [w for w, initial, _ in side if not initial]
    letters = "".join(w for w, initial, _ in side if initial)
    if comma:
        family = [w for w, i, b in side if b and not i]
        given = [w for w, i, b in side if not b and not i]
        if len(family) >= 1 and len(given) >= 1:
            words = ["-".join(family), "-".join(given)]
    words = [NICKNAMES.get(w, w) for w in words]
    if len(words) == 2:
        return "full", words, letters
    if len(words) == 1 and letters:
        return "init", words, letters
    return ("other", words, letters) if words else ("none", [], "")


def within(query: str, trie: dict, most: int) -> list[str]:
    """Words of a trie within ``most`` edits (insert, delete, replace, swap of neighbours), by walking it with an automaton."""
    found, n = [], len(query)
    stack = [(trie, list(range(n + 1)), None, "", "")]
    while stack:
        node, row, above, last, word = stack.pop()
        if "" in node and row[n] <= most:
            found.append(word)
        for c, child in node.items():
            if not c:
                continue
            new = [row[0] + 1]
            for j in range(1, n + 1):
                v = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (query[j - 1] != c))
                if above is not None and j > 1 and c == query[j - 2] and last == query[j - 1]:
                    v = min(v, above[j - 2] + 1)
                new.append(v)
            if min(new) <= most or min(row) < most:  # a swap may still lead on from the row before
                stack.append((child, new, row, c, word + c))
    return found


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    backwards = pdf.side.iloc[0] == "s"
    turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
    trie: dict = {}
    for w in pdf.word[pdf.stored]:
        node = trie
        for c in turn(w):
            node = node.setdefault(c, {})
        node[""] = {}
    out = [(w, turn(f)) for w in pdf.word[~pdf.stored] for f in within(turn(w), trie, 1) if turn(f) != w]
    return pd.DataFrame(out, columns=["word", "near"])


def trie_join(words: DataFrame, column: str) -> DataFrame:
    """(word, near) for all words of three and more letters that are one edit apart, in both orders.

    With k = min(3, (n-1)/2) letters, an edit or swap in a word of n letters leaves its first k or its last
    k letters whole, so neighbours always meet in a shard. A shard of more than 4,000 words is cut into
    several tries, which all its words walk: no task grows with a frequent beginning.
    """
    one = words.select(F.col(column).alias("word")).where(F.length("word") >= 3).distinct()
    k = lambda n: F.least(F.lit(3), F.floor((n - 1) / 2)).cast("int")
    n = F.length("word")
    ks = F.array_distinct(F.array(k(n), F.greatest(k(n - 1), F.lit(1))))
    keyed = one.select("word", F.explode(ks).alias("k")).select(
        "word", "k", F.explode(F.array(F.struct(F.lit("p").alias("side"), F.expr("left(word, k)").alias("piece")), F.struct(F.lit("s").alias("side"), F.expr("right(word, k)").alias("piece")))).alias("s")
    ).select("word", "k", "s.side", "s.piece")
    sizes = keyed.groupBy("k", "side", "piece").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("tries"))
    keyed = keyed.join(sizes, ["k", "side", "piece"])
    stored = keyed.withColumn("trie", F.pmod(F.xxhash64("word"), "tries").cast("int")).withColumn("stored", F.lit(True))
    asking = keyed.withColumn("trie", F.explode(F.sequence(F.lit(0), F.col("tries") - 1))).withColumn("stored", F.lit(False))
    both = stored.select("k", "side", "piece", "trie", "word", "stored").unionByName(asking.select("k", "side", "piece", "trie", "word", "stored"))
    cell = ["k", "side", "piece", "trie"]
    return both.repartition(width(words.sparkSession), *cell).groupBy(*cell).applyInPandas(_search, "word string, near string").distinct()


@F.pandas_udf(T.StructType().add("kind", "string").add("words", T.ArrayType(T.StringType())).add("rest", "string"))
def _parse(entries: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(e) for e in entries], columns=["kind", "words", "rest"])


def _initials(word):
    return F.array_join(F.transform(F.split(word, "-"), lambda p: F.substring(p, 1, 1)), "")


def entities(entries: DataFrame, column: str) -> DataFrame:
    """(name, entity) for every distinct entry that names somebody; spellings of one entity share ``entity``.

    - null, blank and placeholder entries (et al., anonymous) name nobody and have no row; repeated entries
      give one row; other columns are ignored; an empty table gives an empty result;
    - two persons of one family name stay apart unless their given names are equal, a known short form, or one
      edit apart; middle initials, where both are given, must agree;
    - initials join the one bearer of the family name whom they fit; where they fit several, each entry stays
      alone; where they fit none, equal initials of a family name are one; an entry may have any length.
    """
    spark = entries.sparkSession
    keep = Scratch(spark, "names")
    names = entries.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    names = names.repartition(width(spark)).withColumn("p", _parse("name")).select("name", "p.kind", "p.words", "p.rest").where("kind <> 'none'")
    names = keep.cut(names, "parsed")
    # three full words: a double given name without its hyphen, if the joined form is known from other entries
    # a lost hyphen must not matter: words are compared without, their initials are taken with it
    marked = lambda w: F.struct(F.regexp_replace(w, "-", "").alias("word"), _initials(w).alias("i"))
    two = F.array_sort(F.transform("words", marked))
    full = names.where("kind = 'full'").select("name", two.alias("w"), F.col("rest").alias("mid"))
    full = full.select("name", F.col("w")[0]["word"].alias("a"), F.col("w")[1]["word"].alias("b"), F.col("w")[0]["i"].alias("ia"), F.col("w")[1]["i"].alias("ib"), "mid")
    pairs = full.select("a", "b").distinct()
    three = names.where("kind = 'other' AND size(words) = 3").select("name", F.col("rest").alias("mid"), F.explode(F.array(
        F.array_sort(F.array(marked(F.concat_ws("-", F.col("words")[0], F.col("words")[1])), marked(F.col("words")[2]))),
        F.array_sort(F.array(marked(F.col("words")[0]), marked(F.concat_ws("-", F.col("words")[1], F.col("words")[2])))),
    )).alias("w")).select("name", F.col("w")[0]["word"].alias("a"), F.col("w")[1]["word"].alias("b"), F.col("w")[0]["i"].alias("ia"), F.col("w")[1]["i"].alias("ib"), "mid")
    three = three.join(pairs, ["a", "b"], "left_semi").dropDuplicates(["name"])
    full = keep.cut(full.unionByName(three.select(*full.columns)), "full")
    one_way = full.select("a", "b").distinct()
    halves = keep.cut(one_way.select(F.col("a").alias("t"), F.col("b").alias("o")).union(one_way.select(F.col("b").alias("t"), F.col("a").alias("o"))).distinct(), "halves")
    partners = halves.groupBy("t").agg(F.count("*").alias("partners"))
    words = halves.select("t").union(names.where("kind IN ('init', 'org')").select(F.explode(F.transform("words", lambda w: F.regexp_replace(w, r"\.$|-", ""))).alias("t")))
    near = keep.cut(trie_join(words, "t").toDF("t", "u"), "near")
    # a misspelt word has one partner, or far fewer than the right one; else the two are different names
    p1, p2 = partners.toDF("t", "pt"), partners.toDF("u", "pu")
    close = near.join(p1, "t").join(p2, "u").where("pt = 1 OR pu = 1 OR pt >= 8 * pu OR pu >= 8 * pt").select("t", "u")
    moved = halves.join(close, "t").select(F.col("t").alias("was"), F.col("u").alias("t"), "o").join(halves, ["t", "o"], "left_semi")
    name_of = lambda x, y: F.concat_ws(" ", F.least(x, y), F.greatest(x, y))
    edges = moved.select(name_of("was", "o").alias("left"), name_of("t", "o").alias("right"))
    grouped = connected_groups(edges)
    person = one_way.select("a", "b", F.concat_ws(" ", "a", "b").alias("id")).join(grouped, "id", "left").select("a", "b", F.coalesce("group_id", "id").alias("root"))
    rooted = keep.cut(full.join(person, ["a", "b"]), "rooted")
    mids = rooted.where("mid <> ''").groupBy("root").agg(F.count_distinct("mid").alias("mids"), F.min("mid").alias("mid1"))
    rooted = rooted.join(mids, "root", "left").withColumn(
        "person", F.when(F.coalesce("mids", F.lit(0)) > 1, F.concat_ws("|", "root", "mid")).otherwise(F.col("root"))
    ).withColumn("middle", F.when(F.coalesce("mids", F.lit(0)) == 1, F.col("mid1")).otherwise(F.col("mid")))
    rooted = keep.cut(rooted.select("name", "a", "b", "ia", "ib", "person", "middle"), "persons")
    bearers = rooted.select(F.col("a").alias("f"), F.col("b").alias("g"), F.col("ib").alias("gi"), "person", "middle")
    bearers = keep.cut(bearers.union(rooted.select("b", "a", "ia", "person", "middle")).distinct(), "bearers")
    short = keep.cut(names.where("kind = 'init'").select("name", F.regexp_replace(F.col("words")[0], "-", "").alias("f"), F.col("rest").alias("letters")), "short")

    def fitting(asked: DataFrame) -> DataFrame:
        gi = F.col("gi")
        fits = (F.col("letters").startswith("=") & F.col("g").startswith(F.expr("substring(letters, 2)"))) | (F.col("letters") == gi) | (F.col("letters") == F.concat(gi, "middle")) | ((F.col("middle") == "") & F.col("letters").startswith(gi) & (F.length("letters") == F.length(gi) + 1))
        hit = asked.join(bearers, "f").where(fits).withColumn("exact", (F.col("letters") == F.concat(gi, "middle")).cast("int"))
        best = hit.groupBy("name").agg(F.max("exact").alias("top"))
        hit = hit.join(best, "name").where("exact = top")
        return hit.groupBy("name").agg(F.count_distinct("person").alias("n"), F.min("person").alias("person"))

    direct = keep.cut(fitting(short), "direct")
    lost = short.join(direct.select("name"), "name", "left_anti")
    guessed = fitting(lost.join(near.toDF("f", "u"), "f").select("name", F.col("u").alias("f"), "letters"))
    resolved = keep.cut(direct.unionByName(guessed), "resolved")
    unclear = resolved.where("n > 1").select("name", F.concat_ws("?", F.lit(""), "name").alias("entity"))
    alone = short.join(resolved.select("name"), "name", "left_anti").select("name", F.concat_ws("~", "f", "letters").alias("entity")).union(unclear)
    # organisations: the coined word is the one that fewest organisations share, misspellings aside
    orgs = names.where("kind = 'org'").select("name", F.posexplode("words").alias("pos", "raw")).withColumn("t", F.regexp_replace("raw", r"\.$", ""))
    df = orgs.groupBy("t").agg(F.count_distinct("name").alias("df"))
    lifted = df.join(near.join(df.toDF("u", "du"), "u").groupBy("t").agg(F.max(F.struct("du", "u")).alias("best")), "t", "left").select(
        "t", F.when(F.col("best.du") > F.col("df"), F.col("best.u")).otherwise(F.col("t")).alias("word"), F.greatest("df", F.coalesce("best.du", F.lit(0))).alias("df")
    )
    orgs = orgs.join(lifted, "t")
    coined = orgs.where("NOT raw LIKE '%.'").groupBy("name").agg(F.min_by("word", F.struct("df", F.length("word") * -1, "word")).alias("coined"))
    signs = orgs.join(coined, "name").where("word <> coined").groupBy("name", "coined").agg(F.array_join(F.array_sort(F.collect_list(F.substring("word", 1, 1))), "").alias("sign"))
    org = coined.join(signs.drop("coined"), "name", "left").select("name", F.concat_ws("@", F.lit("org"), "coined", "sign").alias("entity"))
    rest = names.where("kind = 'other'").join(full.select("name"), "name", "left_anti").select("name", F.concat_ws("+", F.array_sort("words"), F.array("rest")).alias("entity"))
    return (
        names.where("kind = 'han'").select("name", F.col("words")[0].alias("entity"))
        .union(rooted.select("name", F.col("person").alias("entity")))
        .union(resolved.where("n = 1").select("name", F.col("person").alias("entity")))
        .union(alone).union(org).union(rest)
    )


def same_entity(entries: DataFrame, column: str) -> DataFrame:
    """(a, b) for all different entries of one entity, a < b."""
    known = Scratch(entries.sparkSession, "entities").cut(entities(entries, column), "entities")
    a, b = known.toDF("a", "entity"), known.toDF("b", "entity")
    return a.join(b, "entity").where("a < b").select("a", "b").distinct()
