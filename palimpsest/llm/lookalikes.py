"""Problem 2: one form for text that looks the same in print (script-aware repair)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.runtime import Scratch

# Letters of other scripts that are printed like a Latin letter.
LOOKALIKES = {
    "LATIN": {"ɡ": "g", "ɑ": "a", "ı": "i"},
    "CYRILLIC": {
        "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
        "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E",
        "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T",
        "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ԍ": "G",
    },
    "GREEK": {
        "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "Α": "A",
        "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
        "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j",
    },
    "ARMENIAN": {
        "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "ա": "w", "Օ": "O", "Տ": "S", "Լ": "L",
    },
}
TO_LATIN = {k: v for pairs in LOOKALIKES.values() for k, v in pairs.items()}
FROM_LATIN = {
    script: {v: k for k, v in reversed(pairs.items())} for script, pairs in LOOKALIKES.items() if script != "LATIN"
}
DISGUISED = {v for pairs in FROM_LATIN.values() for v in pairs}
# Hyphens, and marks that are not printed though their category is not Cf.
HYPHENS = "‐‑"
UNPRINTED = "͏ᅟᅠ឴឵᠎"
# Kinds of compatibility forms that differ in print: a raised 2 is not a 2.
VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")
LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


@lru_cache(maxsize=65536)
def print_form(c: str) -> str:
    """The one character, or few, by which a character is written after folding; empty if nothing is printed."""
    kind = unicodedata.category(c)
    if kind == "Cf" or c in UNPRINTED or "︀" <= c <= "️" or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if kind == "Zs" or c in "\t\n\r\v\f\x85  ":
        return " "
    if c in HYPHENS:
        return "-"
    if c == "…" or unicodedata.decomposition(c).startswith(VISIBLE):
        return c
    folded = unicodedata.normalize("NFKC", c)
    return c if folded.startswith(" ") else folded


def fold(text: str) -> str:
    """Width, compatibility, composition, kinds of space and unprinted characters; look-alikes are left."""
    return unicodedata.normalize("NFC", "".join(map(print_form, text)))


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def _convert(token: str, to: str) -> str | None:
    """The token in one script, or None where a letter of another script has no look-alike in it."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if unicodedata.combining(c):
            out.append(c)
            continue
        if to == "LATIN":
            c = TO_LATIN.get(c, c)
        elif script(c) != to:
            c = FROM_LATIN.get(to, {}).get(TO_LATIN.get(c, c), c)
        if script(c) != to and not (to == "LATIN" and c in "Ωωμ"):  # units stay Greek beside Latin
            return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def repairs(token: str, around: str) -> list[str]:
    """Forms of a token to look up, best first: in its dominant script, then in that of the text around, then Latin."""
    count: dict[str, int] = {}
    for c in unicodedata.normalize("NFD", token):
        if not unicodedata.combining(c):
            count[script(c)] = count.get(script(c), 0) + 1
    mixed = len(count) > 1 or any(c in LOOKALIKES["LATIN"] for c in token)
    if not mixed and (around in count or not all(c in TO_LATIN for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))):
        return []
    main = max(sorted(count), key=lambda s: (count[s], s == "LATIN"))
    tries = ([main] if mixed else []) + [around, "LATIN"]
    found = [_convert(token, s) for s in dict.fromkeys(tries)]
    return [x for x in dict.fromkeys(found) if x and x != token]


def dissect(text: str) -> list[tuple[str, list[str]]]:
    """The folded text in pieces, each with the repairs to look up for it; one piece if nothing is suspicious."""
    text = fold(text)
    if text.isascii():
        return [(text, [])]
    count: dict[str, int] = {}
    for c in text:  # letters that another script shares tell nothing: a disguised title holds hundreds of them
        if c.isalpha() and c not in TO_LATIN and c not in DISGUISED and (s := script(c)) != "CJK":
            count[s] = count.get(s, 0) + 1
    around = max(sorted(count), key=lambda s: (count[s], s == "LATIN")) if count else "LATIN"
    pieces: list[tuple[str, list[str]]] = []
    at = 0
    for m in LETTERS.finditer(text):
        if m[0].isascii():
            continue
        if tries := repairs(m[0], around):
            if m.start() > at:
                pieces.append((text[at : m.start()], []))
            pieces.append((m[0], tries))
            at = m.end()
    if at < len(text) or not pieces:
        pieces.append((text[at:], []))
    return pieces


@F.pandas_udf(T.ArrayType(T.StructType().add("piece", "string").add("tries", T.ArrayType(T.StringType()))))
def _dissect(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"piece": p, "tries": r} for p, r in dissect(t)])


def one_form(texts: DataFrame, column: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(stored, form) for every distinct non-null text of ``column``.

    A token of mixed scripts is rewritten in its dominant script (else in that of the text, else in
    Latin) when the result is a word of the corpus: a letter run of one script that occurs, without
    regard to case, in any folded text (or in ``vocabulary``, one string column). A token of one
    foreign script made of look-alikes only, such as a lone Cyrillic a between Latin words, is taken
    likewise. Other tokens stay as they are, and so do case, accents and punctuation.

    - null texts give no row; an empty text gives the empty form; repeated texts give one row;
    - texts may have any length; an empty table gives an empty result.

    Texts of plain ASCII never reach Python. Words and repairs meet in a shuffle join, as both grow.
    """
    spark = texts.sparkSession
    stored = texts.select(F.col(column).alias("stored")).where("stored IS NOT NULL").distinct()
    plain = F.col("stored").rlike(r"^[\x20-\x7e]*$")
    # pieces carry a number and not their text, which may be long and in thousands of pieces
    cut = stored.where(~plain).withColumn("pieces", _dissect("stored")).withColumn("no", F.monotonically_increasing_id())
    cut = Scratch(spark, "one-form").cut(cut, "pieces")
    whole = F.array_join(F.col("pieces.piece"), "")
    if vocabulary is None:
        folded = stored.where(plain).select(F.col("stored").alias("t")).union(cut.select(whole.alias("t")))
        words = folded.select(F.explode(F.split(F.lower("t"), r"[^\p{L}\p{M}]+")).alias("word"))
    else:
        words = vocabulary.toDF("word").select(F.lower("word").alias("word"))
    words = words.where("word <> ''").distinct()
    suspicious = cut.where(F.exists("pieces", lambda p: F.size(p["tries"]) > 0))
    pieces = suspicious.select("no", F.posexplode("pieces").alias("pos", "p")).select("no", "pos", "p.piece", "p.tries")
    asked = pieces.where(F.size("tries") > 0).select("piece", F.posexplode("tries").alias("rank", "try")).distinct()
    granted = (
        asked.join(words, F.lower("try") == F.col("word"), "left_semi")
        .groupBy("piece")
        .agg(F.min(F.struct("rank", "try"))["try"].alias("repaired"))
    )
    rebuilt = (
        pieces.select("no", "pos", "piece")
        .join(granted, "piece", "left")
        .groupBy("no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("repaired", "piece").alias("piece")))).alias("a"))
        .select("no", F.array_join(F.col("a.piece"), "").alias("form"))
    )
    repaired = suspicious.select("no", "stored").join(rebuilt, "no").select("stored", "form")
    return (
        stored.where(plain)
        .select("stored", F.col("stored").alias("form"))
        .union(cut.where(~F.exists("pieces", lambda p: F.size(p["tries"]) > 0)).select("stored", whole.alias("form")))
        .union(repaired)
    )


def same_print(records: DataFrame, key: str, column: str) -> DataFrame:
    """(a, b) for pairs of keys whose texts are printed alike but are not the same characters.

    a < b as strings; each pair once, also when a key recurs. Null keys and null texts are in no pair.
    """
    one = records.select(F.col(key).alias("k"), F.col(column).alias("stored")).where("k IS NOT NULL AND stored IS NOT NULL").distinct()
    forms = one_form(one, "stored")
    several = forms.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    named = one.join(forms.join(several, "form", "left_semi"), "stored")
    a, b = named.toDF("stored_a", "a", "form"), named.toDF("stored_b", "b", "form")
    return a.join(b, "form").where("a < b AND stored_a <> stored_b").select("a", "b").distinct()
