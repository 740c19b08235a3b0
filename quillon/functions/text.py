"""Analysis of text: tokens, stop words, numbers, stems, HTML, and texts without their memes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
#: Very common words of four languages; ``language_stop_words`` has longer lists.
STOP_WORDS = tuple(
    sorted(
        set(
            (
                "a an and are as at be but by for from had has have he her his i if in into is it its no not of on or she so such that the their then there these "
                "they this to was we were what when which who will with you au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes "
                "ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes tu un une vos vous aber als am an auch auf aus bei bin bis da das dass "
                "dem den der die doch ein eine einem einen einer er es hat ich ihr im ist kann mich mir mit nach nicht noch nur oder sich sie sind so und uns von vor "
                "war wie wir zu zum zur al como con del desde donde dos ella ellos en entre era es esta este fue ha hay la las lo los mas mi muy no nos o para pero "
                "por que se ser si sin sobre su sus te tiene un una y ya yo"
            ).split()
        )
    )
)


LANGUAGES = ("danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish")


def language_stop_words(spark: SparkSession, languages: tuple[str, ...] = LANGUAGES) -> list[str]:
    """Spark's own lists, merged: all that it has, unless told otherwise.  The analyzers take the result as their stop_words."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w for x in languages for w in StopWordsRemover.loadDefaultStopWords(x)})


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_number(term: Column) -> Column:
    """Hexadecimal with its 0x, or a term without any letter beyond a to f: "cafe" counts as a number, as "1984" does."""
    return term.rlike("^0x[0-9a-f]+$") | ~term.rlike(r"[\p{L}&&[^a-f]]")


def analyze(text: Column, stop_words: tuple[str, ...] | list[str] = STOP_WORDS, drop_numbers: bool = False) -> Column:
    """Tokens without stop words, and without numbers on demand; in order, repeats kept."""
    found = F.filter(tokens(text), lambda t: ~t.isin(list(stop_words))) if stop_words else tokens(text)
    return F.filter(found, lambda t: ~is_number(t)) if drop_numbers else found


def explode_terms(rows: DataFrame, text: Column, name: str, keep: list[Column | str], stop_words: tuple[str, ...] | list[str] = STOP_WORDS, drop_numbers: bool = False) -> DataFrame:
    """One row a term, repeats kept: the same terms as ``analyze``, but tested one by one after the explode, in generated code."""
    found = rows.select(*keep, F.explode(tokens(text)).alias(name))
    if stop_words:
        found = found.where(~F.col(name).isin(list(stop_words)))
    return found.where(~is_number(F.col(name))) if drop_numbers else found


def terms(text: Column, stop_words: tuple[str, ...] | list[str] = STOP_WORDS, drop_numbers: bool = False) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(analyze(text, stop_words, drop_numbers))


def split_terms(text: Column, separator: str) -> Column:
    """Terms between separators: trimmed, lower case, none empty."""
    return F.filter(F.transform(F.split(text, separator), lambda t: F.trim(F.lower(t))), lambda t: t != "")


def blank_out(text: Column, memes: Column) -> Column:
    """The text with every given substring replaced by as many blanks, longest first."""
    ordered = F.reverse(F.array_sort(F.transform(memes, lambda m: F.struct(F.length(m).alias("n"), m.alias("m")))))
    return F.aggregate(ordered, text, lambda t, m: F.replace(t, m["m"], F.repeat(F.lit(" "), m["n"])))


def meme_text(memes: Column) -> Column:
    """Memes joined by tabs."""
    return F.array_join(memes, "\t")


def leading_count(text: Column) -> Column:
    """The number that a text such as "100+" begins with."""
    return F.regexp_extract(text, r"^(\d+)", 1).try_cast("long")


def whole_word(text: Column, word: str) -> Column:
    """The word with no letter next to it."""
    return text.rlike(rf"(?<!\p{{L}}){re.escape(word)}(?!\p{{L}})")


def word_counts_tokens(text: Column) -> Column:
    """Words, #tags and @names of a post: split at white space, trailing signs stripped, the rest kept if it is one of them."""
    stripped = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]+$", ""))
    return F.filter(stripped, lambda t: t.rlike(r"^[#@]?[\p{L}\p{N}_]+$"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Text nodes, trimmed, one a line; comments and mark-up dropped."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        parser.close()
        return "\n".join(parser.parts)

    return html.map(one)


def strip_tags(html: Column) -> Column:
    """The same by regular expressions alone, for plans that are to stay in the JVM: comments, then tags, become blanks.
    Entities stay as they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))


# Porter's stemmer, from his paper's rules.
def _measure(stem: str) -> int:
    form = re.sub("[aeiou]+|(?<=[^aeiou])y", "V", stem)
    return len(re.findall("V[^V]+", form))


def _vowel(stem: str) -> bool:
    return bool(re.search("[aeiou]|(?<=[^aeiou])y", stem))


def _cvc(word: str) -> bool:
    return bool(re.search("[^aeiou][aeiouy][^aeiouwxy]$", word))


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    again = False
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and _vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"([^aeiouylsz])\1$", word):
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for rule in sorted((r.split(":") for r in table.split()), key=lambda r: -len(r[0])):
            if word.endswith(rule[0]):
                if _measure(word[: -len(rule[0])]) > 0:
                    word = word[: -len(rule[0])] + rule[1]
                break
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Porter's stem of each word; each distinct word of a batch is stemmed once."""
    known: dict[str, str] = {}

    def one(w: str | None) -> str | None:
        if w is None:
            return None
        if w not in known:
            known[w] = porter(w)
        return known[w]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])
