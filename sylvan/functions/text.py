"""Column functions over text: folding, tokens, overlap, summaries, field splits. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_LATIN = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.normalize("NFD", chr(c)) != chr(c)]
#: Lower-case letters with marks and their plain letters, for ``translate``.
FOLD_FROM, FOLD_TO = "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN)
CJK = "[\\u4e00-\\u9fff\\u3400-\\u4dbf]"
#: Words left out of queries and of filtered tokens.
STOP_WORDS = tuple(sorted(set("you your would with why whom who which where when what were we was very us under too to through this those they these then their them the than that such so some should shall she same over our other or only on of not nor no my most more might me may into its it is in if i how his him her he have has had from for few every each during down does do did could can by but both between below being been before be at as are any and an all also again after above about a".split())))


_UNSPOKEN = ("a", "an", "the", "usd", *(w + e for w in ("million", "billion", "thousand", "dollar") for e in ("", "s")))


def plain(text: Column) -> Column:
    """Whether all signs are ASCII."""
    return F.length(text) == F.octet_length(text)


def fold(text: Column) -> Column:
    """Lower case without marks. Plain texts have none, so they aren't looked through sign by sign."""
    return F.when(plain(text), F.lower(text)).otherwise(F.translate(F.lower(text), FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Index tokens: folded runs of letters and digits; ``_`` and ``-`` separate; a null text has none."""
    return F.array_remove(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), "")


def cjk_tokens(text: Column, mode: str = "bigram", dictionary: tuple[str, ...] = ()) -> Column:
    """Tokens whose runs of Chinese or Japanese ideographs become overlapping pairs (``bigram``), single signs (``char``),
    or the longest words of ``dictionary`` from the left, other signs alone (``word``)."""
    runs = F.regexp_extract_all(F.coalesce(fold(text), F.lit("")), F.lit(f"({CJK}+|(?:(?!{CJK})[\\p{{L}}\\p{{N}}])+)"), F.lit(1))
    if mode == "word":
        return F.flatten(F.transform(runs, lambda run: F.when(run.rlike(CJK), F.regexp_extract_all(run, F.lit(word_pattern(dictionary)), F.lit(0))).otherwise(F.array(run))))
    size = 2 if mode == "bigram" else 1

    def split(run: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substring(run, i, F.lit(size)))
        return F.when(run.rlike(CJK) & (F.length(run) >= size), parts).otherwise(F.array(run))

    return F.flatten(F.transform(runs, split))


def word_pattern(dictionary: tuple[str, ...]) -> str:
    """Words of a dictionary, the longest first, and any other sign alone."""
    return "|".join([*sorted({w for w in dictionary if w}, key=lambda w: (-len(w), w)), "."])


def index_tokens(text: Column, mode: str = "bigram", dictionary: tuple[str, ...] = ()) -> Column:
    """Tokens of an indexed text: those of :func:`cjk_tokens` where it holds an ideograph, else plain ones."""
    return F.when(~plain(text) & text.rlike(CJK), cjk_tokens(text, mode, dictionary)).otherwise(tokens(text))


def search_tokens(text: Column, stop_words: bool = True, least: int = 2) -> Column:
    """Lower-case words of two characters or more, without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda x: F.length(x) >= least)
    return F.filter(words, lambda x: ~x.isin(*STOP_WORDS)) if stop_words else words


def normal_title(title: Column) -> Column:
    """Lower case, white space collapsed; empty becomes ``_``."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return F.when(text == "", F.lit("_")).otherwise(text)


def summary(text: Column, most: int = 600, head: int = 250, tail: int = 100) -> Column:
    """Short texts whole; of long ones the beginning and the end on one line."""
    flat = lambda c: F.trim(F.regexp_replace(c, "\n", " "))
    return F.when(F.length(text) < most, text).otherwise(F.concat(flat(F.substring(text, 1, head)), F.lit(" ... "), flat(F.right(text, F.lit(tail)))))


def md_fields(text: Column) -> list[Column]:
    """``front_matter``, ``code_blocks`` and ``body`` of a Markdown text."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    rest = F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    code = F.array_join(F.regexp_extract_all(rest, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1)), "\n")
    body = F.trim(F.regexp_replace(F.regexp_replace(rest, r"(?s)```[^\n]*\n.*?```", ""), r"\n{3,}", "\n\n"))
    return [front.alias("front_matter"), code.alias("code_blocks"), F.regexp_replace(body, r"\A\s+|\s+\z", "").alias("body")]


def overlap(text: Column, terms: Column, weights: Column | None = None) -> Column:
    """Share of ``terms`` (weighted by the map ``weights`` if given) that lower(text) contains as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    weigh = (lambda t: F.coalesce(F.element_at(weights, t), F.lit(1.0))) if weights is not None else (lambda t: F.lit(1.0))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + weigh(t))
    found = F.aggregate(F.filter(terms, lambda t: F.contains(low, t)), F.lit(0.0), lambda a, t: a + weigh(t))
    return F.when(total > 0, found / total).otherwise(0.0)


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(t)))


def highlight(text: Column, terms: list[str], before: str = "«", after: str = "»") -> Column:
    """Occurrences of any term between marks."""
    import re

    if not terms:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + ")", f"{before}$1{after}")


def human_size(size: Column) -> Column:
    """Bytes as B, KB or MB."""
    return (F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024.0)).otherwise(F.format_string("%.1f MB", size / (1024.0 * 1024))))


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis if cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def normal_answer(text: Column) -> Column:
    """Answers for comparison: lower case, without punctuation (but points and percents), articles and magnitude words."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s.%]", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*_UNSPOKEN)), " ")
