"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matching, scores by length, exception phrases.

Folding drops marks that combine with letters and signs without width, then maps one character to one: case, accents,
look-alike letters of other scripts, and digits or signs that stand for letters. A match is a term between non-letters of
the text (a stem, written ``abc*``, only needs a start) that has a letter there, so that numbers don't match. A word counts
once: by its own entry, else by its longest stem. Words within an exception phrase, whatever white space it has, don't
count. The score is the sum of the weights of all words, divided by the number of words.

The lexicon is a seed list and the terms learned from labelled documents: words, and beginnings of words, with the
log-odds of their share in toxic and clean labelled documents, from at most ``MAX_LABELLED`` labelled rows. All terms that
reach the odds are kept; the bounded rows bound their number. Seeds win over learned terms of the same form.

Defined cases: a null or empty text scores 0 and is clean; texts of any length are matched whole; a null label is not used;
repeated rows are scored alike and repeated labels count once per row; of equal hashes of ids at the bound, ids and labels
decide; an empty table has no rows; further columns are carried and never read; without labels the seeds stand alone.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import small_batches

#: Labelled rows used to learn terms, by hash of their id.
MAX_LABELLED = 10_000
#: A document is toxic from this score on, if its matches weigh ``MIN_WEIGHT`` together: one seed, or two learned terms.
THRESHOLD, MIN_WEIGHT = 0.05, 6.0
SEEDS = {w: 8.0 for w in "idiot moron imbecile stupid scum trash loser clown pathetic worthless disgusting bastard asshole bitch whore cunt retard retarded faggot dumbass dipshit douchebag scumbag motherfucker vermin subhuman".split()} | {w: 6.0 for w in "shithead bullshit fuck fucking fucker idiotic moronic crap jerk arsehole wanker".split()} | {w: 6.0 for w in "arschloch hurensohn vollidiot schlampe wichser connard salope encule putain batard gilipollas cabron pendejo".split()}
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "trash collection", "clown fish", "class clown", "pond scum", "soap scum", "idiot proof", "stupid question", "sore loser")

_PAIRS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ſ": "s", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o"}
_SIGNS = dict(zip("0134578@$!|", "oieastbasil", strict=True))


def _table() -> dict[int, int]:
    out = {ord(k): ord(v) for k, v in _PAIRS.items()} | {ord(k): ord(v) for k, v in _SIGNS.items()}
    out |= {ord(k.upper()): v for k, v in ((k, ord(v)) for k, v in _PAIRS.items()) if len(k.upper()) == 1 and ord(k.upper()) > 127}
    for c in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA)]:
        base = unicodedata.normalize("NFKD", chr(c)).lower()[:1]
        if c not in out and base.isascii() and base.isalpha():
            out[c] = ord(base)
    return out


TABLE = _table()
_ASCII = bytes(TABLE.get(i, i) for i in range(256)) if all(v < 256 for v in TABLE.values()) else b""


#: Marks that combine with the letter before, and signs without width.
MARKS = "\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufeff"
_MARKS = re.compile(f"[{MARKS}]+")


def bare(text: str) -> str:
    """``text`` without marks and signs that have no place of their own."""
    return text if text.isascii() else _MARKS.sub("", text)


def fold(text: str) -> str:
    """Each character of ``text`` as a plain lower-case letter, as far as it stands for any."""
    return text.encode().translate(_ASCII).decode() if text.isascii() else text.translate(TABLE)


class Matcher:
    """Entries by folded term, and the exception phrases that hold one."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.words, self.stems = {}, {}
        for term, weight in lexicon.items():
            own, key = (self.stems if term.endswith("*") else self.words), fold(bare(term.removesuffix("*")))
            own[key] = max(weight, own.get(key, weight))
        self.found = ahocorasick.Automaton()
        for key in {*self.words, *self.stems}:
            if key:
                self.found.add_word(key, key)
        if len(self.found):
            self.found.make_automaton()
        phrases = sorted({tuple(fold(bare(p)).split()) for p in exceptions}, key=lambda p: (-len(p), p))
        self.phrases = re.compile("|".join(r"\s+".join(map(re.escape, p)) for p in phrases)) if phrases else None

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the words of ``text`` (without marks) that count."""
        folded, end = fold(text), len(text)
        best: dict[int, tuple] = {}
        for last, key in self.found.iter(folded):
            start, stop = last + 1 - len(key), last + 1
            if start and text[start - 1].isalnum():
                continue
            whole = key in self.words and not (stop < end and text[stop].isalnum())
            if (whole or key in self.stems) and any(c.isalpha() for c in text[start:stop]):
                best[start] = max(best.get(start, ()), (whole, len(key), stop, self.words[key] if whole else self.stems[key]))
        if not best:
            return []
        out = [(start, stop, weight) for start, (_, _, stop, weight) in sorted(best.items())]
        if self.phrases is not None:
            free = [m.span() for m in self.phrases.finditer(folded) if not (m.start() and text[m.start() - 1].isalnum() or m.end() < end and text[m.end()].isalnum())]
            if free:
                starts = [s for s, _ in free]
                out = [x for x in out if not ((i := bisect_right(starts, x[0])) and x[1] <= free[i - 1][1])]
        return out


def score(text: str | None, terms: Matcher) -> tuple[float, float, int, int]:
    """(score, weight, matches, words)."""
    words = len(text.split()) if text else 0
    if not words or not len(terms.found):
        return 0.0, 0.0, 0, words
    found = terms.matches(bare(text))
    total = sum(w for _, _, w in found)
    return total / words, total, len(found), words


def _scorer(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    @F.arrow_udf("struct<score: double, weight: double, hits: long, words: long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Matcher(lexicon, exceptions)
        for texts in batches:
            found = [score(t.as_py(), terms) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 4, (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["score", "weight", "hits", "words"])

    return run


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Terms of labelled documents, weighted by the log-odds of their mean share of a document's words: words of 4 toxic
    documents or more with 4 at least, beginnings of 5 to 8 letters with 3 at least that 6 different words share."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), (F.col(label_col) > 0).cast("int").alias("y")).orderBy(F.xxhash64("d"), "d", "y").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "d")
    src = "".join(map(chr, TABLE))
    dst = "".join(chr(v) for v in TABLE.values())
    keep = [i for i, c in enumerate(src) if c.isalpha() and ord(c) < 0x10000]
    plain = F.translate(F.lower(F.regexp_replace("t", f"[{MARKS}]+", "")), "".join(src[i] for i in keep), "".join(dst[i] for i in keep))
    words = F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) > 0)
    tokens = rows.select("d", "y", words.alias("ws")).select("d", "y", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    tokens = tokens.groupBy("d", "y", "n", "w").agg((F.count("*") / F.col("n")).alias("share"))
    share = lambda y: F.sum(F.when(F.col("y") == y, F.col("share")).otherwise(0.0))
    per_word = tokens.groupBy("w").agg(F.sum("y").alias("a"), share(1).alias("ra"), share(0).alias("rc"))
    sizes = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, clean = sizes[0] or 0, sizes[1] or 0
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("ra") / toxic + 1e-6) / (F.col("rc") / clean + 1e-6))
    lengths = F.filter(F.array(*[F.lit(n) for n in (5, 6, 7, 8)]), lambda n: n < F.length("w"))
    stems = per_word.select(F.explode(F.transform(lengths, lambda n: F.concat(F.substring("w", F.lit(1), n), F.lit("*")))).alias("w"), "a", "ra", "rc")
    stems = stems.groupBy("w").agg(F.sum("a").alias("a"), F.sum("ra").alias("ra"), F.sum("rc").alias("rc"), F.count("*").alias("kinds"))
    found = per_word.where("a >= 4").withColumn("o", odds).where("o >= 4").select("w", "a", "o").unionByName(stems.where("a >= 12 and kinds >= 6").withColumn("o", odds).where("o >= 3").select("w", "a", "o"))
    return {r["w"]: min(8.0, round(r["o"], 4)) for r in found.select("w", "o").collect()}


def lexicon_of(docs: DataFrame, labels: DataFrame | None, **options) -> dict[str, float]:
    """The seeds and what the labels teach."""
    return (learned(docs, labels, **options) if labels is not None else {}) | SEEDS


def scored(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into`` of score, weight, hits and words."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _scorer(lexicon, exceptions)(F.col(text_col)))


def _toxic(struct: str, threshold: float, min_weight: float) -> Column:
    return (F.col(f"{struct}.score") >= threshold) & (F.col(f"{struct}.weight") >= min_weight)


def toxic_documents(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """(doc_id, score, weight, hits, words) of the toxic documents."""
    found = scored(docs.select("doc_id", "text"), lexicon_of(docs, labels))
    return found.where(_toxic("toxicity", threshold, min_weight)).select("doc_id", "toxicity.*")


def without_toxic(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """``docs`` without the toxic ones."""
    into = "toxicity"
    while into in docs.columns:
        into += "_"
    return scored(docs, lexicon_of(docs, labels), into=into).where(~_toxic(into, threshold, min_weight)).drop(into)
