"""Url filter by empirical-Bayes reputation of hosts.

Labelled pages have good or bad outcomes. The share of bad ones is estimated for each suffix, registered domain and host
with a beta prior whose mean is the estimate one level up (at the top, that of all labelled pages) and whose weight comes
from the data: the correlation of outcomes within the units of the level, by moments of the beta-binomial. A host with few
labelled pages so stays near its domain, and a domain near its suffix. A page is kept unless the lower bound of its host's
posterior (mean less ``Z`` standard deviations) exceeds ``MAX_BAD``: only hosts that are surely bad go.

Which suffixes have more than one label is an argument; by default it is a list of the countries' registries.

Defined cases: a url that is null or has no host belongs to the host "", which has no labels and the prior of all pages; a
url of any length is read for its host alone; null outcomes are not counted; repeated rows count apiece; a bound equal to
the limit is kept; without labels every host has mean 0.5 and is kept; an empty table has no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import maybe_broadcast, stored

Z, MAX_BAD = 1.645, 0.30
#: Second labels under which a country's names are registered, from the public registries' own pages. A full public-suffix
#: table is an argument of every call here.
_SECOND = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi maori net org school", "za": "ac co edu gov law mil net nom org school web", "jp": "ac ad co ed go gr lg ne or",
    "kr": "ac co go mil ne or pe re", "in": "ac co edu firm gen gov ind mil net nic org res", "cn": "ac com edu gov mil net org", "tw": "club com ebiz edu game gov idv mil net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per",
    "my": "com edu gov mil name net org", "th": "ac co go in mi net or", "id": "ac biz co desa go mil my net or sch web", "ph": "com edu gov mil net ngo org", "vn": "ac biz com edu gov health info int name net org pro", "br": "adv art blog com edu eco eng gov ind inf jus leg mil net org",
    "mx": "com edu gob net org", "ar": "com edu gob gov int mil net org tur", "co": "com edu gov mil net nom org", "pe": "com edu gob mil net nom org", "ve": "co com edu gob info mil net org web", "ec": "com edu fin gob gov info med mil net org pro", "uy": "com edu gub mil net org",
    "tr": "av bel biz com dr edu gen gov info k12 kep mil name net org pol tel tv web", "il": "ac co gov idf k12 muni net org", "sa": "com edu gov med net org pub sch", "ae": "ac co gov mil net org sch", "eg": "com edu eun gov mil name net org sci", "ng": "com edu gov i mil mobi name net org sch",
    "ke": "ac co go info me mobi ne or sc", "gh": "com edu gov mil org", "tz": "ac co go hotel info me mil mobi ne or sc tv", "ug": "ac co com go ne or org sc", "pk": "biz com edu fam gob gok gon gop gos gov info net org web", "bd": "ac com edu gov info mil net org", "lk": "ac com edu gov hotel ltd net ngo org sch soc web",
    "np": "com edu gov mil net org", "ua": "com edu gov in net org kiev lviv", "pl": "agro biz com edu gmina gov info mil net org waw", "ru": "ac com edu gov int mil net org pp", "gr": "com edu gov net org", "pt": "com edu gov int net nome org publ", "es": "com edu gob nom org", "it": "edu gov", "hu": "co info org sport tm",
    "ro": "arts com firm info nom nt org rec store tm www", "at": "ac co gv or", "cy": "ac biz com ekloges gov ltd name net org parliament press pro tm", "mt": "com edu net org",
}
#: Suffixes of more than one label under which names are registered, besides every single label.
SUFFIXES = (*sorted(f"{x}.{country}" for country, names in _SECOND.items() for x in names.split()), "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app", "wordpress.com")
#: Bounds of the correlation, and its value where no unit has two labelled pages that could tell.
_LEAST, _MOST, _NONE = 0.001, 0.9, 0.5


def parts_of(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> list[Column]:
    """host, domain, suffix of a url: the domain is the suffix and one label more."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    last2, last3 = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    double = last2.isin(*suffixes)
    return [host.alias("host"), F.when(double, last3).otherwise(last2).alias("domain"), F.when(double, last2).otherwise(F.substring_index(host, ".", -1)).alias("suffix")]


def _shrunk(units: DataFrame, level: str) -> DataFrame:
    """``units`` (level, k, n, m) with the posterior: ``mean`` and ``weight`` (its two counts added)."""
    m = F.col("m")
    seen = units.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2) / (m * (1 - m))).alias("q"), F.count("*").alias("u"), F.sum(F.col("n") - 1).alias("d")
    )
    rho = F.when(F.col("d") > 0, F.least(F.greatest((F.col("q") - F.col("u")) / F.col("d"), F.lit(_LEAST)), F.lit(_MOST))).otherwise(F.lit(_NONE))
    strength = seen.select((1 / rho - 1).alias("s"))
    return units.crossJoin(F.broadcast(strength)).select(level, ((F.col("s") * m + F.col("k")) / (F.col("s") + F.col("n"))).alias("mean"), (F.col("s") + F.col("n")).alias("weight"), *[c for c in units.columns if c in ("domain", "suffix") and c != level])


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, z: float = Z) -> DataFrame:
    """(host, n, mean, lower, upper) of each host of ``pages`` (url, key); ``outcomes`` is (key, bad 0/1)."""
    bad = outcomes.where("bad is not null and key is not null").groupBy("key").agg(F.sum("bad").alias("bad"), F.count("*").alias("seen"))
    rows = pages.select("key", *parts_of(F.col("url"), suffixes)).join(bad, "key", "left")
    hosts = stored(rows.groupBy("host", "domain", "suffix").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("k"), F.coalesce(F.sum("seen"), F.lit(0)).alias("n")), "hosts")
    top = hosts.where("host <> ''").agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m"))
    count = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    # each level is a table, so that none is worked out again by those below it
    suffix = stored(_shrunk(hosts.groupBy("suffix").agg(*count).crossJoin(F.broadcast(top)), "suffix"), "suffixes")
    domain = stored(hosts.groupBy("domain", "suffix").agg(*count).join(suffix.select("suffix", F.col("mean").alias("m")), "suffix"), "domains")
    domain = _shrunk(domain, "domain")
    host = stored(hosts.join(domain.select("domain", "suffix", F.col("mean").alias("m")), ["domain", "suffix"]), "host-priors")
    found = _shrunk(host, "host").join(hosts.select("host", "n"), "host")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return found.select("host", "domain", "suffix", "n", "mean", F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("lower"), F.least(F.col("mean") + z * sd, F.lit(1.0)).alias("upper"))


def filtered(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD, suffixes: tuple[str, ...] = SUFFIXES, z: float = Z) -> DataFrame:
    """(page_id, url, host, mean, lower, kept) of each row of ``pages`` (page_id, url, key)."""
    hosts = stored(reputation(pages, outcomes, suffixes, z).select("host", "mean", "lower"), "reputation")
    rows = pages.select("page_id", "url", parts_of(F.col("url"), suffixes)[0])
    return rows.join(maybe_broadcast(hosts), "host").select("page_id", "url", "host", F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"), (F.round("lower", 6) <= max_bad).alias("kept"))
