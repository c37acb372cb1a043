"""URL filter: host and path rules first, then a weighted vocabulary matched by one Aho-Corasick automaton.

A term counts only with boundaries: the characters beside it are not ASCII letters or digits. Every term has a weight. Terms
of at least the weight ``reject`` are strict, and one of them rejects the URL; the others are soft, and reject it where
``soft_needed`` distinct ones or more weigh ``reject`` together. The longest rule whose host equals the URL's host or is a
parent domain of it, and whose path begins the URL's path, decides before the vocabulary does.

The vocabulary names what a site offers, and only words that hardly occur in addresses otherwise; parts that are common in any
address (blog, ref, utm, page, feed) are none of its business. It is a parameter.

Nulls: a null or relative URL has empty host and path, meets no rule, and is judged by the vocabulary (null: allowed). Very
long URLs are read whole, in one pass. Each row is judged by itself, so repeated rows get equal verdicts and empty tables give
no rows. Other columns pass through; host, path, strict_hits, soft_hits, weight, rule and verdict replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A strict term weighs as much as a rejection takes.
REJECT, SOFT_NEEDED = 3, 2
STRICT = "porn porno pornos xxx hentai camgirls escorts bdsm hardcore casino warez malware phishing ransomware botnet viagra cialis".split()
#: Terms that tell something on their own, and terms that tell only beside others.
HEAVY = "adult adults sex sexo nude nudes erotic dating hookup betting bets poker slots roulette jackpot payday pills steroids torrent torrents keygen keygens cracked spam malicious".split()
LIGHT = "cheap free win winner winners bonus bet loan loans credit discount replica crack farm proxy unblocked download downloads promo lottery".split()
VOCABULARY = dict.fromkeys(LIGHT, 1) | dict.fromkeys(HEAVY, 2) | dict.fromkeys(STRICT, REJECT)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def term_hits(vocabulary: dict[str, int], reject: int):
    """A pandas UDF: URL to struct(strict, soft, weight): distinct bounded terms of each kind in it, and what the soft ones weigh."""

    @F.pandas_udf("strict int, soft int, weight int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            machine.add_word(term.lower(), (term.lower(), weight))
        machine.make_automaton()
        for urls in batches:
            out = []
            for url in urls:
                u = _lower(url or "")
                seen: dict[str, int] = {}
                for end, (term, weight) in machine.iter(u):
                    before, after = end - len(term), end + 1
                    if (before < 0 or not _inner(u[before])) and (after >= len(u) or not _inner(u[after])):
                        seen[term] = weight
                soft = [w for w in seen.values() if w < reject]
                out.append((len(seen) - len(soft), len(soft), sum(soft)))
            yield pd.DataFrame(out, columns=["strict", "soft", "weight"])

    return hits


def _lower(url: str) -> str:
    """A-Z lower-cased, other letters as they are."""
    return url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def judge(df: DataFrame, url: str = "url", rules=RULES, vocabulary: dict[str, int] = VOCABULARY, reject: int = REJECT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """``df`` with host, path, strict_hits, soft_hits, weight, rule and verdict."""
    u = F.col(url)
    out = df.withColumn("_tessera_host", host_of(u)).withColumn("_tessera_path", path_of(u))
    rule = rule_of(F.col("_tessera_host"), F.col("_tessera_path"), rules)
    out = out.withColumn("_tessera_hits", term_hits(vocabulary, reject)(u)).withColumn("_tessera_rule", rule)
    hits = F.col("_tessera_hits")
    rejected = (hits["strict"] >= 1) | (hits["soft"] >= soft_needed) & (hits["weight"] >= reject)
    new = {
        "host": F.col("_tessera_host"),
        "path": F.col("_tessera_path"),
        "strict_hits": hits["strict"],
        "soft_hits": hits["soft"],
        "weight": hits["weight"],
        "rule": F.col("_tessera_rule.rule"),
        "verdict": F.coalesce(F.col("_tessera_rule.verdict"), F.when(rejected, "block").otherwise("allow")),
    }
    return out.withColumns(new).drop("_tessera_host", "_tessera_path", "_tessera_hits", "_tessera_rule")
