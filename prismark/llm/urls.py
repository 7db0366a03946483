"""URL filter: explicit rules for hosts and paths, and a weighted vocabulary where no rule fits.

The vocabulary is matched by one Aho-Corasick automaton over the lower-cased url. A term counts where no ASCII
letter or digit touches it. One strict term, or `soft_needed` distinct soft terms, reject.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default vocabulary.
STRICT = ("bdsm", "camgirl", "camgirls", "casino", "casinos", "erotica", "escort", "escorts", "fetish", "gangbang", "hardcore", "hentai", "keygen", "milf", "nsfw", "phishing", "porn", "porno", "pornography", "pornstar", "sexcam", "sexshop", "warez", "xvideos", "xxx")
SOFT = (
    "adult", "bet", "bets", "betting", "blackjack", "bonus", "cam", "cams", "cheap", "cialis", "counterfeit", "crack", "cracked", "dating", "deals", "discount", "download", "farm", "free", "gambling", "hookup", "jackpot", "lingerie",
    "loan", "loans", "lottery", "naked", "nude", "nudes", "payday", "pharmacy", "pills", "poker", "promo", "replica", "roulette", "sex", "sexy", "slots", "spam", "torrent", "torrents", "viagra", "webcam", "win", "x",
)
SOFT_NEEDED = 2
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict))
    found.make_automaton()
    return found


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def terms(url: str, found) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms of a lower-cased url."""
    strict, soft = set(), set()
    for end, (term, hard) in found.iter(url):
        start = end - len(term) + 1
        if not (start and _word(url[start - 1])) and not (end + 1 < len(url) and _word(url[end + 1])):
            (strict if hard else soft).add(term)
    return strict, soft


def _count(strict: tuple, soft: tuple):
    def run(batches):
        found = automaton(strict, soft)
        table = str.maketrans(_UPPER, _LOWER)
        for batch in batches:
            hits = [terms((u or "").translate(table), found) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(a) for a, _ in hits], pa.int32()), pa.array([len(b) for _, b in hits], pa.int32())], names=[*batch.schema.names, "n_strict", "n_soft"])

    return run


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_needed: int = SOFT_NEEDED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) for every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host and path together
    win, among equally long ones the first given. Where none fits, rule is null and the vocabulary decides. A null or
    empty url has an empty host and path and is allowed. Repeated rows stay; other columns are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    counted = pages.mapInArrow(_count(tuple(strict), tuple(soft)), f"page_id {kind}, url string, n_strict int, n_soft int")
    host, path = host_and_path(F.col("url"))
    counted = counted.withColumns({"host": host, "path": path})
    vocabulary = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_needed), "block").otherwise("allow")
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    rule = F.lit(None).cast("string") if rule is None else rule.otherwise(F.lit(None).cast("string"))
    verdict = vocabulary if verdict is None else verdict.otherwise(vocabulary)
    return counted.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def oracle_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_needed=SOFT_NEEDED) -> str:
    """The same over `pages`, one boundary-checked pattern for each term."""
    hit = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)"
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
counted AS (
  SELECT page_id, host, path, CAST({" + ".join(map(hit, strict))} AS INTEGER) AS n_strict,
    CAST({" + ".join(map(hit, soft))} AS INTEGER) AS n_soft FROM split)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_strict > 0 OR n_soft >= {soft_needed} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM counted"""
