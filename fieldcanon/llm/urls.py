"""URL filtering by host rules and a weighted vocabulary found with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The vocabulary. One strict term rejects a URL, soft terms only together.
STRICT = (
    "adult-videos", "camgirls", "cheap-pills", "cheap-viagra", "cialis", "crack-download", "escort-service", "free-porn",
    "hardcore", "hentai", "keygen", "levitra", "malware", "online-casino", "payday-loan", "payday-loans", "phishing",
    "porn", "pornhub", "porno", "sex-chat", "spam-farm", "spamfarm", "viagra", "warez", "xxx",
)
SOFT = (
    "adult", "bet", "betting", "bitcoin", "bonus", "casino", "cheap", "click", "coupon", "crack", "dating", "deal",
    "discount", "escort", "farm", "forex", "free", "gambling", "giveaway", "jackpot", "loan", "loans", "lottery", "nude",
    "pharmacy", "pill", "pills", "poker", "prize", "sex", "slots", "spam", "torrent", "win", "winner",
)
#: So many different soft terms reject a URL.
SOFT_HITS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.startswith(F.col("path"), F.lit(rule.path))


def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (False, term))
    for term in strict:
        found.add_word(term, (True, term))
    found.make_automaton()
    return found


def count_terms(text: str, automaton) -> tuple[int, int]:
    """Different strict and soft terms in a lower-case text that no ASCII letter or digit touches."""
    strict, soft = set(), set()
    for end, (hard, term) in automaton.iter(text):
        start = end - len(term)
        before, after = text[start] if start >= 0 else "", text[end + 1 : end + 2]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            (strict if hard else soft).add(term)
    return len(strict), len(soft)


def url_verdicts(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_hits: int = SOFT_HITS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Return ``page_id, host, path, rule, verdict, n_strict, n_soft`` for every row of ``pages``.

    Of the rules that fit, the longest (host and path together; of equal ones the first given)
    decides, and ``rule`` is its name; without one ``rule`` is null and the vocabulary decides:
    one strict term, or ``soft_hits`` different soft ones, anywhere in the URL (A-Z lower-cased),
    query and fragment included, block. URLs without ``://`` have empty host and path, and the
    vocabulary judges them like any other; null and empty URLs are allowed. URLs may be of any
    length. Repeated rows and null ids are kept; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """

    @F.pandas_udf("n_strict int, n_soft int")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(strict, soft) if strict or soft else None
        for batch in texts:
            yield pd.DataFrame([count_terms(t, automaton) if automaton else (0, 0) for t in batch], columns=["n_strict", "n_soft"], dtype="int32")

    host, path = host_and_path(F.col(url_col).cast("string"))
    whole = F.coalesce(F.translate(F.col(url_col).cast("string"), _UPPER, _LOWER), F.lit(""))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), whole.alias("whole"))
    best = sorted(rules, key=lambda r: -len(r.name))
    verdict = F.coalesce(*(F.when(_fits(r), r.verdict) for r in best), F.lit(None).cast("string"))
    rule = F.coalesce(*(F.when(_fits(r), r.name) for r in best), F.lit(None).cast("string"))
    judged = split.select("*", rule.alias("rule"), verdict.alias("by_rule"), counts("whole").alias("terms"))
    by_terms = F.when((F.col("terms.n_strict") > 0) | (F.col("terms.n_soft") >= soft_hits), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_terms).alias("verdict"), "terms.n_strict", "terms.n_soft")


def oracle_sql() -> str:
    """DuckDB SQL of the registered query."""
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))" for r in ordered]
    rule = "case " + " ".join(f"when {f} then '{r.name}'" for f, r in zip(fits, ordered)) + " end"
    by_rule = "case " + " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, ordered)) + " end"
    count = lambda terms: " + ".join(f"cast(regexp_matches(t, '(^|[^a-z0-9]){x}($|[^a-z0-9])') as int)" for x in terms)
    return f"""
        with s as (select page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as t, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
        h as (select page_id, t, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s),
        c as (select *, {count(STRICT)} as n_strict, {count(SOFT)} as n_soft from h)
        select page_id, host, path, {rule} as rule,
               coalesce({by_rule}, case when n_strict > 0 or n_soft >= {SOFT_HITS} then 'block' else 'allow' end) as verdict, n_strict, n_soft
        from c"""
