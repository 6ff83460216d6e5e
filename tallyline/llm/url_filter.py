"""URL filter: host and path rules first, then a weighted vocabulary over the whole URL.

The vocabulary has strict and soft terms. One Aho-Corasick pass over a URL finds all
terms; a hit counts only where no ASCII letter or digit stands before or after it. A URL
is blocked by one strict term, or by several different soft ones.

Rules and vocabulary are settings, given as Python lists: they don't grow with the data,
and their size is checked. Every URL is judged alone, so nothing is shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits
no rule; a null or empty URL has no terms and is allowed. Rows are kept as they are,
repeated ones too; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, sent

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SETTINGS_BYTES = 16_000_000

STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "warez", "keygen", "casino-bonus", "payday-loans")
SOFT = (
    "adult", "bet", "betting", "casino", "cheap", "crack", "dating", "escort", "free-download", "gambling",
    "hookup", "jackpot", "loan", "nude", "pharma", "pills", "poker", "replica", "sex", "slots", "torrent", "viagra",
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case; ``min_soft`` different soft terms weigh as much as a strict one."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    min_soft: int = 2


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@lru_cache(maxsize=4)
def _automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for strict, terms in ((False, vocabulary.soft), (True, vocabulary.strict)):
        for term in terms:
            found.add_word(term, (term, strict))
    found.make_automaton()
    return found


def _alone(text: str, start: int, end: int) -> bool:
    """No ASCII letter or digit touches text[start:end]."""
    sides = text[start - 1 : start] if start else "", text[end : end + 1]
    return not any(c.isascii() and c.isalnum() for c in sides)


def count_terms(url: str | None, vocabulary: Vocabulary) -> tuple[int, int]:
    """How many different strict and soft terms stand alone in a URL."""
    strict, soft = set(), set()
    if url and len(automaton := _automaton(vocabulary)):
        text = url.translate(str.maketrans(UPPER, LOWER))
        for last, (term, is_strict) in automaton.iter(text):
            if _alone(text, last + 1 - len(term), last + 1):
                (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def _fitting(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    """The rule with the longest text that fits; of equally long ones, the first given."""
    best = None
    while host:
        for rule in rules.get(host, ()):
            if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                best = rule
        host = host.partition(".")[2]
    return best


def filter_urls(
    frame: DataFrame, url: str = "url", rules: Sequence[Rule] = (), vocabulary: Vocabulary = Vocabulary()
) -> DataFrame:
    """All rows with host, path, rule, verdict, strict_hits and soft_hits."""
    size = sum(len(r.text) for r in rules) + sum(map(len, vocabulary.strict + vocabulary.soft))
    if size > SETTINGS_BYTES:
        raise ValueError(f"rules and vocabulary have {size} characters, {SETTINGS_BYTES} are allowed")
    if not all(vocabulary.strict + vocabulary.soft):
        raise ValueError("a term of the vocabulary is empty")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)

    @F.pandas_udf("rule string, verdict string, strict_hits int, soft_hits int")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, hosts, paths in parts:
            rows = []
            for text, host, path in zip(urls, hosts, paths, strict=True):
                strict, soft = count_terms(text, vocabulary)
                rule = _fitting(host, path, by_host)
                blocked = strict > 0 or soft >= vocabulary.min_soft
                verdict = rule.verdict if rule else "block" if blocked else "allow"
                rows.append((rule.text if rule else None, verdict, strict, soft))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_hits", "soft_hits"])

    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = col(url).cast("string")
    host = F.translate(F.coalesce(F.regexp_extract(text, parts, 1), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.regexp_extract(text, parts, 2), F.lit(""))
    found = judged(text, host, path)
    out = ("rule", "verdict", "strict_hits", "soft_hits")
    return sent(frame).withColumns({"host": host, "path": path, **{name: found[name] for name in out}})
