"""URL filters: rules by host and path, and an Aho-Corasick automaton over a weighted vocabulary.

A term counts where neither neighbour is a letter or digit. One strict term rejects, as do at least
`distinct` different soft terms whose weights reach `weight`. Host and path are judged, lower-cased.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

STRICT = ("spam-farm", "cheap-pills", "casino", "porn", "viagra", "xxx", "warez")
SOFT = {"bet": 1.0, "bonus": 1.0, "cheap": 1.0, "click": 1.0, "discount": 1.0, "free": 1.0, "loan": 1.0, "pills": 1.0, "poker": 1.0, "promo": 1.0, "spam": 1.0, "win": 1.0}
#: (rule, verdict); a rule is a host and a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
OUT = "host string, path string, rule string, verdict string, strict array<string>, soft array<string>"


class Judge:
    def __init__(self, strict, soft, rules, distinct, weight):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.words.add_word(term, term)
        self.words.make_automaton()
        self.strict, self.soft, self.distinct, self.weight = frozenset(strict), dict(soft), distinct, weight
        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host, []).append((slash + path, rule, verdict))

    def __call__(self, url: str | None) -> tuple:
        m = SPLIT.search(url) if url else None
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        text, hits = host + path.translate(LOW), set()
        for end, term in self.words.iter(text):
            start = end - len(term) + 1
            if (start == 0 or text[start - 1] not in ALNUM) and (end + 1 == len(text) or text[end + 1] not in ALNUM):
                hits.add(term)
        strict, soft = sorted(hits & self.strict), sorted(hits & self.soft.keys())
        bad = strict or (len(soft) >= self.distinct and sum(self.soft[t] for t in soft) >= self.weight)
        best, labels = None, host.split(".")
        for i in range(len(labels)):  # the host and its parents
            for start, rule, verdict in self.rules.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return host, path, best[0] if best else None, best[1] if best else "block" if bad else "allow", strict, soft


def filter_urls(pages: DataFrame, strict=STRICT, soft=None, rules=RULES, distinct: int = 2, weight: float = 2.0) -> DataFrame:
    """page_id, url, host, path, rule, verdict, strict, soft (the terms that count) for each row of pages(page_id, url)."""
    args = (tuple(strict), dict(SOFT if soft is None else soft), tuple(rules), distinct, weight)

    @F.pandas_udf(OUT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        if not hasattr(filter_urls, "_judge") or filter_urls._judge[0] != args:
            filter_urls._judge = (args, Judge(*args))
        one = filter_urls._judge[1]
        return pd.DataFrame([one(u) for u in urls], columns=["host", "path", "rule", "verdict", "strict", "soft"])

    return pages.select("page_id", "url", judge("url").alias("j")).select("page_id", "url", "j.*")
