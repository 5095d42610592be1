"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Features of a url: lengths of host, path and query, depth, shares of digits, entropy, numbers of parameters,
hyphens and labels, the longest run of letters, statistics of the host's suffixes: how often its last
one and last two labels were blocked in the training urls, smoothed by their number, and the sum, largest
and least log-odds of the letter groups (three to five letters) of the host's name there, smoothed likewise, so
that words are known in joined and in hyphenated hosts. Trees are trained from
labelled urls (rows of url and blocked), of which at most SAMPLE, those of the smallest hashes, are used;
without such a table the urls of `seed_urls()` are, which are made from the fixed words below.

Rules: a rule (host and path, split at the first slash) fits a url if its host is the url's host or a
parent domain of it and the url's path starts with the rule's; the longest fitting rule decides, others
are left to the trees. The rule list is small by contract and is compiled into the plan.

Defined results: null urls, and urls without ://, have an empty host and path, no rule, and the trees'
verdict on empty text; urls of any length are read whole; repeated rows are judged alike; an empty table has no rows;
columns of other names, `host`, `path`, `rule` and `verdict` among them, play no part. Nothing is shuffled.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm import gbt

SAMPLE = 20_000
#: Fixed values of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Fixed words of the seed urls: those that mark unwanted hosts, and ordinary ones.
BAD_WORDS = ["ads", "track", "spam", "farm", "cheap", "pills", "casino", "bet", "loans", "free", "win", "prize", "click", "banner", "pop", "seo", "replica", "torrent", "crack", "xxx"]
GOOD_WORDS = ["news", "garden", "river", "history", "school", "library", "music", "travel", "kitchen", "science", "weather", "forest", "city", "paper", "book", "letter", "museum", "north", "stone", "light"]
PREFIXES = ["", "www.", "m.", "blog."]
TAILS = ["", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"]
SUFFIXES = ["com", "org", "info", "io"]


SYLLABLES = "ba be da do fi ga hi ka le lu ma mi na no pe ri sa so ta ti ve wo".split()


def seed_urls() -> list[tuple[str, bool]]:
    """Labelled urls, half of them blocked, that no single feature splits.

    Most blocked hosts have two bad words, and most allowed ones ordinary or made-up words, each with and without
    hyphens. A bad word beside an ordinary one is blocked in a url of many digits, parameters and steps, and allowed
    in a plain one; ordinary words are blocked only with much of all these. Each label has both kinds of suffixes.
    """
    rng = random.Random(20_240_601)
    pick = rng.choice
    out = []
    for i in range(4000):
        blocked = bool(i % 2)
        kind = rng.random()
        if blocked:
            words = [pick(BAD_WORDS), pick(BAD_WORDS)] if kind < 0.75 else [pick(BAD_WORDS), pick(GOOD_WORDS)] if kind < 0.9 else [pick(GOOD_WORDS), pick(GOOD_WORDS)]
            messy = rng.random() < 0.3 if kind < 0.75 else True
        else:
            made_up = ["".join(pick(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(2)]
            words = [pick(GOOD_WORDS), pick(GOOD_WORDS)] if kind < 0.55 else made_up if kind < 0.85 else [pick(BAD_WORDS), pick(GOOD_WORDS)]
            messy = rng.random() < 0.2 if kind < 0.55 else False
        rng.shuffle(words)
        name = pick(["", "-"]).join(words if kind > 0.1 or blocked else words[:1])
        heavy = messy and blocked and kind >= 0.75
        if heavy or rng.random() < 0.15:
            name += str(rng.randrange(10, 10_000))
        site = f"{name}.{pick(['example', 'test'])}" if rng.random() < 0.6 else name
        suffix = pick(SUFFIXES) if rng.random() < 0.8 else pick(SUFFIXES[2:] if blocked else SUFFIXES[:2])
        steps = [pick("en de fr es x".split()) for _ in range(rng.randrange(2, 6) if messy else rng.randrange(0, 3))]
        path = "/".join(["", *steps, str(rng.randrange(10 ** rng.randrange(5, 9) if messy else 50_000)) if messy or rng.random() < 0.8 else pick(GOOD_WORDS)])
        tail = "?" + "&".join(f"{pick('abcdef')}={rng.randrange(1000)}" for _ in range(rng.randrange(3, 7) if heavy else rng.randrange(1, 5))) if messy else pick(TAILS)
        out.append((f"http{pick(['', 's'])}://{pick(PREFIXES)}{site}.{suffix}{path if rng.random() < 0.95 else ''}{tail}", blocked))
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; ties in order of the list."""
    out = None
    for rule in sorted(rules, key=len, reverse=True):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def groups(name: str) -> set[str]:
    """The runs of three to five letters in a host without its last label."""
    runs = re.findall(r"[a-z]{3,}", name.rpartition(".")[0])
    return {r[i : i + n] for r in runs for n in (3, 4, 5) for i in range(len(r) - n + 1)}


def lexical(url: str) -> tuple[list[float], str, str, set[str]]:
    """Features of the text alone, the host's last one and last two labels, and its letter groups."""
    rest = url.partition("://")[2] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].lower()
    tail = rest[len(host) :]
    path, _, query = tail.partition("#")[0].partition("?")
    labels = host.split(".") if host else []
    name = re.sub(r"^(www|m|blog)\.", "", host)
    digits = sum(c.isdigit() for c in rest)
    runs = [len(x) for x in re.findall(r"[a-z]+", host)]
    params = len(query.split("&")) if query else 0
    features = [len(host), len(path), len(query), path.count("/"), digits / max(1, len(rest)), sum(c.isdigit() for c in host) / max(1, len(host)), entropy(name), entropy(path), params, host.count("-"), len(labels), max(runs, default=0)]
    return features, ".".join(labels[-1:]), ".".join(labels[-2:]), groups(name)


class Filter:
    """The trees, and the statistics of suffixes and letter groups that they use."""

    def __init__(self, urls: list[tuple[str, bool]]):
        self.base = (sum(y for _, y in urls) + 1) / (len(urls) + 2)
        self.suffixes: dict[str, tuple[int, int]] = {}
        self.groups: dict[str, tuple[int, int]] = {}
        parts = [(*lexical(u), y) for u, y in urls]
        for _, one, two, own, y in parts:
            for table, keys in (self.suffixes, {one, two}), (self.groups, own):
                for s in keys:
                    n, bad = table.get(s, (0, 0))
                    table[s] = n + 1, bad + y
        x = np.array([f + self.rates(one, two, y) + self.odds(own, y) for f, one, two, own, y in parts], float).reshape(len(parts), -1)
        self.groups = {s: c for s, c in self.groups.items() if c[0] > 1}  # single ones are own counts only
        self.trees = gbt.fit(x, np.array([y for *_, y in parts], float), trees=30, depth=3)

    def rates(self, one: str, two: str, own: bool | None = None) -> list[float]:
        """Shares of blocked urls, smoothed by 20 of the mean; a training url doesn't count itself."""
        out = []
        for s in (one, two):
            n, bad = self.suffixes.get(s, (0, 0))
            if own is not None:
                n, bad = n - 1, bad - own
            out += [(bad + 20 * self.base) / (n + 20), math.log1p(n)]
        return out

    def odds(self, letters: set[str], own: bool | None = None) -> list[float]:
        """Sum, largest and least log-odds of being blocked, less the mean's, smoothed by 5 of the mean; a training url doesn't count itself."""
        out = []
        for s in letters:
            n, bad = self.groups.get(s, (0, 0))
            if own is not None:
                n, bad = n - 1, bad - own
            out.append(math.log((bad / self.base + 5) / ((n - bad) / (1 - self.base) + 5)))
        return [math.fsum(out), max(out), min(out)] if out else [0.0, 0.0, 0.0]

    def blocked(self, urls: list[str]) -> np.ndarray:
        x = [lexical(u) for u in urls]
        return self.trees.probability(np.array([f + self.rates(one, two) + self.odds(own) for f, one, two, own in x], float).reshape(len(urls), -1)) >= 0.5


def train(labelled: DataFrame | None = None, sample: int = SAMPLE) -> Filter:
    """From rows (url, blocked), of which a bounded, hashed sample is used; None: from the seed urls."""
    if labelled is None:
        return Filter(seed_urls())
    some = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("boolean").alias("blocked"))
    rows = some.orderBy(F.xxhash64("url"), "url", "blocked").limit(sample).collect()
    return Filter([(r.url, r.blocked) for r in rows])


def judge(pages: DataFrame, model: Filter, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""

    @F.pandas_udf("boolean")
    def unwanted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(model.blocked(["" if u is None else u for u in urls]))

    url = F.col(url_col)
    found = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), unwanted(url).alias("__bad")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = None
    for rule, verdict in rules.items():
        decided = F.when(F.col("rule") == rule, verdict) if decided is None else decided.when(F.col("rule") == rule, verdict)
    own = F.when(F.col("__bad"), "block").otherwise("allow")
    return found.select(id_col, "host", "path", "rule", (F.coalesce(decided, own) if decided is not None else own).alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return judge(pages, train())
