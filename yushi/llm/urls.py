"""URL filter: rules found by their rarest literal token.

A rule is a regular expression over the normalised host and path (or the whole url) together with the literal tokens that any
url it fits must have. How often the rules' tokens occur is counted over all urls; each rule is indexed under its rarest
one. A url's tokens fetch the rules indexed under them, and only those run their expression. Each url is judged in its
own task: no shuffle, so a host with a third of all pages is no hot key. The rules are a parameter held by the driver; they are
sent in blocks of at most `BLOCK_CHARS`, and the urls with the best rules so far are written between two blocks, so longer lists take
more passes and no more memory. An expression is compiled when a url first fetches its rule.

Defined results: a null url or one without `://` has an empty host and path, no rule, and the verdict of the patterns (a null
url: allow); repeated pages are judged one by one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, stored

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_TOKEN = re.compile(r"[0-9a-z]+")
#: Characters of the rules that are sent at once: names, expressions and literals.
BLOCK_CHARS = 8 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    literals: tuple[str, ...]
    #: "site" looks at host and path; the longest site rule wins. "url" looks at the whole url and decides where no site rule does.
    on: str = "site"


def site(verdict: str, rule: str) -> Rule:
    """A host with all its subdomains and the start of a path, like `example.com/en/`."""
    host, slash, path = rule.partition("/")
    sure = [t.group() for t in _TOKEN.finditer(host)] + [t.group() for t in _TOKEN.finditer(path) if t.end() < len(path)]
    return Rule(rule, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", verdict, tuple(sure) if path == path.translate(_UPPER) else tuple(_TOKEN.findall(host)))


def word(verdict: str, token: str) -> Rule:
    """A token anywhere in the url."""
    return Rule(token, rf"(?<![0-9a-z]){re.escape(token)}(?![0-9a-z])", verdict, (token,), "url")


#: Site rules, and words that block a url no site rule speaks of.
SITES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
WORDS = ["casino", "viagra", "porn", "xxx", "sessionid", "replytocom", "wp-login"]
RULES = [site(*x) for x in SITES] + [word("block", w) for w in WORDS if _TOKEN.fullmatch(w)] + [Rule("wp-login", r"/wp-login\.php", "block", ("wp", "login", "php"), "url")]


def split(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host):]).group()


def tokens(url: str) -> set[str]:
    return set(_TOKEN.findall(url.translate(_UPPER)))


def token_counts(pages: DataFrame, rules: list[Rule] = RULES) -> dict[str, int]:
    """How many urls have each literal of the rules: one number per literal reaches the driver."""
    wanted = {t for r in rules for t in r.literals}

    def run(b):
        n = Counter(t for u in b.column(0).to_pylist() if u is not None for t in tokens(u) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    found = arrow_map(pages.select("url"), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(wanted, 0) | {r.token: r.n for r in found}


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        for k, r in enumerate(rules):
            if r.literals:
                self.by_token.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def expression(self, k: int) -> re.Pattern:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rules[k].pattern)
        return self.compiled[k]

    def fits(self, k: int, site: str, low: str) -> bool:
        on_site = self.rules[k].on == "site"
        return bool(self.expression(k).match(site) if on_site and site else not on_site and self.expression(k).search(low))

    def best(self, url: str | None, so_far: tuple = (None, None, None)) -> tuple[str, str, str | None, str | None, str | None]:
        """Host, path, the site rule with its verdict, and the rule on urls that blocks; `so_far` has the last three of earlier blocks."""
        host, path = split(url)
        rule, verdict, pattern = so_far
        if url is None:
            return host, path, None, None, None
        low = url.translate(_UPPER)
        found = {k for t in set(_TOKEN.findall(low)) for k in self.by_token.get(t, ())}.union(self.always)
        for k in sorted(found):
            r = self.rules[k]
            if r.on == "site":
                if (rule is None or rank(r.name) > rank(rule)) and self.fits(k, host + path if host else "", low):
                    rule, verdict = r.name, r.verdict
            elif pattern is None and r.verdict == "block" and self.fits(k, "", low):
                pattern = r.name
        return host, path, rule, verdict, pattern

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        return decided(*self.best(url))


def rank(name: str) -> tuple[int, int]:
    """The longer site rule wins, then the one with the longer host, then the first."""
    return len(name), len(name.partition("/")[0])


def decided(host, path, rule, verdict, pattern):
    """A site rule decides; where there is none, a rule on urls blocks."""
    return (host, path, rule, verdict, None) if rule is not None else (host, path, None, "block" if pattern is not None else "allow", pattern)


def blocks(rules: list[Rule], most: int = BLOCK_CHARS) -> Iterator[list[Rule]]:
    """The rules in their order, in blocks of bounded size; one empty block if there are none."""
    block, size = [], 0
    for r in rules:
        own = len(r.name) + len(r.pattern) + sum(map(len, r.literals))
        if block and size + own > most:
            yield block
            block, size = [], 0
        block.append(r)
        size += own
    yield block


def _pass(rows: DataFrame, block: list[Rule], last: bool) -> DataFrame:
    """page_id, url, host, path, rule, verdict, pattern after one more block of rules; the last one decides."""
    sent = rows.sparkSession.sparkContext.broadcast((block, token_counts(rows, block)))
    names = ["page_id", "url", "host", "path", "rule", "verdict", "pattern"]

    def run(batches):
        index = Index(*sent.value)
        for b in batches:
            ids, us, *so_far = (c.to_pylist() for c in b.columns)
            found = [index.best(u, x) for u, x in zip(us, zip(*so_far))]
            cols = list(zip(*(decided(*x) for x in found) if last else found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in cols)], names)

    state = rows.select("page_id", "url", "rule", "verdict", "pattern")
    return state.mapInArrow(run, "page_id long, " + ", ".join(f"{n} string" for n in names[1:]))


def judged(pages: DataFrame, rules: list[Rule] = RULES, most: int = BLOCK_CHARS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the word or expression that blocked it)."""
    none = F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), none.alias("rule"), none.alias("verdict"), none.alias("pattern"))
    todo = list(blocks(rules, most))
    for k, block in enumerate(todo, 1):
        rows = _pass(rows, block, last=k == len(todo))
        if k < len(todo):
            rows = stored(rows, "urls")
    return rows.drop("url")
