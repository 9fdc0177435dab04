"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

Each rule has literal tokens (runs of ASCII letters and digits that any URL it matches contains as whole tokens, in either
case) and a regular expression. It is filed under the one of its tokens that fewest URLs contain. A URL's own tokens fetch the
rules filed under them, and only those expressions run. Rules without a token would run on every URL; they are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Rules that are looked up within the row; more go through a join, see ``UrlFilter``.
IN_ROW = 2000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on the lower-cased host and all that follows it, of which A-Z are lower-cased too if ``fold``. Tokens are
    lower-case. Of the rules that match, that of the highest rank decides, then the longest name, then block before allow, then
    the first by name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0
    fold: bool = True


def address_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains where the URL's path starts with ``path``."""
    tokens = _TOKEN.findall(host.lower())
    inner = [m for m in _TOKEN.finditer(path) if m.start() > 0 and m.end() < len(path)]
    return Rule(host.lower() + path, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(path)}", tuple(tokens + [m[0].lower() for m in inner]), 1, False)


#: Patterns for URLs that no address rule fits: places that hold no text worth keeping.
PATTERNS = (
    *[Rule(f"host:{w}", "block", rf"^(?:[^/?#]*[^a-z0-9/?#])?{w}(?:[^a-z0-9/?#][^/?#]*)?(?:[/?#]|$)", (w,)) for w in ("ads", "adserver", "doubleclick", "tracker", "casino", "porn", "xxx", "torrent", "warez", "viagra")],
    *[Rule(f"path:{w}", "block", rf"^[^/?#]*/(?:[^?#]*/)?{w}(?:[/.?#]|$)", (w,)) for w in ("login", "signin", "signup", "register", "logout", "cart", "checkout", "basket", "wishlist", "unsubscribe")],
    *[Rule(f"path:{'-'.join(w)}", "block", rf"^[^/?#]*/(?:[^?#]*/)?{'[-_]'.join(w)}(?:[/.?#]|$)", w) for w in (("wp", "login"), ("wp", "admin"), ("add", "to", "cart"), ("my", "account"), ("forgot", "password"), ("cgi", "bin"))],
    *[Rule(f"file:{w}", "block", rf"^[^?#]*\.{w}(?:[?#]|$)", (w,)) for w in ("exe", "dmg", "apk", "iso", "msi", "zip", "rar", "7z")],
    *[Rule(f"query:{w}", "block", rf"^[^?#]*\?(?:[^#]*&)?{w}=", (w,)) for w in ("phpsessid", "jsessionid", "sessionid", "sid")],
)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, address) of a URL; the address is the lower-cased host and all that follows it."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit("")), F.coalesce(F.concat(host, after), F.lit(""))


class UrlFilter:
    """Judges URLs by rules; what no rule matches gets ``otherwise``.

    ``judge`` gives a row per page row: id, host, path, ``rule`` and ``verdict``; ``rule`` names the deciding address
    rule (null if none fits), ``pattern`` the deciding pattern rule (null if an address rule decides or none matches).
    A null URL or one without ``://`` has an empty host and path and matches nothing. Whole URLs are judged, whatever their
    length. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows. Up to ``IN_ROW`` rules, the index is a map constant and nothing is shuffled;
    beyond that, distinct addresses are joined with the index by token and the verdicts joined back.
    """

    def __init__(self, rules: tuple[Rule, ...], otherwise: str = "allow"):
        for rule in rules:
            if not rule.tokens:
                raise ValueError(f"rule {rule.name} has no literal token")
        order = lambda r: (-r.rank, -len(r.name), r.verdict != "block", r.name)
        self.rules, self.otherwise = tuple(sorted(rules, key=order)), otherwise

    def frequencies(self, urls: DataFrame, url: str) -> dict[str, int]:
        """In how many URL rows each token of a rule occurs; at most a row for each such token is collected."""
        wanted = sorted({t for r in self.rules for t in r.tokens})
        tokens = urls.select(F.explode(self._tokens(parts(F.col(url).cast("string"))[2], wanted)).alias("token"))
        return {r["token"]: r["count"] for r in tokens.groupBy("token").count().collect()}

    def _tokens(self, address: Column, wanted: list[str]) -> Column:
        """The distinct tokens of an address, A-Z lower-cased, that are among ``wanted``."""
        found = F.split(F.translate(address, _UPPER, _LOWER), "[^a-z0-9]+")
        return F.array_intersect(found, F.array(*[F.lit(t) for t in wanted])) if wanted else F.array().cast("array<string>")

    def index(self, frequencies: dict[str, int]) -> dict[str, list[int]]:
        """Token -> places of the rules filed under it."""
        filed: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            filed.setdefault(min(rule.tokens, key=lambda t: (frequencies.get(t, 0), t)), []).append(k)
        return filed

    def judge(self, pages: DataFrame, id_: str = "page_id", url: str = "url") -> DataFrame:
        host, path, address = parts(F.col(url).cast("string"))
        rows = pages.select(F.col(id_).alias("__id"), host.alias("host"), path.alias("path"), address.alias("__address"))
        filed = self.index(self.frequencies(pages, url))
        if not self.rules:
            out = rows.withColumn("__rule", F.lit(None).cast("int"))
        elif len(self.rules) <= IN_ROW:
            out = rows.withColumn("__rule", self._in_row(F.col("__address"), filed))
        else:
            out = self._joined(rows, filed)
        names = F.array(*[F.lit(r.name) for r in self.rules]) if self.rules else F.array(F.lit(""))
        verdicts = F.array(*[F.lit(r.verdict) for r in self.rules]) if self.rules else F.array(F.lit(""))
        addresses = sum(r.rank > 0 for r in self.rules)  # they come first
        name = F.get(names, F.col("__rule"))
        return out.select(
            F.col("__id").alias(id_),
            "host",
            "path",
            F.when(F.col("__rule") < addresses, name).alias("rule"),
            F.coalesce(F.get(verdicts, F.col("__rule")), F.lit(self.otherwise)).alias("verdict"),
            F.when(F.col("__rule") >= addresses, name).alias("pattern"),
        )

    def _in_row(self, address: Column, filed: dict[str, list[int]]) -> Column:
        """Place of the first rule that matches, among those that the address's tokens fetch."""
        index = F.create_map(*[x for t, ks in sorted(filed.items()) for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]))])
        patterns = F.array(*[F.lit(r.pattern) for r in self.rules])
        fetched = F.flatten(F.transform(self._tokens(address, sorted(filed)), lambda t: F.try_element_at(index, t)))
        folded = F.array(*[F.lit(r.fold) for r in self.rules])
        lower = F.translate(address, _UPPER, _LOWER)
        return F.array_min(F.filter(fetched, lambda k: F.regexp_like(F.when(F.get(folded, k), lower).otherwise(address), F.get(patterns, k))))

    def _joined(self, rows: DataFrame, filed: dict[str, list[int]]) -> DataFrame:
        spark = rows.sparkSession
        rules = spark.createDataFrame([(t, k, self.rules[k].pattern, self.rules[k].fold) for t, ks in filed.items() for k in ks], "token string, k int, pattern string, fold boolean")
        distinct = rows.select("__address").distinct()
        tokens = distinct.select("__address", F.translate("__address", _UPPER, _LOWER).alias("lower"))
        tokens = tokens.select("__address", "lower", F.explode(F.array_distinct(F.split("lower", "[^a-z0-9]+"))).alias("token"))
        hits = tokens.join(rules, "token").where(F.regexp_like(F.when(F.col("fold"), F.col("lower")).otherwise(F.col("__address")), F.col("pattern"))).groupBy("__address").agg(F.min("k").alias("__rule"))
        return rows.join(hits, "__address", "left")
