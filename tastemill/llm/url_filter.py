"""URL rules by an inverted index over each rule's rarest literal token, in DataFrame functions only.

A rule is (host, path, verdict): it fits its host and all subdomains if the URL's path starts with the
rule's path; `*` in a path stands for any characters. The host labels of a rule, and those path tokens
that are complete in it (bounded on both sides by other characters, no `*` beside them), must occur
among the tokens of every URL that the rule fits. One pass over the URLs counts how often each of these
tokens occurs; each rule is filed under its rarest one. Then each URL looks up its own tokens in
that index and runs the regular expressions of the rules found there, and no others. The longest
fitting rule (host and path; the later of equals) decides.

The index is a constant of the plan: `buckets` small maps, the token's hash picks one. So judging is
one map stage without shuffle, join or explode; no key can be hot. The rules are the caller's list; an index has
at most `max_rules` of them, and more rules make more indexes, whose best rules are compared.

Defined cases: a rule without such a token is run on every URL; a null URL or one without `://` has empty host and path; with no fitting rule the verdict
is `default`. An empty table gives an empty result; an empty rule list gives `default` everywhere. Repeated
rows and repeated ids are judged row by row. Other columns are not read."""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import ascii_lower


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """For host, a newline and path; matched from the start."""
        path = ".*".join(map(_quoted, self.path.split("*")))
        return rf"(?s)^(?:[^\n]*\.)?{_quoted(self.host)}\n{path}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL has which the rule fits."""
        full = [m[0] for m in re.finditer(r"[^\W_]+", self.path, re.A) if m.end() < len(self.path) and "*" not in self.path[max(0, m.start() - 1) : m.end() + 1] and (m.start() > 0)]
        return list(dict.fromkeys([x for x in self.host.split(".") if x] + full))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9\n])", r"\\\1", text)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels, and runs of ASCII letters and digits of the path."""
    labels = F.split(host, r"\.")
    parts = F.regexp_extract_all(path, F.lit("([A-Za-z0-9]+)"), 1)
    return F.array_distinct(F.concat(labels, parts))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", buckets: int = 1024, max_rules: int = 100_000) -> DataFrame:
    """One row per row of df: the id, host, path, rule (null if none fits), verdict."""
    rules = [Rule(*r) for r in rules]
    host, path = split_url(F.col(url_col))
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    seen = token_counts(parts, sorted({t for r in rules for t in r.tokens}))
    best = [_best(list(enumerate(rules))[at : at + max_rules], seen, buckets) for at in range(0, max(1, len(rules)), max_rules)]
    judged = parts.withColumn("best", best[0] if len(best) == 1 else F.array_max(F.array_compact(F.array(*best))))
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _best(rules: list[tuple[int, Rule]], seen: dict[str, int], buckets: int) -> Column:
    """The longest of some rules that fits host and path, the later of equals; null if none does."""
    index: list[dict] = [{} for _ in range(buckets)]
    always = []
    for k, r in rules:
        token = min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=None)
        own = always if token is None else index[zlib.crc32(token.encode()) % buckets].setdefault(token, [])
        own.append({"size": len(r.name), "k": k, "pattern": r.pattern, "rule": r.name, "verdict": r.verdict})
    kind = "array<struct<size:int,k:int,pattern:string,rule:string,verdict:string>>"
    constant = F.from_json(F.lit(json.dumps(index)), f"array<map<string,{kind}>>")
    found = F.flatten(
        F.filter(
            F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.try_element_at(F.get(constant, (F.crc32(t.cast("binary")) % buckets).cast("int")), t)),
            lambda x: x.isNotNull(),
        )
    )
    if always:
        found = F.concat(found, F.from_json(F.lit(json.dumps(always)), kind))
    address = F.concat("host", F.lit("\n"), "path")
    return F.array_max(F.filter(found, lambda r: F.regexp_like(address, r["pattern"])))


def token_counts(parts: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens: at most one row for each of them comes to the driver."""
    if not wanted:
        return {}
    # a constant array; only tokens of rules leave the row
    hits = F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.from_json(F.lit(json.dumps(wanted)), "array<string>"))
    rows = parts.select(F.explode(hits).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}
