"""URL filter: a trie over reversed host labels, then path segments; the longest rule that fits decides.

The trie is built once from the rules, sent to the executors, and walked once for each url: work per url is bounded by
its labels and segments, whatever the number of rules. Up to ``MAX_RULES`` rules are sent that way; a larger list stays
a table, and each url's candidate rules (its host suffixes x its path prefixes) are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.common import free_name

MAX_RULES = 1_000_000

#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url) -> F.Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: one level for each host label from the right, then ``None``, then one for each whole path segment.

    A node's ``""`` key holds (tail, rule, verdict) entries: the tail is what the rule's path has after its last ``/``
    and need only begin the url's next segment. Of equal rules the verdict that sorts last counts: block before allow.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(("h", label), {})
        *whole, tail = path.split("/")
        node = node.setdefault(None, {})
        for segment in whole:
            node = node.setdefault(("p", segment), {})
        same = node.setdefault("", {})
        same[tail] = max(same.get(tail, ("", "")), (f"{host}{path}", verdict))
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the deepest fit: more host labels first, then the longer path."""
    node, starts = trie, []
    for label in ["", *(reversed(host.split(".")) if host else ())]:
        node = node if not starts and label == "" else node.get(("h", label))
        if node is None:
            break
        starts.append(node)
    segments = path.split("/")
    for node in reversed(starts):
        node, best = node.get(None), None
        for segment in segments:
            if node is None:
                break
            fits = [t for t in node.get("", ()) if segment.startswith(t)]
            if fits:
                best = node[""][max(fits, key=len)]
            node = node.get(("p", segment))
        if best:
            return best
    return None


def _by_trie(df: DataFrame, rules: list, host: str, path: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [longest(trie, h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return df.withColumn(out, judge(F.col(host), F.col(path)))


def _by_join(df: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """The same verdicts from a table of rules: each url meets the rules of its own host suffixes and path prefixes."""
    key = free_name(df, "url_key")
    df = df.withColumn(key, F.struct(host, path))
    labels, n = F.split(F.col("k.h"), r"\."), F.length("k.p")
    urls = df.select(F.struct(F.col(host).alias("h"), F.col(path).alias("p")).alias("k")).distinct()
    suffixes = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))), F.array(F.lit("")))
    urls = urls.select("k", F.explode(F.array_distinct(suffixes)).alias("r_host"))
    rules = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict"))
    # a path is cut only where some rule ends: as many lengths as rules have, not as many as the path
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    cuts = F.filter(F.array(*[F.lit(i) for i in lengths]), lambda i: i <= n) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(cuts, lambda i: F.substring(F.col("k.p"), F.lit(1), i))
    best = F.max(F.struct(F.when(F.col("r_host") == "", 0).otherwise(F.size(F.split("r_host", r"\."))), F.length("r_path"), F.concat("r_host", "r_path").alias("rule"), "verdict"))
    found = urls.select("k", "r_host", F.explode(prefixes).alias("r_path")).join(rules, ["r_host", "r_path"]).groupBy("k").agg(best.alias("best"))
    found = found.select(F.struct(F.col("k.h").alias(host), F.col("k.p").alias(path)).alias(key), F.struct("best.rule", "best.verdict").alias(out))
    return df.join(found, key, "left").drop(key)


def filter_urls(df: DataFrame, rules=RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row (columns of those names give way to them).

    ``rules``: (host, path, verdict) triples, or a DataFrame with these columns; of equal rules block counts. A rule fits its host and all subdomains
    if the url's path starts with the rule's path. No fit: rule null, verdict ``default``. A null url, or one without
    ``://``, has an empty host and path, which only a rule with an empty host and path fits. Rows are neither dropped
    nor merged: an empty table gives an empty one, repeated rows stay.
    """
    rows = df.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    out = free_name(rows, "judged")
    if isinstance(rules, DataFrame):
        few = rules.select("host", "path", "verdict").limit(MAX_RULES + 1).collect()
        rows = _by_trie(rows, [tuple(r) for r in few], "host", "path", out) if len(few) <= MAX_RULES else _by_join(rows, rules, "host", "path", out)
    elif len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: pass them as a DataFrame")
    else:
        rows = _by_trie(rows, list(rules), "host", "path", out)
    return rows.withColumns({"rule": F.col(f"{out}.rule"), "verdict": F.coalesce(f"{out}.verdict", F.lit(default))}).drop(out)
