"""Secrets in texts, told apart by who else has them.

Patterns give candidates. Over the whole corpus, each candidate's hash is counted by distinct repositories and distinct
owners: a value that many of them share is an example that was copied around, a value of few owners that looks random is
a live credential. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazewell.session import stored

#: Kinds in the order in which spans of one start are listed: pattern, group that holds the value, least length of the
#: value. ``token`` is this operator's own: an opaque word of mixed characters; ``live`` marks a value judged live.
KINDS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "token": (r"[A-Za-z0-9_-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")
ORDER = (*KINDS, "live")
#: A live credential is held by so many owners and repositories at most.
MOST_OWNERS = 2
MOST_REPOS = 25
#: Different characters of a value that looks random, and words that mark a placeholder.
LEAST_DISTINCT = 8
PLACEHOLDER = "example|sample|changeme|placeholder|dummy|your|xxxx|1234567"
#: Values with more than this share of all candidates are settled by broadcast: there are fewer than 50,000 of them.
HOT = 50_000


def looks_random(value: Column) -> Column:
    """At least a letter, a digit and eight different characters, and no word of a placeholder."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (distinct >= LEAST_DISTINCT) & ~F.lower(value).rlike(PLACEHOLDER)


def looks_opaque(value: Column) -> Column:
    """Small and capital letters, three digits or more, at most three joining marks: not a word, a name or a slug."""
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9].*[0-9]") & ~value.rlike("([_-].*){4}")


def _entry(gaps: str, value: str):
    return lambda whole, i: F.struct(i.alias("i"), F.get(gaps, i).alias("gap"), F.length(whole).alias("size"), F.get(value, i).alias("value"))


def _tagged(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"))


def matches(df: DataFrame, text: str) -> DataFrame:
    """Add a column for each kind: its matches in order, each with the number of characters between it and the one before (``gap``), its length and its value."""
    for kind, (pattern, group, _) in KINDS.items():
        whole, value, gaps = f"_{kind}_whole", f"_{kind}_value", f"_{kind}_gaps"
        df = df.withColumn(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        some = F.size(whole) > 0  # a second look is only needed where the first finds something
        df = df.withColumn(value, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.col(whole)) if group else F.col(whole))
        df = df.withColumn(gaps, F.when(some, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
        df = df.withColumn(kind, F.transform(whole, _entry(gaps, value))).drop(whole, value, gaps)
    return df


def candidates(found: DataFrame) -> DataFrame:
    """One row for each match that is long enough: row, repo, owner, kind, start and end (code points), value and where it starts."""
    entries = F.concat(*[F.transform(kind, _tagged(kind)) for kind in KINDS])
    rows = found.select("row", "repo", "owner", F.explode(entries).alias("e")).select("row", "repo", "owner", "e.kind", "e.m.*")
    # running lengths give positions; rows of one text meet by one exchange, and a text's matches are no more than its length
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    rows = rows.withColumn("start", F.col("end") - F.col("size")).withColumn("from", F.col("end") - F.length("value"))
    long = F.lit(False)
    for kind, (_, _, least) in KINDS.items():
        long |= (F.col("kind") == kind) & (F.length("value") >= least)
    kept = rows.filter(long & ((F.col("kind") != "token") | looks_opaque(F.col("value"))))
    return kept.select("row", "repo", "owner", "kind", "start", "end", "from", F.substring(F.sha2("value", 256), 1, 32).alias("hash"), looks_random(F.col("value")).alias("random"))


def ownership(cands: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """For each value that looks random: hash, n_rows, n_repos, n_owners, live. A null repository or owner counts as one of its own."""
    one = cands.filter("random").groupBy("hash").agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct("repo")).alias("n_repos"), F.count_distinct(F.struct("owner")).alias("n_owners"))
    return one.withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))


def judged(cands: DataFrame, owners: DataFrame) -> DataFrame:
    """The candidates with ``n_repos``, ``n_owners`` and ``live`` (false where the value doesn't look random).

    Values of many rows meet their verdict by a broadcast of bounded size, so that no task gets all rows of one value;
    the others by a shuffled join.
    """
    total = owners.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    columns = ["hash", "n_repos", "n_owners", "live"]
    often = owners.filter(F.col("n_rows") * HOT > total).select(*columns, F.lit(True).alias("often")) if total > HOT else None
    plain = cands.filter("NOT random").withColumns({"n_repos": F.lit(None).cast("long"), "n_owners": F.lit(None).cast("long"), "live": F.lit(False)})
    rest = cands.filter("random")
    out = plain
    if often is not None:
        both = rest.join(F.broadcast(often), "hash", "left")
        out = out.unionByName(both.filter("often").select(*plain.columns))
        rest = rest.join(F.broadcast(often.select("hash")), "hash", "left_anti")
    return out.unionByName(rest.join(owners.select(*columns), "hash").select(*plain.columns))


def find_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str | None = None, owner: str = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row for each row: doc_id, n_assign, n_access, n_hex, and ``findings`` in order of start, then kind.

    A finding has kind, start and end in code points (end exclusive), and for random-looking values n_repos and n_owners;
    kinds ``assign``, ``access`` and ``hex`` are all matches of the patterns, ``token`` an opaque word, kept only if it is
    live, and ``live`` the value of any of these that few owners and repositories hold. ``repo`` is the column that names a
    text's repository, the key itself if None.

    Null and empty texts have no findings. A null key, repository or owner is kept and counts as a value of its own. Rows
    with equal keys stay apart; equal rows give equal results. Columns of any other name are not looked at. An empty table
    gives no rows.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(repo or doc_id).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # texts are read once and stay where they are; all that follows works on their matches
    found = stored(matches(rows, "text").drop("text").withColumn("row", F.monotonically_increasing_id()), "secret-matches")
    some = sum((F.size(kind) for kind in KINDS), F.lit(0)) > 0
    cands = stored(candidates(found.filter(some)), "secret-candidates")
    known = judged(cands, stored(ownership(cands, most_owners, most_repos), "secret-owners"))
    base = F.struct("start", _rank(F.col("kind")), "end", "kind", "n_repos", "n_owners")
    live = F.struct(F.col("from").alias("start"), _rank(F.lit("live")), "end", F.lit("live").alias("kind"), "n_repos", "n_owners")
    kept = F.when(F.col("live"), F.array(base, live)).when(F.col("kind") != "token", F.array(base)).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,n_repos:bigint,n_owners:bigint>>"))
    spans = known.select("row", F.explode(kept).alias("span"))
    per_row = spans.groupBy("row").agg(
        F.sort_array(F.collect_set("span")).alias("findings"),
        *[F.count(F.when(F.col("span.kind") == kind, 1)).alias(f"n_{kind}") for kind in BASE],
    ).withColumnRenamed("row", "of_row")
    none = F.array().cast(per_row.schema["findings"].dataType)
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("row", "doc_id").join(per_row, F.col("row") == F.col("of_row"), "left").select("doc_id", *counts, F.coalesce("findings", none).alias("findings"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in ORDER]), kind).cast("int").alias("rank")


def written(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_findings(findings: Column) -> Column:
    """The findings of the three base kinds."""
    return F.filter(findings, lambda s: s["kind"].isin(*BASE))
