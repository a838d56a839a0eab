"""Secrets in texts, and how widely over repositories and owners each one is copied.

DataFrame expressions only.  A pattern's matches and the text between them give
every match's place.  Each candidate's hash is then counted corpus-wide by
distinct repository and owner: what many owners have is a copied example, what
few have and looks random is live.  Base kinds are always reported; further
kinds only where they are live.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


class Kind(NamedTuple):
    """value: the group that is the secret; least: its characters at least; needs: one of these strings is in each match."""

    name: str
    pattern: str
    value: int
    least: int
    base: bool
    needs: tuple[str, ...] = ()


# What is looked for, in the order that ties go by.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True, ("AKIA",)),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind("provider", r"(?:ghp_|gho_|github_pat_|glpat-|sk_live_|rk_live_|xoxb-|xoxp-|AIza)[A-Za-z0-9_-]{16,}", 0, 20, False, ("ghp_", "gho_", "github_pat_", "glpat-", "_live_", "xox", "AIza")),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36, False, ("eyJ",)),
    Kind("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\n\r]+", 0, 60, False, ("PRIVATE KEY",)),
    Kind("quoted", r"""["'][A-Za-z0-9+/_-]{24,}={0,2}["']""", 0, 26, False),
)
PLACEHOLDERS = r"(?i)example|dummy|sample|changeme|placeholder|your[_-]|xxxx|0000000|1234567"
MAX_OWNERS = 3
MIN_DISTINCT = 8


def matches(text: Column, kind: Kind) -> Column:
    """Array of (start, kind, end, value) of a pattern's leftmost matches that don't overlap; code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)) if kind.value else whole
    found = F.arrays_zip(F.slice(F.split(text, kind.pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    placed = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    kept = F.filter(placed, lambda m: F.length(m["value"]) >= kind.least)
    some = F.regexp_like(text, F.lit(kind.pattern))
    if kind.needs:
        cheap = F.lit(False)
        for part in kind.needs:
            cheap = cheap | F.contains(text, F.lit(part))
        some = cheap & some
    return F.when(some, kept).otherwise(empty)


def looks_random(value: Column) -> Column:
    """Enough distinct characters, digits among letters, and no sign of a placeholder."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT
    return varied & F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")) & ~F.regexp_like(value, F.lit(PLACEHOLDERS))


def candidates(text: Column) -> Column:
    """All kinds' matches by start, then kind; a match of a further kind that touches a base one is left out."""
    base = F.concat(*[matches(text, k) for k in KINDS if k.base])
    more = F.concat(*[matches(text, k) for k in KINDS if not k.base])
    apart = F.filter(more, lambda m: ~F.exists(base, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return F.sort_array(F.concat(base, apart))


def ownership(found: DataFrame, repo: str) -> DataFrame:
    """For each secret's hash: in how many rows, repositories and owners (what stands before / in a repository) it is.

    Every level is summed before it is shuffled, so that neither a hot value
    nor a hot repository meets in one task.
    """
    named = found.select("secret", F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo")).withColumn("owner", F.substring_index("repo", "/", 1))
    by_repo = named.groupBy("secret", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("secret", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("secret").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, repo: str = "source", max_owners: int = MAX_OWNERS, keep_text: bool = True) -> DataFrame:
    """docs with secrets: an array of (start, kind, end, value, n_repos, n_owners, live), by start, then kind.

    kind is KINDS' name.  Null and empty texts have none; a very long text is
    searched whole, with one pass for each kind; a null repository is
    one of its own; every row comes back once, repeated ones too; columns named
    secrets or row_ are replaced; an empty table gives an empty result.  Without
    keep_text the text isn't returned (nor written).
    """
    spark = docs.sparkSession
    docs = docs.drop("secrets", "row_")
    kept = [c for c in docs.columns if keep_text or c != "text"]
    repo_column = F.col(repo) if repo in docs.columns else F.lit(None).cast("string")
    table = docs.select(*kept, repo_column.alias("repo_"), candidates(F.coalesce("text", F.lit(""))).alias("secrets")).withColumn("row_", F.monotonically_increasing_id())
    table = written(spark, table, "secrets")
    one = table.filter(F.size("secrets") > 0).select("row_", "repo_", F.explode("secrets").alias("s")).withColumn("secret", F.sha2(F.col("s.value").cast("binary"), 256))
    # Written first, so that both sides of the join are plain exchanges and a hot secret's rows can be split.
    owned = written(spark, ownership(one, "repo_"), "owners")
    live = (F.col("n_owners") <= max_owners) & looks_random(F.col("s.value"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    is_base = F.array(*[F.lit(k.base) for k in KINDS])
    judged = one.join(owned, "secret").withColumn("live", live).filter(F.element_at(is_base, F.col("s.kind") + 1) | F.col("live"))
    each = F.struct("s.start", F.col("s.kind").alias("order"), "s.end", "s.value", "n_repos", "n_owners", "live")
    by_row = judged.groupBy("row_").agg(F.sort_array(F.collect_list(each)).alias("judged"))  # bounded by one row's text
    shape = "array<struct<start:int,kind:string,end:int,value:string,n_repos:bigint,n_owners:bigint,live:boolean>>"
    named = F.transform("judged", lambda m: F.struct(m["start"].alias("start"), F.element_at(names, m["order"] + 1).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), m["n_repos"].alias("n_repos"), m["n_owners"].alias("n_owners"), m["live"].alias("live")))
    some = table.filter(F.size("secrets") > 0).drop("secrets").join(by_row, "row_", "left")
    some = some.select(*kept, F.coalesce(named, F.expr(f"cast(array() as {shape})")).cast(shape).alias("secrets"))
    none = table.filter(F.size("secrets") == 0).select(*kept, F.expr(f"cast(array() as {shape})").alias("secrets"))
    return none.unionByName(some)


def redacted(text: Column, spans: Column, live: str = "[SECRET]", other: str = "[EXAMPLE]") -> Column:
    """text with each of spans (by start), or what touching ones cover together, replaced: by live where one of them is live."""
    shape = "array<struct<start:int,end:int,live:boolean>>"

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["live"].alias("live"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["live"] | s["live"]).alias("live"))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(one)))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + F.lit(1), s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.when(s["live"], live).otherwise(other)).alias("out"))

    merged = F.aggregate(spans, F.expr(f"cast(array() as {shape})"), merge)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + F.lit(1), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(merged, start, step, rest)).otherwise(text)


def remove(docs: DataFrame, repo: str = "source") -> DataFrame:
    """docs with every reported secret replaced in text, and n_chars to match where docs has it.

    Ownership decides by what: a live one becomes [SECRET], one that many owners
    copied or that looks like a placeholder [EXAMPLE].
    """
    out = scan(docs, repo).withColumn("text", redacted(F.col("text"), F.col("secrets")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
