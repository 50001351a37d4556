"""Secret scans by corpus-wide ownership frequency.

Patterns give candidate values (of a private key its body, without white space). Their hashes are counted over the whole
corpus by distinct repositories and owners: a value that many owners have, or that stands in very many repositories, is
a widely copied example; one that few have is a credential of theirs. Base spans
stand as the contract has them; spans of the further kinds are added only where the value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spans import find_spans, joined, labelled

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Further kinds: (kind, a fixed sign that texts with it contain, pattern, group of the value).
EXTRAS = (
    ("vendor", "", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})", 0),
    ("pem", "-----BEGIN", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([^-]*+)", 1),
    ("url", "://", r"://[^\x00-\x20/:@]{1,64}:([^\x00-\x20/:@]{3,128})@", 1),
)
BASE_KINDS = ("assign", "access", "hex")
#: A value of at least so many owners, or in at least so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 50
#: A live-looking value has at least so many different characters.
LEAST_VARIETY = 5
SALTS = 16


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(find_spans(text, ASSIGN, 1), lambda s: F.length(s["text"]) >= 6)
    return {"assign": assign, "access": find_spans(text, ACCESS), "hex": find_spans(text, HEX)}


def _variety(value: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))))


def _values(kind: str) -> Column:
    """The values of a kind's spans: hash, whether it is varied enough, kind, start, end."""

    def value(s: Column) -> Column:
        own = F.regexp_replace(s["text"], r"\s|\\[nr]", "") if kind == "pem" else s["text"]
        varied = _variety(own) >= LEAST_VARIETY
        return F.struct(F.xxhash64(own).alias("hash"), varied.alias("varied"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return F.transform(kind, value)


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """candidates: hash, repository, owner. Of each hash: its distinct repositories and owners, and whether it is an
    example. Rows are made distinct before they are counted, so a hot value is pre-aggregated where it lies."""
    distinct = candidates.select("hash", "repository", "owner").distinct()
    owners = distinct.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    counted = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    return counted.withColumn("example", (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Secrets of every text: counts and a digest of the base spans, all spans, and how many of the row's values are
    live-looking (n_live) and examples (n_example).

    A null text is empty: no spans, empty strings; null repositories or owners count as one of their own. Repeated
    rows give a result each; an empty table an empty one; columns besides the four named are not read. Spans with the
    same start stand in the order of their kinds. Very long texts are searched whole; places are code points.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    base = base_spans(whole)
    extra = {k: F.when(F.contains(whole, F.lit(sign)), find_spans(whole, p, g)).otherwise(none) if sign else find_spans(whole, p, g) for k, sign, p, g in EXTRAS}
    kinds = [*base, *extra]
    # No texts are carried on from here: one narrow row for each document.
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), *[v.alias(k) for k, v in (base | extra).items()])
    slim = common.staged(slim, "secret-spans")
    values = F.concat(*[_values(k) for k in kinds])
    candidates = slim.where(sum((F.size(k) for k in kinds[1:]), F.size(kinds[0])) > 0)
    candidates = candidates.select("row", "repository", "owner", F.explode(values).alias("v")).select("row", "repository", "owner", "v.*")
    decided = ownership(candidates, example_owners, example_repositories).select("hash", "example")
    # A hot value's rows are dealt to several tasks.
    decided = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    judged = salted.join(decided, ["hash", "salt"])
    live = ~F.col("example") & F.col("varied")
    added = F.when(live & ~F.col("kind").isin(*BASE_KINDS), F.struct("start", F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int").alias("rank"), "kind", "end"))
    per_row = judged.groupBy("row").agg(F.count_if(live).alias("n_live"), F.count_if("example").alias("n_example"), F.collect_list(added).alias("added"))
    spans = [labelled(F.col(k), i + 1, k) for i, k in enumerate(base)]
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    out = slim.join(per_row, "row", "left")
    return out.select(
        F.col("key").alias(key),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(spans), 256).alias("base_sha256"),
        joined([*spans, F.coalesce(F.col("added"), nothing)]).alias("spans"),
        F.coalesce(F.col("n_live"), F.lit(0)).alias("n_live"),
        F.coalesce(F.col("n_example"), F.lit(0)).alias("n_example"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"))
