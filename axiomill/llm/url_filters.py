"""URL filters: host-suffix and path-prefix expressions joined to a rule table on short hash prefixes.

A page's url is expanded into every (host suffix, path prefix) expression that some rule could
equal: suffixes of 1..K labels, prefixes of the rules' own path lengths. Expressions meet rules in an
equi-join on the first 32 bits of their SHA-256; the full digest then confirms, and the longest rule wins.
Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: rules are broadcast up to this many rows; a larger table is joined by shuffle
BROADCAST_RULES = 20_000


def split_url(url):
    """(host, path) columns: between ``://`` and the first of ``/?#``; then up to ``?`` or ``#``. Null or no ``://``: both empty."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host||path of the longest fitting rule, else null), verdict.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the url's path starts
    with the rule's path. Of equally long rules the block wins, then the smaller text. Null urls and urls without
    ``://`` have an empty host and path and fit no rule; repeated pages and repeated rules are
    judged alike; empty tables give empty results (no rules: the default verdict). Other columns are not read.

    Urls are judged once for each distinct (host, leading path): a hot host costs one row a task.
    """
    spark = pages.sparkSession
    rules = rules.select(
        F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host <> ''").distinct()
    # bounds of the expansion: label count and distinct path lengths of the rules (aggregates, a single row)
    shape = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("k"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lens"), F.count(F.lit(1)).alias("n")).first()
    labels, lengths, n_rules = shape["k"] or 0, list(shape["lens"] or []), shape["n"]
    longest = max(lengths, default=0)

    host, path = split_url(f"`{url}`")
    judged = pages.select(F.col(id_col), F.col(url).alias("__url")).select(F.col(id_col), *(c.alias(n) for c, n in zip(split_url("__url"), ("host", "path"), strict=True)))
    judged = judged.withColumn("__lead", F.substring("path", 1, max(longest, 1)) if longest else F.lit(""))
    keys = judged.select("host", "__lead").where("host <> ''").distinct()
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, labels + 1)))) if labels else F.array().cast("array<string>")
    fits = [F.when(F.length("__lead") >= n, F.substring("__lead", 1, n) if n else F.lit("")) for n in lengths]
    prefixes = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    exprs = (
        keys.withColumn("__suffix", F.explode(suffixes)).withColumn("__prefix", F.explode(prefixes))
        .withColumn("__digest", F.sha2(F.concat_ws("\x00", "__suffix", "__prefix"), 256))
        .withColumn("__short", F.substring("__digest", 1, 8))
    )
    hashed = rules.withColumn("r_digest", F.sha2(F.concat_ws("\x00", "r_host", "r_path"), 256)).withColumn("r_short", F.substring("r_digest", 1, 8))
    hashed = F.broadcast(hashed) if n_rules <= BROADCAST_RULES else hashed
    hits = exprs.join(hashed, (F.col("__short") == F.col("r_short")) & (F.col("__digest") == F.col("r_digest")))
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v"))
    best = hits.groupBy("host", "__lead").agg(F.max(rank).alias("best")).select(F.col("host").alias("b_host"), F.col("__lead").alias("b_lead"), F.col("best.rule").alias("rule"), F.col("best.v").alias("r_v"))
    out = judged.join(best, (F.col("host") == F.col("b_host")) & (F.col("__lead") == F.col("b_lead")), "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("r_v", F.lit(default)).alias("verdict"))


#: The rule list of the query, in order.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(spark, sf_dir):
    from .common import table

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rh, rp, rv) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, max(struct_pack(n := length(rh || rp), rule := rh || rp, v := rv)) AS b
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.b.rule AS rule, coalesce(b.b.v, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
