"""URL filters: allow and block rules on hosts and paths.

A URL's host is what stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; its path
goes on from there to `?`, `#` or the end. A rule (host, path, verdict) fits its host and all subdomains if the URL's
path starts with the rule's. Of the rules that fit, the longest wins (host and path together, then the longer host);
where a host and path are both allowed and blocked, they are blocked.

Every URL is expanded into expressions: suffixes of its host, prefixes of its path. Only shapes that some rule has are
made: (labels of the host, slashes of the path) for rules that end in a slash, (labels, characters) for the others, so a
URL has no more expressions than the rules have shapes, however many dots and slashes it has. Expressions meet rules by
the first 32 bits of their SHA-256, then the whole digests are compared, then precedence decides.

Each distinct (host, path) is judged once, so a URL, or a host's page without its query, that fills a third of the
table counts once for the expansion. Rules are broadcast behind a count; beyond it, the join is shuffled with rules copied to
SALTS and expressions dealt over them, so an expression that most URLs have (`com/`) is spread.

Nulls: a null URL, or one without `://`, has an empty host and path, which only a rule of an empty host fits. Rules without
a host or verdict are left out; a null path is empty. Repeated rows and null page_ids are rows like any other; a repeated
rule counts once. Empty tables give no rows, or the default verdict for all. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fitted, table

#: What a URL gets that no rule fits.
DEFAULT = "allow"
SALTS = 16
#: The rules of the query, (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """A host has no slash, so the first one ends it. Never null, so that plans need no test that computes it once more."""
    return F.coalesce(F.unhex(F.sha2(F.concat(host, F.lit("/"), path), 256)), F.lit(bytearray()))


def _short(digest: Column) -> Column:
    """Its first 32 bits."""
    return F.coalesce(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(-1).cast("long"))


def _count(x: Column, sign: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def hashed_rules(rules: DataFrame) -> DataFrame:
    """short, digest, rule, verdict, size, host_size, labels, slashes, chars of every different rule (host, path, verdict). Of a
    rule that ends in a slash, slashes are counted and chars is -1; of another, the other way round."""
    r = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host IS NOT NULL AND verdict IS NOT NULL")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    whole = F.endswith("path", F.lit("/"))
    return r.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        (_count(F.col("host"), ".") + 1).alias("labels"),
        F.when(whole, _count(F.col("path"), "/")).otherwise(-1).alias("slashes"),
        F.when(whole, -1).otherwise(F.length("path")).alias("chars"),
        _digest(F.col("host"), F.col("path")).alias("digest"),
    ).withColumn("short", _short(F.col("digest")))


def expression(host: Column, path: Column, labels: Column, slashes: Column, chars: Column) -> Column:
    """suffix and prefix of one shape; null if host or path is too short for it."""
    suffix = F.when(_count(host, ".") + 1 >= labels, F.call_function("substring_index", host, F.lit("."), -labels))
    by_slash = F.when(_count(path, "/") >= slashes, F.concat(F.call_function("substring_index", path, F.lit("/"), slashes), F.lit("/")))
    prefix = F.when(slashes > 0, by_slash).when(F.length(path) >= chars, F.left(path, chars))
    return F.when(suffix.isNotNull() & prefix.isNotNull(), F.struct(suffix.alias("host"), prefix.alias("path")))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule (null without one), verdict by row of pages (page_id, url); rules: host, path, verdict."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = hashed_rules(rules)
    shapes = rules.select("labels", "slashes", "chars").distinct()
    urls = rows.select("host", "path").distinct()
    # There are fewer shapes than labels of the longest host times lengths of paths, however many rules there are.
    shapes = [F.struct(*[F.lit(x).alias(k) for k, x in s.asDict().items()]) for s in shapes.collect()]
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    made = urls.select("host", "path", F.explode(F.array(*shapes)).alias("s"))
    made = made.select("host", "path", expression(F.col("host"), F.col("path"), F.col("s.labels"), F.col("s.slashes"), F.col("s.chars")).alias("e")).where("e IS NOT NULL")
    made = made.select("host", "path", _digest(F.col("e.host"), F.col("e.path")).alias("own")).withColumn("short", _short(F.col("own")))
    found = rules.select("short", "digest", "rule", "verdict", "size", "host_size")
    small = fitted(found)
    if small is found:
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        made = made.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        met = made.join(found, ["short", "salt"])
    else:
        met = made.join(small, "short")
    best = met.where("own = digest").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "host_size")).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The rows of pages whose URL isn't blocked, with all their columns."""
    blocked = judged(pages.select(F.lit(None).alias("page_id"), "url"), rules, default).where("verdict = 'block'").select("host", "path").distinct()
    return pages.join(blocked, (host_of(pages["url"]) == blocked["host"]) & (path_of(pages["url"]) == blocked["path"]), "left_anti")


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
b AS (SELECT rid, page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b LEFT JOIN f USING (rid)
"""
