"""URL filter: host-suffix and path-prefix expressions against a rule table.

Every URL is expanded into expressions ``host suffix + path prefix``; only the
shapes that some rule has (number of dots in its host, length of its path) are
made. The expressions meet the rules in an equi-join on the first 32 bits of
their SHA-256; the full digest and the shape then confirm a hit, and the
longest rule wins. All steps are DataFrame functions.

Scale: expansion is a map; the join's small side is the rule table, which Spark
broadcasts if its size allows and shuffles otherwise (AQE splits a hot prefix
such as ``com/``). Work is per distinct URL, so a URL seen a million times is
expanded once. The rule shapes are read by the driver: there are at most as
many as distinct (dots, path length) pairs.

Edge cases: a null URL or one without ``://`` has an empty host and path and
matches nothing; repeated rows each get a result row; an empty rule table
leaves every URL to ``default``; rules with a null host or path are ignored,
and of equally long fitting rules the longer host wins, then ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import lower_az

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return lower_az(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, verdict)`` with digest, short prefix and shape."""
    r = rules.select(lower_az(F.col("host")).alias("r_host"), F.col("path").alias("r_path"),
                     F.col("verdict").alias("r_verdict"))
    r = r.where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull() & (F.col("r_host") != ""))
    # one verdict for each (host, path): block, if the table has both
    r = r.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return r.select("*", digest.alias("r_digest"), F.substring(digest, 1, PREFIX_HEX).alias("short"),
                    (F.length("r_host") - F.length(F.translate("r_host", ".", ""))).alias("r_dots"),
                    F.length("r_path").alias("r_plen"))


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, verdict)`` of the winning rule for each distinct URL that one fits."""
    prepared = prepare_rules(rules)
    shapes = prepared.select("r_dots", "r_plen").distinct().collect()
    if not shapes:
        return urls.sparkSession.createDataFrame([], "url string, rule string, verdict string")
    u = urls.select("url").where(F.col("url").isNotNull()).distinct() \
        .select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    made = F.array(*[F.struct(F.lit(s.r_dots).alias("dots"), F.lit(s.r_plen).alias("plen")) for s in shapes])
    x = u.select("url", "host", "path", dots.alias("n_dots"), F.explode(made).alias("s")) \
        .where((F.col("n_dots") >= F.col("s.dots")) & (F.length("path") >= F.col("s.plen")))
    suffix = F.expr("substring_index(host, '.', -(s.dots + 1))")
    x = x.select("url", F.col("s.dots").alias("dots"), F.col("s.plen").alias("plen"),
                 _digest(suffix, F.expr("substring(path, 1, s.plen)")).alias("digest"))
    x = x.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    hit = x.join(prepared, "short").where((F.col("digest") == F.col("r_digest"))
                                          & (F.col("dots") == F.col("r_dots")) & (F.col("plen") == F.col("r_plen")))
    best = F.max(F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"),
                          F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("b")
    return hit.groupBy("url").agg(best).select("url", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict``; ``rule`` is
    null where none fits and ``verdict`` is then ``default``."""
    p = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    m = matching_rules(p, rules)
    return p.join(m, "url", "left").select(
        id_col, F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
