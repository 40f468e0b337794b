"""URL filter: rules are indexed by their rarest literal token.

A rule is ``host/path`` (fits the host and its subdomains, and paths that begin so) or a
pattern with ``*`` (anything) and ``^`` (a separator or an end). Only whole literal tokens
are indexed, those with a separator on both sides. The tokens of a url fetch the rules
below them, and the regular expressions of these rules alone are run. A rule without any
whole token lies under the empty token, which every url has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower

# Rules of the query, as (rule, verdict).
HOST_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
# The method's own patterns for everything the rules leave open.
PATTERN_RULES = [
    ("^casino-*", "block"),
    ("^spam-farm^", "block"),
    ("^adult-*", "block"),
    ("^free-bets^", "block"),
    ("^poker^*.exe", "block"),
]
#: Up to so many rules are broadcast (their number is counted); beyond, Spark joins them by shuffles.
BROADCAST_RULES = 20_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = ascii_lower(F.regexp_extract(url, shape, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def rule_table(spark, hosts=None, patterns=None) -> DataFrame:
    rows = [(r, v, 2) for r, v in (HOST_RULES if hosts is None else hosts)]
    rows += [(r, v, 1) for r, v in (PATTERN_RULES if patterns is None else patterns)]
    return spark.createDataFrame(rows, "rule string, verdict string, tier int")


def compiled(rules: DataFrame) -> DataFrame:
    """Regular expression and whole literal tokens of each rule."""
    quoted = F.regexp_replace("rule", r"([^0-9A-Za-z])", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(quoted, r"\\\*", ".*"), r"\\\^", "(?:^|\\$|[^0-9A-Za-z])")
    anchored = F.concat(F.when(F.col("tier") == 2, "^").otherwise(""), F.col("rule"))
    tokens = F.regexp_extract_all(ascii_lower(anchored), F.lit(r"(?<=[^*0-9a-z])[0-9a-z]+(?=[^*0-9a-z])"), F.lit(0))
    return rules.select(
        "rule", "verdict", "tier",
        F.when(F.col("tier") == 2, F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted)).otherwise(F.concat(F.lit("(?s)"), wild)).alias("regex"),
        F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(tokens).alias("tokens"),
    )


def url_tokens(subject: Column) -> Column:
    """Distinct tokens and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(subject), "[^0-9a-z]+")))


def sized(side: DataFrame, rules: DataFrame) -> DataFrame:
    """side, broadcast if there are few enough rules."""
    return F.broadcast(side) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else side


def token_index(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule under the token that the fewest different urls have (ties: by name)."""
    wanted = rules.select("rule", "tier", F.explode(F.array_distinct("tokens")).alias("token"))
    seen = tokens.select("token").join(sized(wanted.select("token").distinct(), rules), "token", "left_semi").groupBy("token").count()
    rarest = (
        wanted.join(seen, "token", "left")
        .groupBy("rule", "tier")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("best"))
    )
    return rules.join(rarest, ["rule", "tier"]).select(F.col("best.token").alias("token"), "rule", "verdict", "tier", "regex")


def judge(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and the matched pattern of every row.

    Host rules (tier 2) go before patterns (tier 1), longer before shorter; of two verdicts
    for one rule text ``block`` wins. Nothing fits: rule null, verdict allow; so do null urls
    and urls without ``://`` (host and path empty). Repeated rows stay, an empty table gives
    an empty result, other columns are not looked at.

    Few rules (counted, at most BROADCAST_RULES) go to the tokens; many are joined by
    shuffles. Each different (host, path) is judged once, so a url that fills a third of the table is
    one row here; when verdicts go back to the pages, Spark may split the skewed side.
    """
    spark = pages.sparkSession
    ready = compiled(rule_table(spark) if rules is None else rules)
    host, path = parts(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    targets = rows.select("host", "path").where("host <> '' or path <> ''").distinct()
    tokens = targets.select("host", "path", F.explode(url_tokens(F.concat("host", "path"))).alias("token"))
    fits = (
        tokens.join(sized(token_index(tokens, ready), ready), "token")
        .where(F.expr("regexp_like(concat(host, path), regex)"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("tier", F.length("rule").alias("len"), "rule", "verdict")).alias("won"))
    )
    out = rows.join(fits, ["host", "path"], "left")
    return out.select(
        *keep, "host", "path",
        F.when(F.col("won.tier") == 2, F.col("won.rule")).alias("rule"),
        F.coalesce("won.verdict", F.lit("allow")).alias("verdict"),
        F.col("won.rule").alias("matched"),
    )
