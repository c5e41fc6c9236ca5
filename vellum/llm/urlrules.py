"""URL verdicts: exact host and path rules first, association rules mined by FP-growth for the rest."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

HOST_DEPTH, PATH_DEPTH, IN_PLACE = 4, 6, 50


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#`` (A-Z lower-cased), then the path up to ``?`` or ``#``. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: the labels of its host with their depth from the right, its path segments without digits with their depth.

    What lies deeper than HOST_DEPTH labels or PATH_DEPTH segments is one token more each, so a url has at most
    HOST_DEPTH + PATH_DEPTH + 2 tokens and its combinations stay bounded.
    """

    def of(kind: str, parts: Column, depth: int) -> Column:
        own = F.transform(F.slice(parts, 1, depth), lambda x, i: F.concat(F.lit(kind), i.cast("string"), F.lit("="), x))
        rest = F.array_join(F.slice(parts, depth + 1, 1 << 30), "/")
        return F.when(F.size(parts) > depth, F.array_append(own, F.concat(F.lit(f"{kind}{depth}+="), rest))).otherwise(own)

    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike(r"\d"), F.lit("#")).otherwise(ascii_lower(x)))
    return F.array_distinct(F.concat(of("h", labels, HOST_DEPTH), of("p", segments, PATH_DEPTH)))


def listed(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``pages`` with host, path, and the longest fitting rule (verdict, host, path) as ``rule`` and ``listed``.

    Of rules of one length that with the longer host wins, then the larger verdict, host and path. Up to IN_PLACE rules of
    a list are an expression; more, and tables (verdict, host, path), are joined by the suffixes of the hosts.
    """
    host, path = host_and_path(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    if not isinstance(rules, DataFrame) and len(rules) > IN_PLACE:
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    if isinstance(rules, DataFrame):
        return _joined(out, rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):  # a longer rule is put around the shorter ones
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("listed", verdict)


def _joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: a host meets the rules of its suffixes, of as many labels as the rules have at most."""
    rules = rules.where("verdict is not null and rule_host is not null and rule_path is not null")
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    keys = pages.select("host", "path").distinct()
    met = keys.withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    size = F.length("rule_host")
    rank = F.struct((size + F.length("rule_path")).alias("n"), size.alias("h"), "verdict", "rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.verdict").alias("listed"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, "rule", "listed")


def mined_rules(labelled: DataFrame, support: float, confidence: float, least_tokens: int, scratch: Scratch) -> DataFrame:
    """Association rules (rule_id, items, label, confidence, support) from urls (tokens, label), mined from all of them.

    Only rules of at least ``least_tokens`` tokens whose label holds with ``confidence`` stay, and of these the minimal
    ones: a rule that another of the same label covers with fewer tokens says nothing new. They are never collected;
    ``rule_id`` is a hash of label and tokens.
    """
    baskets = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select(F.array_append("tokens", F.concat(F.lit("="), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")) & (F.size("antecedent") >= least_tokens))
    found = found.select(F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), 2, 100).alias("label"), "confidence", "support")
    found = scratch.keep(found.select(F.xxhash64("label", "items").alias("rule_id"), "*"), "rules")
    # A rule goes if another one's tokens are all among its own, found by an index from tokens to rules.
    each = found.select("rule_id", "label", F.size("items").alias("n"), F.explode("items").alias("token"))
    less = each.select(F.col("rule_id").alias("less"), "label", F.col("n").alias("need"), "token")
    covered = each.join(less, ["label", "token"]).where("need < n").groupBy("rule_id", "less", "need").agg(F.count("*").alias("got")).where("got = need").select("rule_id")
    return scratch.keep(found.join(covered, "rule_id", "left_anti"), "minimal")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, support: float = 0.01, confidence: float = 0.9, least_tokens: int = 2, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every row of ``pages`` (page_id, url).

    The longest listed rule decides. The urls that the list covers are the labels; token combinations mined from all of
    them decide on the rest: the matching mined rule with the highest confidence, then support, then most tokens; no match
    gives ``default``. Null urls and urls without ``://`` have an empty host and path and no token. Every row is kept,
    repeated ones too; other columns of ``pages`` play no part. Equal urls are judged once.
    """
    scratch = Scratch(pages.sparkSession, "urlrules")
    base = listed(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    known = base.select("host", "path", F.col("listed").alias("label"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    mined = mined_rules(known.where("label is not null").select("tokens", "label"), support, confidence, least_tokens, scratch)
    # Inverted index from a token to the rules that need it; whole rules are those all of whose tokens were met.
    index = mined.select(F.explode("items").alias("token"), "rule_id", F.size("items").alias("need"), "label", F.struct("confidence", "support", F.size("items").alias("n"), "rule_id").alias("rank"))
    open_keys = base.where("listed is null").select("host", "path").distinct()
    met = open_keys.select("host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token")).join(index, "token")
    whole = met.groupBy("host", "path", "rule_id", "need", "label", "rank").agg(F.count("*").alias("got")).where("got = need")
    best = whole.groupBy("host", "path").agg(F.max_by(F.struct("label", "rule_id"), "rank").alias("best"))
    out = base.join(best, ["host", "path"], "left")
    mine = F.when(F.col("listed").isNull(), F.col("best.label"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", mine, F.lit(default)).alias("verdict"), F.when(F.col("listed").isNull(), F.col("best.rule_id")).alias("mined_rule"))
