"""Robots rules as tables: parsing, permission by longest match, and pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def octets(p: Column) -> Column:
    """A path as rules compare it: non-ASCII and spaces percent-encoded, escapes in upper case."""
    chars = F.split(p, "")
    quoted = F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"^[!-~]?$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))), "")
    cut = F.split(quoted, "%")
    rest = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.when(x.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, F.lit(3), F.length(x)))).otherwise(x))
    return F.array_join(F.concat(F.array(cut[0]), rest), "%")


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: ``*`` is any run, a final ``$`` ends the path."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    parts = F.transform(F.split(body, r"\*", -1), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("\\Q"), x, F.lit("\\E"))))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.when(anchored, "$").otherwise(""))


def product_token(agent: Column) -> Column:
    """The product name of an agent string: 'Bot/2.1 (+...)' gives 'bot'."""
    return F.lower(F.regexp_extract(F.substring_index(F.trim(agent), "/", 1), r"^\S*", 0))


def parse_rules(files: DataFrame) -> DataFrame:
    """(host, group, agent, kind, pattern, allow, len, delay, requests, secs) from robots files (host, text).

    One row for each agent of a group and each of the group's rules. Consecutive agent lines share a group; one after a rule opens
    the next. Rules before any agent, empty rules and unreadable numbers are dropped.
    """
    lines = files.select("host", F.posexplode(F.split("text", "\r?\n")).alias("ord", "line"))
    lines = lines.withColumn("line", F.trim(F.substring_index("line", "#", 1))).filter(F.instr("line", ":") > 0)
    lines = lines.select("host", "ord", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    lines = lines.filter(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate"))
    by_host = Window.partitionBy("host").orderBy("ord")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by_host), F.lit("")) != "user-agent")
    lines = lines.withColumn("grp", F.sum(opens.cast("int")).over(by_host)).filter("grp > 0")
    agents = lines.filter("key = 'user-agent'").select("host", "grp", product_token(F.col("value")).alias("agent")).distinct()
    rules = lines.filter("key <> 'user-agent'")
    path = F.when(F.col("value").rlike(r"^[/*]"), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    is_rule = F.col("key").isin("allow", "disallow")
    rate = lambda k: F.regexp_extract("value", r"^\s*(\d+)\s*/\s*(\d+)\s*$", k).try_cast("int")
    rules = rules.select(
        "host", "grp", "ord",
        F.when(is_rule, "rule").otherwise(F.col("key")).alias("kind"),
        F.when(is_rule & (F.col("value") != ""), octets(path)).alias("pattern"),
        F.when(is_rule, F.col("key") == "allow").alias("allow"),
        F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double")).alias("delay"),
        F.when(F.col("key") == "request-rate", rate(1)).alias("requests"),
        F.when(F.col("key") == "request-rate", rate(2)).alias("secs"),
    )
    rules = rules.filter("pattern is not null or delay is not null or requests is not null").withColumn("len", F.length("pattern"))
    return agents.join(rules, ["host", "grp"])


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that bind an agent on each host: those of groups that name it, or else those of ``*``."""
    named = rules.filter(F.col("agent") == product_token(F.lit(agent)))
    rest = rules.filter("agent = '*'").join(named.select("host").distinct(), "host", "left_anti")
    return named.unionByName(rest)


def decide(links: DataFrame, rules: DataFrame) -> DataFrame:
    """``links`` (with url) and ``allowed``, ``rule_len``: the longest rule that matches wins, allowing on ties; no rule allows.

    Hosts are joined by hash, so a rule meets its own host's links only; ``rules`` are those of one agent. A host without
    rules, and /robots.txt, are allowed. Matching is a filter after the join; the best rule is kept by aggregation, never by a sort.
    """
    keyed = links.withColumn("__host", urls.netloc(F.col("url"))).withColumn("__id", F.monotonically_increasing_id())
    q = urls.query(F.col("url"))
    p = urls.path(F.col("url"))
    target = octets(F.concat(F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
    keyed = keyed.withColumn("__target", target)
    plain = rules.filter("kind = 'rule'").select(F.col("host").alias("__host"), pattern_regex(F.col("pattern")).alias("__regex"), "len", "allow")
    best = F.max(F.when(F.expr("__target rlike __regex"), F.struct("len", "allow")))
    own = links.columns
    joined = keyed.join(plain, "__host", "left").groupBy("__id", "__host", "__target", *own).agg(best.alias("best"))
    robots = urls.path(F.col("url")) == "/robots.txt"
    return joined.select(*own, (robots | F.coalesce(F.col("best.allow"), F.lit(True))).alias("allowed"), F.when(~robots, F.col("best.len")).alias("rule_len"))


def pace(rules: DataFrame) -> DataFrame:
    """(host, delay, requests, secs): the first stated of each, in order of groups; ``rules`` are those of one agent."""
    first = lambda c: F.min_by(c, F.struct("grp", F.lit(0) - F.col("ord"))).alias(c)  # noqa: E731  the last line of the first group that states it
    out = rules.filter("kind = 'crawl-delay' and delay is not null").groupBy("host").agg(first("delay"))
    rate = rules.filter("kind = 'request-rate' and requests is not null").groupBy("host").agg(first("requests"), first("secs"))
    return out.join(rate, "host", "full_outer")
