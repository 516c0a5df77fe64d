"""URL filters: pattern rules indexed by their rarest literal token, so that few of them run on any URL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landheat.llm.common import text_key, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """A pattern on host and path in one, and literal tokens of which each is in every URL that the pattern fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool = False


def site_rule(verdict: str, rule: str) -> UrlRule:
    """A rule `host/path` that fits its host, all subdomains, and all paths that begin with its path."""
    host, _, path = rule.partition("/")
    closed = [*re.split(r"[^a-z0-9]+", host), *re.split(r"[^a-z0-9]+", path.lower())[:-1]]
    return UrlRule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(t for t in closed if t), True)


def word_rule(word: str) -> UrlRule:
    """Blocks hosts in which the word stands alone between dots and hyphens."""
    return UrlRule(f"word:{word}", "block", rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)", (word,))


#: The marks of filter lists: any text, and a character that no name holds (or the end).
WILD, SEPARATOR = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\z)"}, re.compile(r"([*^])")


def list_rule(line: str) -> UrlRule | None:
    """A line of a filter list as a rule on host and path in one, in either case of A-Z; None for comments and blanks.

    `||` begins at the host or a subdomain of it, `|` is the text's begin or end, `*` any text, `^` a separator or the end,
    and `@@` makes an exception: it allows what others block. Options (`$`) and rules on page elements (`##`) are errors,
    and so is a line without any text. A run of a-z and 0-9 is a token only if no wildcard or open end can lengthen it.
    """
    line = line.strip()
    if not line or line.startswith("!"):
        return None
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    if "$" in body or "##" in body:
        raise ValueError(f"options and element rules are not supported: {line}")
    begin = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    body = body[len(begin) :]
    end = "|" if body.endswith("|") else ""
    body = body[: len(body) - len(end)]
    if not body.strip("*^"):
        raise ValueError(f"no text to match: {line}")
    pattern = {"||": r"^(?:[^/]*\.)?", "|": "^", "": ""}[begin] + "".join(WILD.get(x) or re.escape(x) for x in SEPARATOR.split(body)) + (r"\z" if end else "")
    # an open end is a wildcard to tokens; a separator parts them
    runs = re.split(r"([^a-z0-9*]+)", ("" if begin else "*") + lowered_text(body) + ("" if end else "*"))
    return UrlRule(line, verdict, f"(?is){pattern}", tuple(dict.fromkeys(x for x in runs if x.isascii() and x.isalnum())))


def lowered_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def list_rules(lines: DataFrame, column: str = "rule", most_rules: int = 100_000) -> tuple[UrlRule, ...]:
    """The rules of a table of filter-list lines, at most most_rules; repeated lines are one rule, nulls none."""
    found = [r[0] for r in lines.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most_rules + 1).collect()]
    if len(found) > most_rules:
        raise ValueError(f"over {most_rules} rules")
    return tuple(r for r in map(list_rule, found) if r)


#: The base rules, and words of hosts that the method blocks.
RULES = (
    site_rule("allow", "org/"),
    site_rule("block", "example.org/es/"),
    site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"),
    site_rule("block", "com/de/"),
    *map(word_rule, ("adult", "ads", "bets", "casino", "pills", "spam")),
)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(key: Column) -> Column:
    """Distinct runs of a-z and 0-9, and `*`, by which rules without a literal token are found."""
    found = F.filter(F.split(lowered(key), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_distinct(F.concat(F.array(F.lit("*")), found))


def rule_index(urls: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """(token, name, verdict, pattern, base): each rule under that of its tokens which the fewest URLs have."""
    spark = urls.sparkSession
    rows = [(t, r.name, r.verdict, r.pattern, r.base) for r in rules for t in (r.tokens or ("*",))]
    own = F.broadcast(spark.createDataFrame(rows, "token string, name string, verdict string, pattern string, base boolean"))
    counts = urls.select(F.explode("tokens").alias("token")).join(own.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare")
    return own.join(counts, "token", "left").groupBy("name", "verdict", "pattern", "base").agg(rare).select("rare.token", "name", "verdict", "pattern", "base")


def distinct_urls(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with a key of their URL, and each distinct URL once, with host, path and tokens, written."""
    rows = pages.select("page_id", "url", text_key("url").alias("url_key"))
    host, path = parts(F.col("url"))
    urls = rows.select("url", "url_key").distinct().select("url_key", host.alias("host"), path.alias("path"))
    return rows, written(urls.withColumn("key", F.concat("host", "path")).withColumn("tokens", tokens(F.col("key"))), "urls")


def candidates(urls: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """(url_key, key, rule): the rules whose rarest token a URL has."""
    index = F.broadcast(rule_index(urls, rules))
    return urls.select("url_key", "key", F.explode("tokens").alias("token")).join(index, "token")


def judged(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, most_rules: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, words): the longest base rule decides, else the method's rules, else allow.

    Of the method's rules that fit, an exception (a rule that allows) goes before all that block; words names them all.
    Null and odd URLs have an empty host and path and are allowed; URLs of any length are matched whole; rules that tie
    in length go by name; null ids and repeated rows keep their rows; an empty table gives no rows; other columns are
    ignored, whatever their names. Rules, at most most_rules, are broadcast; a URL's tokens fetch its candidates and only those
    are matched. Each distinct URL is judged once.
    """
    if len(rules) > most_rules:
        raise ValueError(f"over {most_rules} rules")
    rows, urls = distinct_urls(pages)
    fits = candidates(urls, rules).filter(F.rlike("key", F.col("pattern")))
    best = F.max(F.when(F.col("base"), F.struct(F.length("name").alias("size"), "name", "verdict"))).alias("best")
    words = F.sort_array(F.collect_set(F.when(~F.col("base"), F.col("name")))).alias("words")
    # of the method's rules an exception goes before a block, as "allow" does before "block"
    own = F.min(F.when(~F.col("base"), F.col("verdict"))).alias("own")
    found = urls.select("url_key", "host", "path").join(fits.groupBy("url_key").agg(best, words, own), "url_key", "left")
    out = rows.select("page_id", "url_key").join(found, "url_key")
    verdict = F.coalesce("best.verdict", "own", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def patterns_run(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(patterns, urls): how many distinct URLs have how many patterns run on them."""
    _, urls = distinct_urls(pages)
    per_url = candidates(urls, rules).groupBy("url_key").agg(F.count(F.lit(1)).alias("patterns"))
    per_url = urls.select("url_key").join(per_url, "url_key", "left")
    return per_url.groupBy(F.coalesce("patterns", F.lit(0)).alias("patterns")).agg(F.count(F.lit(1)).alias("urls"))
