"""URL filters: rule verdicts carried over redirect and canonical-link equivalence.

A url's verdict is that of the longest rule that fits it.  Urls that a redirect
or a canonical link joins are one resource under several names: a block found
for any of them holds for all, except where a url has an allow rule of its own,
which always wins.  Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.components import connected_components


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Above so many rules they are joined by host suffix instead of tried in one expression.
INLINE_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; '' without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ranked(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))


def rule_columns(df: DataFrame, host: str, path: str, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (both null if no rule fits); allow wins between equally long rules.

    Hosts and paths are not null; any number of rules gives the same columns.
    """
    if len(rules) <= INLINE_RULES:
        name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(_ranked(rules)):
            fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path))
            name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return df.withColumns({"rule": name, "rule_verdict": verdict})
    spark = df.sparkSession
    ranked = _ranked(rules)
    table = spark.createDataFrame([(r.host, r.path, r.name, r.verdict, i) for i, r in enumerate(ranked)], "_h string, _p string, _n string, _v string, _i int")
    parts = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    pairs = df.select(host, path).distinct().withColumn("_h", F.explode(suffixes))
    best = (
        pairs.join(table, "_h").where(F.startswith(F.col(path), F.col("_p")))
        .groupBy(host, path).agg(F.min_by(F.struct("_n", "_v"), "_i").alias("_r"))
        .select(host, path, F.col("_r._n").alias("rule"), F.col("_r._v").alias("rule_verdict"))
    )
    return df.join(best, [host, path], "left")


def named(df: DataFrame, url: str, node: str) -> DataFrame:
    """Adds a url's name in the alias graph: host in lower case, no fragment; null if it isn't absolute.

    In steps, so that no expression is written out many times in the generated code.
    """
    bare = df.withColumn("_b", F.regexp_replace(url, r"(?s)#.*$", ""))
    parts = bare.withColumns({"_at": F.instr("_b", "://"), "_rest": F.regexp_extract("_b", r"(?s)://(.*)$", 1)})
    host = F.translate(F.regexp_extract("_rest", r"^([^/?]*)", 1), UPPER, LOWER)
    scheme = F.translate(F.substring(F.col("_b"), F.lit(1), F.col("_at") - 1), UPPER, LOWER)
    name = F.concat(scheme, F.lit("://"), host, F.regexp_extract("_rest", r"(?s)^[^/?]*(.*)$", 1))
    return parts.withColumn(node, F.when(F.col("_at") > 0, name)).drop("_b", "_at", "_rest")


def _attribute(tag: Column, name: str) -> Column:
    pattern = r"""(?is)\s%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""" % name
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _resolve(to: str, scheme: str, host: str, path: str) -> Column:
    target, root = F.col(to), F.concat(F.col(scheme), F.lit("://"), F.col(host))
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(F.col(to).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.col(scheme), F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` nodes from all canonical links and meta refreshes of each page, but those inside comments, scripts and styles."""
    seen = pages.select("url", "html").where("html is not null and instr(url, '://') > 0")
    seen = seen.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    bare = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    links = F.regexp_extract_all(bare, F.lit(r"""(?is)<link\b(?=[^>]*\srel\s*=\s*["']?canonical\b)[^>]*>"""), F.lit(0))
    metas = F.regexp_extract_all(bare, F.lit(r"""(?is)<meta\b(?=[^>]*\shttp-equiv\s*=\s*["']?refresh\b)[^>]*>"""), F.lit(0))
    tags = seen.select("url", F.explode(F.concat(F.transform(links, lambda t: F.struct(F.lit("href").alias("kind"), t.alias("tag"))), F.transform(metas, lambda t: F.struct(F.lit("content").alias("kind"), t.alias("tag"))))).alias("t"))
    target = F.when(F.col("t.kind") == "href", _attribute(F.col("t.tag"), "href")).otherwise(F.regexp_extract(_attribute(F.col("t.tag"), "content"), r"""(?is)url\s*=\s*["']?([^"']+)""", 1))
    ends = tags.select("url", target.alias("to")).where("to <> ''")
    ends = ends.withColumn("to", F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&")))
    ends = ends.withColumns({"scheme": F.regexp_extract("url", r"^([^:]*)://", 1), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ends = ends.select("url", _resolve("to", "scheme", "host", "path").alias("to"))
    return named(ends, "url", "src").transform(lambda d: named(d, "to", "dst")).select("src", "dst").where("src is not null and dst is not null")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[Rule] = RULES, default: str = "allow", key: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: key, url, host, path, rule, verdict, alias_block.

    ``redirects`` (src, dst urls) adds edges seen by a crawler to those found in
    ``html``.  A url that is null or has no ``://`` has an empty host and path,
    fits no rule and gets ``default``.  Repeated rows are judged each.  A rule of
    the url itself decides; else a block rule anywhere in its alias component
    blocks it; else ``default``.
    """
    base = pages.select(key, "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = rule_columns(base, "host", "path", rules)
    edges = page_edges(pages)
    if redirects is not None:
        seen = redirects.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        edges = edges.unionByName(named(named(seen, "_s", "src"), "_d", "dst").select("src", "dst"))
    groups = connected_components(edges)
    parts = groups.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
    own = rule_columns(parts, "host", "path", rules)
    blocked = own.where("rule_verdict = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_hit"))
    out = named(judged, "url", "_node").join(aliases, "_node", "left")
    alias_block = F.col("rule_verdict").isNull() & F.coalesce("_hit", F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(alias_block, "block").otherwise(default))
    return out.select(key, "url", "host", "path", "rule", verdict.alias("verdict"), alias_block.alias("alias_block"))
