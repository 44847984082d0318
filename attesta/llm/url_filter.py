"""URL filters with redirect equivalence.

A URL is judged by the longest rule that fits its host (or a parent domain) and the start of its path; an allow rule wins over a block rule of the
same length. URLs that no rule fits take part in an equivalence: pages that redirect to each other (meta refresh) or name a canonical link are aliases,
and the connected components of these edges carry block decisions to every member that has no rule of its own. An explicit allow of a URL thus
holds against any blocked alias.

Plan: everything is built-in expressions; pages without such tags (nearly all) are never shuffled for the graph, only nodes that have an edge are.
Hot hosts cost nothing: nothing is grouped by host. Pages that are no node are spread evenly in the join with aliases.

Cases: a null url, or one without ://, has empty host and path, fits no rule with a host and is allowed. Null html has no edges. Repeated rows
and ids are judged one by one. A URL that only occurs as a link target is a member of its component with the rules that fit it. Very long urls and
pages are taken whole. Columns of the input stay, whatever their names, but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_BYTES, free_name, text_table, tune, written
from attesta.llm.components import connected_components

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Rules that become one expression; more are joined by host suffix.
MOST_EXPRESSIONS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node(url: Column) -> Column:
    """A URL's identity among aliases: host, path and query, without scheme and fragment; null without ://."""
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.regexp_extract(url, _PARTS, 2), F.regexp_extract(url, _PARTS, 3)))


def _judged(df: DataFrame, rules: list[tuple[str, str, str]], hit: str = "hit") -> DataFrame:
    """df, which has host and path, with hit: struct(length, allowed, rule, verdict) of the best rule, or null."""
    if len(rules) <= MOST_EXPRESSIONS:
        hits = [
            F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(int(v == "allow")).alias("allowed"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules
        ]
        return df.withColumn(hit, F.greatest(*hits, *hits[:1]) if hits else F.lit(None).cast("struct<length:int,allowed:int,rule:string,verdict:string>"))
    table = df.sparkSession.createDataFrame([(h, p, len(h + p), int(v == "allow"), h + p, v) for h, p, v in rules], "rh string, rp string, length int, allowed int, rule string, verdict string")
    if sum(len(h + p) + 80 for h, p, _ in rules) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    labels = F.split("host", r"\.")
    own = df.select("host", "path").distinct()
    tails = own.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rh"))
    best = tails.join(table, "rh").where(F.col("path").startswith(F.col("rp"))).groupBy("host", "path").agg(F.max(F.struct("length", "allowed", "rule", "verdict")).alias(hit))
    return df.join(best, ["host", "path"], "left")


def links(pages: DataFrame) -> DataFrame:
    """(a, b): the edges from a page's node to what its canonical links and meta refreshes name."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = (
        pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & (F.instr("url", "://") > 0))
        .select("url", F.explode(tags).alias("tag"))
        .select(
            "url",
            F.when(F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
            .when(F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
            .alias("to"),
        )
        .where("to <> ''")
    )
    to = F.col("to")
    full = (
        F.when(F.instr(to, "://") > 0, to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.startswith("/"), F.concat(F.lit("x://"), host(F.col("url")), to))
        .otherwise(F.concat(F.lit("x://"), host(F.col("url")), F.regexp_replace(path(F.col("url")), r"[^/]*$", ""), to))
    )
    return tag.select(node(F.col("url")).alias("a"), node(full).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. edges (a, b) of nodes come from the html unless given."""
    tune(pages.sparkSession)
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    names = [F.col(f"`{c}`") for c in own]
    hit = free_name(pages, "hit")
    base = _judged(pages.select(*names, host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules, hit)
    edges = written((links(pages) if edges is None else edges).select("a", "b").distinct(), "links")
    if not edges.head(1):
        return base.select(*names, "host", "path", F.col(f"{hit}.rule").alias("rule"), F.coalesce(f"{hit}.verdict", F.lit("allow")).alias("verdict"))
    members = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    judged = _judged(members.withColumn("host", host(as_url)).withColumn("path", path(as_url)), rules)
    blocked = judged.where("hit.verdict = 'block'").select("component").distinct()
    at, alias = free_name(base, "node"), free_name(base, "alias")
    hit_nodes = members.join(blocked, "component", "left_semi").select(F.col("node").alias(at), F.lit(True).alias(alias))
    # what is no node gets a key of its own that no node has
    key = F.coalesce(node(F.col("url")), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    out = base.withColumn(at, key).join(hit_nodes, at, "left")
    verdict = F.coalesce(f"{hit}.verdict", F.when(F.col(alias), "block"), F.lit("allow"))
    return out.select(*names, "host", "path", F.col(f"{hit}.rule").alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(text_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_parts(url: str) -> str:
    low = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}')"
    return f"coalesce({low}, '') AS host, coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path"


def _sql_rule(table: str, key: str) -> str:
    return f"""SELECT t.{key}, max({{'length': length(r.h || r.p), 'allowed': (r.v = 'allow')::INT, 'rule': r.h || r.p, 'verdict': r.v}}) AS hit
  FROM {table} t JOIN rules r ON (t.host = r.h OR ends_with(t.host, '.' || r.h)) AND starts_with(t.path, r.p) GROUP BY t.{key}"""


def _sql_node(url: str) -> str:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
    return f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract({url}, '{pattern}', 1), '{UPPER}', '{LOWER}') || regexp_extract({url}, '{pattern}', 2) || regexp_extract({url}, '{pattern}', 3) END"


OP10_SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parts AS (SELECT page_id, url, {_sql_parts("url")} FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND contains(url, '://')),
named AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS target FROM tags),
full_to AS (SELECT n.url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'x:' || target
  WHEN starts_with(target, '/') THEN 'x://' || p.host || target ELSE 'x://' || p.host || regexp_replace(p.path, '[^/]*$', '') || target END AS target
  FROM named n JOIN (SELECT DISTINCT url, host, path FROM parts) p ON n.url = p.url WHERE target <> ''),
e AS (SELECT DISTINCT {_sql_node("url")} AS a, {_sql_node("target")} AS b FROM full_to),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
nodes AS (SELECT n, {_sql_parts("'x://' || n")} FROM (SELECT DISTINCT a AS n FROM both_ways)),
node_hit AS ({_sql_rule("nodes", "n")}),
aliased AS (SELECT DISTINCT r.a FROM reach r JOIN node_hit h ON r.b = h.n WHERE h.hit.verdict = 'block'),
urls AS (SELECT DISTINCT host || chr(10) || path AS k, host, path FROM parts),
page_hit AS ({_sql_rule("urls", "k")})
SELECT page_id, host, path, h.hit.rule AS rule, coalesce(h.hit.verdict, CASE WHEN x.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parts LEFT JOIN page_hit h ON h.k = host || chr(10) || path LEFT JOIN aliased x ON x.a = {_sql_node("url")}
"""
