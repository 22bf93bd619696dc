"""URL filter with redirect equivalence.

Allow and block rules decide urls directly. Pages that redirect or name a canonical address are one group with
their targets; a block inside a group reaches all its members that no rule decides. An explicit allow stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize
from .components import connected_components

# (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK, REFRESH = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
IS_CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
IS_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF, TARGET = r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)", r"(?i)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for null and for a text without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def address(rest: Column) -> Column:
    """What names a page: host, path and query. Scheme and fragment do not make another page."""
    return F.nullif(F.concat(host_of(rest), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Position in `rules` of the longest rule that fits, or null. Of equally long ones the first counts."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    fits = [F.when(((host == rules[i][1]) | host.endswith("." + rules[i][1])) & path.startswith(rules[i][2]), F.lit(i))
            for i in order]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def _named(at: Column, values: list[str]) -> Column:
    return F.coalesce(*[F.when(at == i, F.lit(v)) for i, v in enumerate(values)], F.lit(None).cast("string"))


def targets(html: Column) -> Column:
    """Addresses in canonical links and immediate or delayed refreshes, as written."""
    canonical = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: t.rlike(IS_CANONICAL))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: t.rlike(IS_REFRESH))
    return F.concat(F.transform(canonical, lambda t: F.regexp_extract(t, HREF, 1)),
                    F.transform(refresh, lambda t: F.regexp_extract(t, TARGET, 1)))


def resolved(target: Column, host: Column, path: Column) -> Column:
    """A target as `host/path?query`, seen from a page."""
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    rest = F.when(F.instr(t, "://") > 0, after_scheme(t)).when(t.startswith("//"), F.substring(t, F.lit(3), F.length(t))) \
        .when(t.startswith("/"), F.concat(host, t)) \
        .otherwise(F.concat(host, F.nullif(F.regexp_replace(path, "[^/]*$", ""), F.lit("")), t))
    return address(F.coalesce(rest, F.concat(host, F.lit("/"), t)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages` (page_id, url, html).

    A page is linked to the targets of its canonical links and refreshes; `links` (source, target: urls) adds
    known redirects. A url with a rule gets the rule's verdict. Any other is blocked if its group holds a
    blocked address, else allowed. Null urls and urls without `://` have an empty host and path and are
    allowed; a null html has no links; repeated rows are judged alike. Other columns are ignored.
    """
    rest = after_scheme(F.col("url"))
    parsed = pages.select("page_id", "html", host_of(rest).alias("host"), path_of(rest).alias("path"), address(rest).alias("key"))
    found = parsed.where("key IS NOT NULL").select("key", "host", "path", F.explode(targets(F.col("html"))).alias("target")) \
        .where("target <> ''").select(F.col("key").alias("a"), resolved(F.col("target"), F.col("host"), F.col("path")).alias("b"))
    if links is not None:
        found = found.union(links.select(address(after_scheme(F.col("source"))), address(after_scheme(F.col("target")))))
    groups = materialize(connected_components(found))
    names, verdicts = [h + p for _, h, p in rules], [v for v, _, _ in rules]
    own = _named(rule_for(host_of(F.col("node")), path_of(F.col("node")), rules), verdicts)
    bad = materialize(groups.where(own == "block").select(F.col("root").alias("bad")).distinct())
    reached = materialize(groups.join(bad, F.col("root") == F.col("bad")).select("node").distinct())
    at = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", "key", at.alias("at"))
    joined = ruled.join(reached, F.col("key") == F.col("node"), "left")
    return joined.select("page_id", "host", "path", _named(F.col("at"), names).alias("rule"), F.coalesce(
        _named(F.col("at"), verdicts), F.when(F.col("node").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark, sf: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf}/pages.parquet"))


QUERIES = {"op4_url_filter": op4_url_filter}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _sql_host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _sql_path(rest: str) -> str:
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _sql_key(rest: str) -> str:
    return f"nullif({_sql_host(rest)} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1), '')"


def _sql_rule(what: int) -> str:
    rows = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(v, h + p)[what]}'" for v, h, p in rows) + " END"


ORACLES = {"op4_url_filter": f"""WITH RECURSIVE p AS (SELECT page_id, html, {_sql_rest('url')} AS rest FROM pages),
q AS (SELECT page_id, html, {_sql_host('rest')} AS host, {_sql_path('rest')} AS path, {_sql_key('rest')} AS key FROM p),
t AS (SELECT key, host, path, unnest(regexp_extract_all(html, {_q(LINK)})) AS tag, {_q(IS_CANONICAL)} AS kind, {_q(HREF)} AS pick FROM q
  UNION ALL SELECT key, host, path, unnest(regexp_extract_all(html, {_q(REFRESH)})), {_q(IS_REFRESH)}, {_q(TARGET)} FROM q),
u AS (SELECT key, host, path, replace(CASE WHEN pick = {_q(HREF)} THEN regexp_extract(tag, {_q(HREF)}, 1)
  ELSE regexp_extract(tag, {_q(TARGET)}, 1) END, '&amp;', '&') AS target FROM t WHERE
  (kind = {_q(IS_CANONICAL)} AND regexp_matches(tag, {_q(IS_CANONICAL)})) OR (kind = {_q(IS_REFRESH)} AND regexp_matches(tag, {_q(IS_REFRESH)}))),
w AS (SELECT key, CASE WHEN instr(target, '://') > 0 THEN {_sql_rest('target')} WHEN starts_with(target, '//') THEN substr(target, 3)
  WHEN starts_with(target, '/') THEN host || target
  ELSE host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || target END AS rest FROM u WHERE target <> '' AND key IS NOT NULL),
e AS (SELECT key AS a, {_sql_key('rest')} AS b FROM w),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT DISTINCT a AS node, {_sql_host('a')} AS host, {_sql_path('a')} AS path FROM s WHERE a IS NOT NULL),
r AS (SELECT node FROM n WHERE {_sql_rule(0)} = 'block' UNION SELECT s.b FROM r JOIN s ON r.node = s.a WHERE s.b IS NOT NULL)
SELECT page_id, host, path, {_sql_rule(1)} AS rule,
  coalesce({_sql_rule(0)}, CASE WHEN key IN (SELECT node FROM r) THEN 'block' ELSE 'allow' END) AS verdict FROM q"""}
