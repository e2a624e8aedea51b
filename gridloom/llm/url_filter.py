"""URL filters by a path-template tree, in DataFrame operations only.

For each host the distinct paths form a tree of segments. Numbers stand as ``0`` in a node's name; the rare words of
a level (at most ``CHILD_SHARE`` pages each, ``LEAST_CHILDREN`` or more such words) stand as ``*``, so that
what lies below a variable word is counted together. A node whose children are many and nearly as many as its pages holds
a variable part, and its children become ``*``. A path with its wildcards is a template.

The first literal segment of a template names its branch. Branches of a host with the same segments before them are compared,
labelled or not: by the distribution of their paths over the templates below (chi-squared against all of
them together), and by their labelled rates. Those alike are merged: their templates of one form are judged by common
counts. A template is rejected when its labelled purity, smoothed towards a half, reaches a threshold;
without labels it stays at a half, which rejects nothing. Listed rules come first: the longest that fits
decides (of one length, the one later in the alphabet), and gives the labels.

A null url, or one without ``://``, has an empty host and path. Repeated urls share a template. Very long paths
have one row a segment while the tree is built. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage

from .common import register, table

# The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHILDREN = 6
CHILD_SHARE = 4
ALIKE = 4.0
SMOOTHING = 4.0
REJECT = 0.8
#: Parts in which the rows of one node are joined, as a host's first node may hold a third of all.
SPREAD = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    fitting = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _spread_join(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose hot keys are dealt over ``SPREAD`` parts, ``few`` being repeated in each."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int"))
    repeated = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(repeated, [*keys, "part"], "left").drop("part")


def _named_segments(paths: DataFrame) -> DataFrame:
    """(host, path, pages, at): the segments of each path with the names under which they stand in the tree."""
    cut = paths.select("host", "path", "pages", F.posexplode(F.split("path", "/")).alias("depth", "segment"))
    cut = cut.withColumn("name", F.regexp_replace("segment", "[0-9]+", "0"))
    words = cut.groupBy("host", "depth", "name").agg(F.sum("pages").alias("n")).where(F.col("n") <= CHILD_SHARE)
    levels = words.groupBy("host", "depth").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_CHILDREN)
    rare = words.join(levels, ["host", "depth"]).select("host", "depth", "name", F.lit(True).alias("rare"))
    named = _spread_join(cut, rare, ["host", "depth", "name"])
    name = F.when(F.col("rare"), F.lit("*")).otherwise(F.col("name"))
    at = F.sort_array(F.collect_list(F.struct("depth", "segment", name.alias("name"))))
    return named.groupBy("host", "path").agg(F.max("pages").alias("pages"), at.alias("at"))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, pages, labelled, blocked), each path once, with its template, lead, branch and form."""
    chained = F.aggregate(
        "at", F.array(F.xxhash64("host")), lambda done, a: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), a["name"]))),
    )
    one = stage(_named_segments(paths), "url-segments").withColumn("chain", chained)
    one = one.select("host", "path", "pages", F.posexplode(F.arrays_zip("chain", "at")).alias("depth", "x"))
    one = one.where(F.col("x.at").isNotNull()).select(
        "host", "path", "pages", "depth", F.col("x.chain").alias("node"), F.col("x.at.segment").alias("segment")
    )
    children = one.groupBy("host", "node", "segment").agg(F.sum("pages").alias("pages"))
    variable = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("k"), F.sum("pages").alias("n")).where(
        (F.col("k") >= LEAST_CHILDREN) & (F.col("k") * CHILD_SHARE >= F.col("n"))
    )
    marked = _spread_join(one, variable.select("host", "node", F.lit(True).alias("wild")), ["host", "node"])
    segment = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("segment"))
    whole = marked.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("depth", segment.alias("s")))).alias("parts"))
    parts = F.transform("parts", lambda p: p["s"])
    literal = F.transform(parts, lambda s: (s != "*") & (s != ""))
    first = F.coalesce(F.array_position(literal, F.lit(True)), F.lit(0)).cast("int")
    form = F.transform(parts, lambda s, i: F.when(i + 1 == first, F.lit("+")).otherwise(s))
    whole = whole.select(
        "host", "path", F.array_join(parts, "/").alias("template"), F.array_join(form, "/").alias("form"),
        F.when(first > 0, F.array_join(F.slice(parts, 1, first - 1), "/")).otherwise(F.lit("-")).alias("lead"),
        F.when(first > 0, F.element_at(parts, first)).otherwise(F.lit("")).alias("branch"),
    )
    return paths.join(whole, ["host", "path"])


def purity(found: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, template, labelled, purity) of ``templates``; branches alike are merged."""
    own = found.groupBy("host", "lead", "branch", "form", "template").agg(
        F.count(F.lit(1)).alias("o"), F.sum("labelled").alias("n"), F.sum("blocked").alias("b")
    )
    forms = own.groupBy("host", "lead", "form").agg(F.sum("o").alias("fo"), F.sum("n").alias("fn"), F.sum("b").alias("fb"))
    pool = forms.groupBy("host", "lead").agg(
        F.sum("fo").alias("po"), F.sum("fn").alias("pn"), F.sum("fb").alias("pb"), (F.count(F.lit(1)) - 1).alias("free")
    )
    square = F.col("o").cast("double") * F.col("o") / F.col("fo")
    branches = own.join(forms, ["host", "lead", "form"]).groupBy("host", "lead", "branch").agg(
        F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(square).alias("squares")
    ).join(pool, ["host", "lead"])
    o, po, free, n, b, pn, pb = (F.col(c).cast("double") for c in ("o", "po", "free", "n", "b", "pn", "pb"))
    off = b * pn - pb * n
    same_paths = F.round(po / o * F.col("squares") - o, 6) <= free + ALIKE * F.sqrt(free)
    same_rate = off * off * (pn + 2.0) * (pn + 2.0) <= ALIKE * n * pn * pn * (pb + 1.0) * (pn - pb + 1.0)
    alike = branches.select("host", "lead", "branch", (same_paths & same_rate).alias("alike"))
    both = own.join(alike, ["host", "lead", "branch"])
    merged = both.where("alike").groupBy("host", "lead", "form").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    both = both.join(merged, ["host", "lead", "form"], "left")
    n = F.when(F.col("alike"), F.col("mn")).otherwise(F.col("n"))
    b = F.when(F.col("alike"), F.col("mb")).otherwise(F.col("b"))
    return both.select(
        "host", "template", n.alias("labelled"),
        ((b.cast("double") + smoothing / 2) / (n.cast("double") + smoothing)).alias("purity"),
    )


def filter_urls(
    pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, reject: float = REJECT
) -> DataFrame:
    """(rec, host, path, rule, verdict, template) of each record: the rule's verdict, or else the tree's."""
    host, path = host_and_path(F.col(url).cast("string"))
    judged = pages.select(F.struct("*").alias("rec"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    paths = judged.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("hit").alias("labelled"),
        F.count(F.when(F.col("hit.verdict") == "block", 1)).alias("blocked"),
    )
    found = stage(templates(stage(paths, "url-paths")), "url-templates")
    bad = purity(found).where(F.col("purity") >= reject).select("host", "template", F.lit(True).alias("bad"))
    of = found.join(bad, ["host", "template"], "left").select("host", "path", "template", "bad")
    return judged.join(of, ["host", "path"]).select(
        "rec", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
    )


def _sql() -> str:
    fits = lambda rule: (lambda n, s, r: f"((host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{s + r}'))")(*rule.partition("/"))
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    return f"""
WITH rest AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), named AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
), ruled AS (SELECT *, {rule} AS rule FROM named), judged AS (SELECT *, {verdict} AS ruling FROM ruled),
paths AS (
  SELECT host, path, count(*) AS pages, count(ruling) AS labelled, count(*) FILTER (ruling = 'block') AS blocked
  FROM judged GROUP BY host, path
), segs AS (
  SELECT host, path, pages, i AS depth, s[i] AS segment, regexp_replace(s[i], '[0-9]+', '0', 'g') AS name
  FROM (SELECT *, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM paths)
), words AS (SELECT host, depth, name FROM segs GROUP BY ALL HAVING sum(pages) <= {CHILD_SHARE}),
rare AS (
  SELECT host, depth, name, true AS rare FROM words
  WHERE (host, depth) IN (SELECT (host, depth) FROM words GROUP BY host, depth HAVING count(*) >= {LEAST_CHILDREN})
), named_segs AS (
  SELECT host, path, any_value(pages) AS pages, list(segment ORDER BY depth) AS s,
         list(CASE WHEN rare THEN '*' ELSE name END ORDER BY depth) AS shape
  FROM segs LEFT JOIN rare USING (host, depth, name) GROUP BY host, path
), one AS (
  SELECT host, path, pages, i AS depth, s[i] AS segment, array_to_string(shape[1:i - 1], '/') || '|' || i AS node
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM named_segs)
), variable AS (
  SELECT host, node FROM (SELECT host, node, segment, sum(pages) AS pages FROM one GROUP BY ALL)
  GROUP BY host, node HAVING count(*) >= {LEAST_CHILDREN} AND count(*) * {CHILD_SHARE} >= sum(pages)
), parts AS (
  SELECT host, path, list(CASE WHEN v.node IS NULL THEN segment ELSE '*' END ORDER BY depth) AS p
  FROM one LEFT JOIN variable v USING (host, node) GROUP BY host, path
), firsts AS (
  SELECT *, coalesce(list_position(list_transform(p, lambda x: x <> '*' AND x <> ''), true), 0) AS f FROM parts
), found AS (
  SELECT host, path, pages, labelled, blocked, array_to_string(p, '/') AS template,
         array_to_string(list_transform(p, lambda x, i: CASE WHEN i = f THEN '+' ELSE x END), '/') AS form,
         CASE WHEN f > 0 THEN array_to_string(p[1:f - 1], '/') ELSE '-' END AS lead, CASE WHEN f > 0 THEN p[f] ELSE '' END AS branch
  FROM firsts JOIN paths USING (host, path)
), own AS (
  SELECT host, lead, branch, form, template, count(*) AS o, sum(labelled) AS n, sum(blocked) AS b FROM found GROUP BY ALL
), forms AS (SELECT host, lead, form, sum(o) AS fo, sum(n) AS fn, sum(b) AS fb FROM own GROUP BY ALL),
pool AS (
  SELECT host, lead, sum(fo)::DOUBLE AS po, sum(fn)::DOUBLE AS pn, sum(fb)::DOUBLE AS pb, (count(*) - 1)::DOUBLE AS free
  FROM forms GROUP BY ALL
), branches AS (
  SELECT host, lead, branch, sum(o)::DOUBLE AS o, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, sum(o::DOUBLE * o::DOUBLE / fo::DOUBLE) AS squares
  FROM own JOIN forms USING (host, lead, form) GROUP BY ALL
), alike AS (
  SELECT host, lead, branch, round(po / o * squares - o, 6) <= free + {ALIKE}::DOUBLE * sqrt(free)
    AND (b * pn - pb * n) * (b * pn - pb * n) * (pn + 2.0) * (pn + 2.0)
      <= {ALIKE}::DOUBLE * n * pn * pn * (pb + 1.0) * (pn - pb + 1.0) AS alike
  FROM branches JOIN pool USING (host, lead)
), both_counts AS (SELECT own.*, alike FROM own JOIN alike USING (host, lead, branch)),
merged AS (SELECT host, lead, form, sum(n) AS mn, sum(b) AS mb FROM both_counts WHERE alike GROUP BY ALL),
counted AS (
  SELECT host, template, CASE WHEN alike THEN mn ELSE n END AS n, CASE WHEN alike THEN mb ELSE b END AS b
  FROM both_counts LEFT JOIN merged USING (host, lead, form)
), bad AS (
  SELECT host, template, true AS bad FROM counted
  WHERE (b::DOUBLE + {SMOOTHING / 2}::DOUBLE) / (n::DOUBLE + {SMOOTHING}::DOUBLE) >= {REJECT}::DOUBLE
)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, template
FROM judged JOIN found USING (host, path) LEFT JOIN bad USING (host, template)"""


@register("op8_url_filter", _sql())
def op8(spark, sf_dir):
    """Every page's url judged by rules and template tree."""
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select(F.col("rec.page_id").alias("page_id"), "host", "path", "rule", "verdict", "template")
