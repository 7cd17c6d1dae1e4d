"""URL filtering: a rule list first, then a tree of path templates per host.

Rules. ``host/path`` fits its host and all subdomains where the path starts with the rule's; the longest
rule that fits decides. Urls that rules decide are the labelled ones (or give labels).

Tree. The path's segments are generalised in two ways, from the root down, one level at a time.
Digits become ``#``. Then, among the urls of one node that have a further segment, a segment value stays a branch of
its own only if it is supported (at least ``least`` labelled urls, whatever the node's size) and its labels differ from
those urls': the squared distance of the two purities is over ``z`` squared times the variance of
a purity of that many labels. All other branches are alike as far as can be told, and merge into ``*``.
Levels go on until no node has a further segment. A node whose further urls have fewer than ``least`` labels, or
labels of one kind only, can have no branch of its own: what lies below it is wildcards, without further levels.
A template ends with its last own branch: wildcards behind it stand for any rest, none included.

Verdict. A template's purity is smoothed towards its host's, and that towards that of all labelled urls, with
``weight`` labels each; below ``limit`` the template is rejected. Without labels everything is allowed.

The host stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; the
path goes on to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and path and
are judged as one host. Trees grow on distinct shapes with counts, so repeated urls cost nothing
there. Minima and decisions are written before they are joined, so joins read plain tables
whose hot keys adaptive execution splits. DataFrame operations only.
"""

from __future__ import annotations

from itertools import count as count_up

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.store import drop, stage

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
LEAST, Z, WEIGHT, LIMIT = 5, 2.0, 10.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else null."""
    name = action = None
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        action = F.when(fits, what) if action is None else action.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def shape(path: Column) -> Column:
    """The path without its first slash, digits masked."""
    return F.regexp_replace(F.substring(path, 2, 2**31 - 1), "[0-9]+", "#")


def templates_of(shapes: DataFrame, *, least=LEAST, z=Z) -> DataFrame:
    """(host, shape, template, labelled, good) for shapes (host, shape, labelled, good) of distinct host and shape."""
    segments = F.split("shape", "/", -1)
    node = shapes.select("host", "shape", "labelled", "good", F.lit("").alias("template"), F.size(segments).alias("size"))
    at, done = ["host", "template"], []
    columns = ["host", "shape", "template", "labelled", "good", "size"]
    for level in count_up():
        node = node.withColumn("part", F.get(segments, F.lit(level)))
        branches = stage(node.groupBy(*at, "part").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")), "branches")
        mixed = (F.col("pl") >= least) & (F.col("pg") > 0) & (F.col("pg") < F.col("pl"))
        parents = stage(branches.groupBy(*at).agg(F.sum("labelled").alias("pl"), F.sum("good").alias("pg")).where(mixed), "parents")
        if parents.isEmpty():
            done.append(node.select(*columns))
            drop(branches, parents)
            break
        own, all_ = F.col("good") / F.col("labelled"), F.col("pg") / F.col("pl")
        differs = (own - all_) * (own - all_) * F.col("labelled") > z * z * all_ * (1 - all_)
        chosen = stage(
            branches.join(parents, at).where((F.col("labelled") >= least) & differs).select(*at, "part", F.lit(True).alias("stays")), "chosen"
        )
        settled = node.join(parents, at, "left_anti")
        onward = node.join(parents, at, "left_semi").join(chosen, [*at, "part"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("stays"), F.col("part")).otherwise("*"))
        after = stage(
            settled.select(*columns, F.lit(True).alias("ends")).union(
                onward.withColumn("template", step).select(*columns, (F.col("size") == level + 1).alias("ends"))
            ),
            "node",
        )
        drop(branches, parents, chosen)
        done.append(after.where("ends").select(*columns))
        node = after.where("not ends").select(*columns)
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.select("host", "shape", F.regexp_replace("template", r"(/\*)+$", "").alias("template"), "labelled", "good")


def verdicts(shapes: DataFrame, *, least=LEAST, z=Z, weight=WEIGHT, limit=LIMIT) -> DataFrame:
    """(host, shape, template, verdict) for shapes (host, shape, labelled, good) of distinct host and shape."""
    sums = [F.sum(c).alias(c) for c in ("labelled", "good")]
    node = templates_of(shapes, least=least, z=z)
    every = node.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).first()
    labelled, good = every["l"] or 0, every["g"] or 0
    if not labelled:
        return node.select("host", "shape", "template", F.lit("allow").alias("verdict"))
    prior = good / labelled
    templates = stage(node.groupBy("host", "template").agg(*sums), "templates")
    hosts = stage(templates.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("good").alias("hg")), "hosts")
    base = (F.col("hg") + weight * prior) / (F.col("hl") + weight)
    purity = (F.col("good") + weight * base) / (F.col("labelled") + weight)
    judged = stage(
        templates.join(hosts, "host").select("host", "template", F.when(purity < limit, "block").otherwise("allow").alias("verdict")), "judged"
    )
    return node.select("host", "shape", "template").join(judged, ["host", "template"])


def judge(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, labels: DataFrame | None = None, **options
) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row. ``labels`` (page_id, good) replace the rules' own
    verdicts as what purity is measured on; other columns are not read."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"), shape(F.col("path")).alias("shape"))
    if labels is None:
        marked = rows.withColumn("good", (F.col("action") == "allow").cast("int"))
    else:
        known = labels.select(F.col("page_id").alias("known_id"), F.col("good").cast("int").alias("good"))
        marked = rows.join(known, F.col("page_id") == F.col("known_id"), "left")
    shapes = stage(
        marked.groupBy("host", "shape").agg(
            F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("good")
        ),
        "shapes",
    )
    decided = stage(verdicts(shapes, **options), "verdicts")
    return rows.join(decided, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "verdict").alias("verdict"), "template"
    )


def sql(rules=RULES, least=LEAST, z=Z, weight=WEIGHT, limit=LIMIT) -> str:
    """The same in DuckDB SQL over ``pages``, without the template; every level is one step of a recursion."""
    fits = [
        (what, rule, "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}{2}')".format(*rule.partition("/")))
        for what, rule in sorted(rules, key=lambda r: -len(r[1]))
    ]
    case = lambda pick: "CASE " + " ".join(f"WHEN {c} THEN '{pick(w, r)}'" for w, r, c in fits) + " END"
    rule, action = (case(lambda w, r: r), case(lambda w, r: w)) if fits else ("CAST(NULL AS VARCHAR)",) * 2
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH RECURSIVE split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
rows_ AS (SELECT *, {rule} AS rule, {action} AS action, regexp_replace(path[2:], '[0-9]+', '#', 'g') AS shape FROM split),
t AS (
  SELECT 0 AS level, host, shape, string_split(shape, '/') AS parts, '' AS template,
    CAST(count(action) AS DOUBLE) AS labelled, CAST(count(CASE WHEN action = 'allow' THEN 1 END) AS DOUBLE) AS good
  FROM rows_ GROUP BY host, shape
  UNION ALL
  SELECT level + 1, host, shape, parts, template || '/' || CASE WHEN bl >= {least}
      AND (bg / bl - pg / pl) * (bg / bl - pg / pl) * bl > {z * z} * (pg / pl) * (1 - pg / pl) THEN parts[level + 1] ELSE '*' END,
    labelled, good
  FROM (
    SELECT *, sum(labelled) OVER n AS pl, sum(good) OVER n AS pg, sum(labelled) OVER b AS bl, sum(good) OVER b AS bg
    FROM t WHERE level < len(parts)
    WINDOW n AS (PARTITION BY host, template), b AS (PARTITION BY host, template, parts[level + 1]))),
whole AS (SELECT host, shape, regexp_replace(template, '(/\\*)+$', '') AS template, labelled, good FROM t WHERE level = len(parts)),
top AS (SELECT sum(good) / sum(labelled) AS prior FROM whole),
e AS (SELECT host, template, sum(labelled) AS labelled, sum(good) AS good FROM whole GROUP BY ALL),
h AS (SELECT host, sum(labelled) AS hl, sum(good) AS hg FROM e GROUP BY ALL),
judged AS (SELECT e.host, template, CASE WHEN (good + {weight} * ((hg + {weight} * prior) / (hl + {weight}))) / (labelled + {weight}) < {limit}
    THEN 'block' ELSE 'allow' END AS verdict
  FROM e JOIN h ON e.host = h.host, top)
SELECT page_id, r.host, path, rule, coalesce(action, verdict) AS verdict
FROM rows_ r JOIN whole t ON r.host = t.host AND r.shape = t.shape JOIN judged j ON t.host = j.host AND t.template = j.template
"""
