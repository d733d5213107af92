"""URL filter by a tree of path templates.

A page that a rule fits has the rule's verdict; these pages are the labelled ones.  From all pages a tree is grown for each
host, level by level.  Below a branch, a path segment stays literal if it is frequent there (`LEAST_PAGES` pages and
`LEAST_SHARE` of the branch's); all others are variable and become one wildcard.  Literal
siblings whose shares of blocked pages do not differ significantly are merged to one branch (`{de|en}`), in order
of that share; those without labelled pages are merged together.  The tree grows while a branch has `LEAST_PAGES` pages that go
deeper; a template is a path from the root to an end, and what lies deeper than that is its tail, `**`.  A template is rejected if its purity, the share of blocked pages among its labelled
ones smoothed towards `PRIOR`, reaches `PURITY`.

Pages are grouped to distinct (host, path) with counts first; each level joins its literals, at most 1 / LEAST_SHARE for
a branch, to the remaining paths, and is written to the shared folder.  Nothing is gathered by host.

Rows: one result per input row.  A null url, or one without `://`, has empty host and path, which have the empty
template.  Repeated rows count as pages each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sangloc.llm.common import removed, staged
from sangloc.operators.joins import dim_join, skew_join

ALLOW, BLOCK = "allow", "block"
LEAST_PAGES, LEAST_SHARE = 5, 0.02
#: Siblings are merged unless their shares differ by this many standard errors.
DIFFERENT = 1.96
#: Weight, in pages, and value of what is assumed before any labelled page is seen.
PRIOR_PAGES, PRIOR = 4.0, 0.1
PURITY = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(size, verdict, rule) of the longest rule that fits, or null; of equally long ones a blocking one."""
    found = [
        F.when(
            ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for h, p, verdict in rules
    ]
    nothing = F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    return F.greatest(nothing, nothing, *found)


def _level(paths: DataFrame, level: int) -> DataFrame:
    """The paths with the branch of this level added to their template."""
    open_ = F.size("segments") > level
    name = F.get("segments", F.lit(level))
    rows = paths.where(open_).select("host", "template", name.alias("name"), "n", "labelled", "blocked")
    children = rows.groupBy("host", "template", "name").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    parents = children.groupBy("host", "template").agg(F.sum("n").alias("all"))
    frequent = children.where(F.col("n") >= LEAST_PAGES).join(parents, ["host", "template"])
    literals = frequent.where(F.col("n") >= LEAST_SHARE * F.col("all")).drop("all")
    # At most 1 / LEAST_SHARE rows in a window.
    siblings = Window.partitionBy("host", "template").orderBy(F.col("labelled") > 0, "share", "name")
    literals = literals.withColumn("share", (F.col("blocked") + 0.5) / (F.col("labelled") + 1))
    before = {c: F.lag(c).over(siblings) for c in ("labelled", "blocked")}
    pooled = (F.col("blocked") + before["blocked"] + 0.5) / (F.col("labelled") + before["labelled"] + 1)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / before["labelled"]))
    apart = F.abs(F.col("blocked") / F.col("labelled") - before["blocked"] / before["labelled"]) > DIFFERENT * error
    new = F.when(before["labelled"].isNull(), True).when(F.col("labelled") == 0, False).when(before["labelled"] == 0, True).otherwise(apart)
    literals = literals.withColumn("branch", F.sum(new.cast("int")).over(siblings))
    merged = literals.groupBy("host", "template", "branch").agg(F.sort_array(F.collect_list("name")).alias("names"))
    label = F.when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")))
    branches = merged.select("host", "template", F.explode("names").alias("name"), label.alias("label"))
    branches = staged(branches, "branches")
    named = dim_join(paths.withColumn("name", F.coalesce(name, F.lit(""))), branches, ["host", "template", "name"])
    longer = F.concat("template", F.lit("/"), F.coalesce("label", F.lit("*")))
    out = named.withColumn("template", F.when(open_, longer).otherwise(F.col("template")))
    out = staged(out.select(*paths.columns), "templates")
    removed(branches)
    return out


def _branches(paths: DataFrame, level: int) -> bool:
    """Whether a template has LEAST_PAGES pages that go deeper than this level."""
    deeper = paths.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("n"))
    return not deeper.where(F.col("n") >= LEAST_PAGES).isEmpty()


def templates(labelled: DataFrame) -> DataFrame:
    """(host, path, n, template) from (host, path, label 1 or 0 or null); a staged table."""
    counts = labelled.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked")
    )
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = staged(counts.select("*", segments.alias("segments"), F.lit("").alias("template")), "templates")
    # The tree goes on while any branch still has pages to tell apart.
    level = 0
    while _branches(paths, level):
        deeper = _level(paths, level)
        removed(paths)
        paths, level = deeper, level + 1
    tail = F.when(F.size("segments") > level, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return paths.select("host", "path", "n", "labelled", "blocked", tail.alias("template"))


def purities(paths: DataFrame) -> DataFrame:
    """(host, template, purity)"""
    sums = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + PRIOR_PAGES * PRIOR) / (F.col("labelled") + PRIOR_PAGES)
    return sums.select("host", "template", purity.alias("purity"))


def judged(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("fit.verdict") == BLOCK, 1).when(F.col("fit.verdict") == ALLOW, 0)
    paths = templates(rows.select("host", "path", label.alias("label")))
    judged_paths = paths.join(purities(paths), ["host", "template"]).select("host", "path", "n", "template", "purity")
    # A path of very many pages is salted in the join.
    judged_paths = staged(judged_paths, "judged-paths")
    out = skew_join(rows, judged_paths, ["host", "path"], "n", "left") if judged_paths.limit(1).count() else None
    if out is None:
        out = rows.withColumn("template", F.lit("")).withColumn("purity", F.lit(PRIOR))
    method = F.when(F.col("purity") >= PURITY, BLOCK).otherwise(ALLOW)
    return out.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", method).alias("verdict"),
        "template",
        "purity",
    )
