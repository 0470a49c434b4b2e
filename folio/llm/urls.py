"""URL filters: rules first, then a path-template tree.

Per host, paths form a tree of segments. A segment with a number in it is a variable, and so is any literal below a node that has
too many different ones for its size; variables become the wildcard `*`. Branches of one parent whose subtrees look alike (the same
shares of kinds of leaves, within what their counts allow) and whose labelled shares do not differ beyond chance are merged. The
labels are the verdicts of the rules. A template is rejected by its smoothed purity: the share of blocked among its labelled
urls, drawn to that of its merged branches, which is drawn to its host's, and that to the share overall. Only labels reject: a
template without any of its own takes no verdict from a pool that knows but one side, however many urls that has.

Only DataFrame functions. Urls are counted by host and generalised path before anything else, so a host with a third of all pages
is as small as its tree. The tree is as deep as its paths: a round takes every node over all segments that its paths share and
one more, so there are as many rounds as a path meets branchings, and a long path of its own takes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, pinned

WIDE, SHARE = 20, 3  # a node with over 20 literals, more than a third of its urls, has a variable below it
PRIOR = 4.0         # labelled urls that each smoothing step is worth
PURITY = 0.9        # a template is rejected from this purity on
CHANCE = 2.0        # standard errors within which labelled shares are alike

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and where there is no `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host and path from its first slash on, verdict) that fits, as (size, rule, verdict); else null."""
    found = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _shape(path: Column) -> Column:
    """The segments of a path, numbers as `*`."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"[0-9a-f-]*[0-9][0-9a-f-]*", "*"))


def _joined(segments: Column) -> Column:
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise(F.lit(""))


def _along(rows: DataFrame) -> DataFrame:
    """Take every row over the segments that all unfinished paths of its node share."""
    at, size = F.col("at"), F.size("shape")
    tail = F.slice("shape", at + 1, size - at)
    ends = rows.groupBy("host", "template").agg(F.min(tail).alias("low"), F.max(tail).alias("high"))
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
    rows = rows.join(ends.select("host", "template", shared.alias("shared")), ["host", "template"])
    inner = F.filter(F.sequence(at + 1, at + F.col("shared")), lambda i: (i < size) & ~F.element_at("shape", i).contains("*"))
    rows = rows.withColumn("last", F.when(F.col("shared") > 0, F.array_max(inner)))
    parent = F.concat("template", _joined(F.slice("shape", at + 1, F.col("last") - at - 1)))
    branch = F.concat("template", _joined(F.slice("shape", at + 1, F.col("last") - at)))
    return rows.select(
        "host", "shape", "n", "labelled", "blocked", F.concat("template", _joined(F.slice("shape", at + 1, F.col("shared")))).alias("template"),
        *(F.when(F.col("last").isNotNull(), new).otherwise(F.col(old)).alias(old) for old, new in (("parent", parent), ("branch", branch))),
        (at + F.col("shared")).alias("at"))


def _down(rows: DataFrame) -> DataFrame:
    """Take every row over one segment, which is a wildcard below a wide node; rows at their end stay."""
    here = rows.withColumn("segment", F.try_element_at("shape", F.col("at") + 1))
    children = here.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(F.sum("n").alias("n"))
    wide = children.groupBy("host", "template").agg(
        ((F.count(F.lit(1)) > WIDE) & (F.count(F.lit(1)) * SHARE > F.sum("n"))).alias("wide"))
    here = here.join(wide, ["host", "template"], "left")
    name = F.when(F.col("wide") & ~F.col("segment").contains("*"), "*").otherwise(F.col("segment"))
    full = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat(F.col("template"), F.lit("/"), name))
    return here.select(
        "host", "shape", "n", "labelled", "blocked", full.alias("template"),
        # the deepest literal with something below it is the branch that may be merged with its siblings
        *(F.when((F.size("shape") > F.col("at") + 1) & ~name.contains("*"), new).otherwise(F.col(old)).alias(old)
          for old, new in (("parent", F.col("template")), ("branch", full))),
        F.least(F.col("at") + 1, F.size("shape")).alias("at"))


def _tree(counts: DataFrame) -> DataFrame:
    """The template, branch and parent of every counted shape."""
    none = F.lit("")
    rows = counts.select("*", none.alias("template"), none.alias("parent"), none.alias("branch"), F.lit(0).alias("at"))
    ended, rounds = [rows.filter(F.size("shape") == 0)], []
    rows = rows.filter(F.size("shape") > 0)
    while not rows.isEmpty():
        rounds.append(pinned(_down(_along(rows)), "url-round"))
        ended.append(rounds[-1].filter("at = size(shape)"))
        rows = rounds[-1].filter("at < size(shape)")
    tree = ended[0]
    for more in ended[1:]:
        tree = tree.unionByName(more)
    tree = pinned(tree.drop("at"), "url-tree")
    discard(*rounds)
    return tree


def _smoothed(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PRIOR * prior) / (labelled + PRIOR)


def templates(urls: DataFrame) -> DataFrame:
    """Purity of every (host, shape): host, shape, template, purity, known. Input: host, path, blocked (null: no label).

    A purity is `known` if labels of the template bear it, or those of a labelled branch (and of what was tested alike) that are of
    both kinds. Any other is a guess from its surroundings.
    """
    counts = pinned(
        urls.groupBy("host", _shape(F.col("path")).alias("shape")).agg(
            F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")), "url-shapes")
    tree = _tree(counts)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]

    # how a branch's subtree looks: the share of urls that end in a wildcard, and of those that end deeper, in quarters
    leaf = F.expr("substring(template, length(branch) + 1)")
    quarters = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) * 4 / F.sum("n")).alias
    branches = tree.groupBy("host", "parent", "branch").agg(*sums, quarters(leaf.contains("*"))("ends"), quarters(leaf.rlike("/.*/"))("deep"))
    alike = branches.groupBy("host", "parent", "ends", "deep").agg(*(F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")))
    joined = branches.join(alike, ["host", "parent", "ends", "deep"])
    pooled, own = F.try_divide("all_blocked", "all_labelled"), F.try_divide("blocked", "labelled")
    error = F.sqrt(F.try_divide(pooled * (1 - pooled), "labelled") + F.try_divide(F.lit(0.25), F.col("labelled") * F.col("labelled")))
    merges = F.coalesce(F.abs(own - pooled) <= CHANCE * error, F.lit(True))  # without labels a guess only
    merged = joined.select("host", "parent", "branch", F.col("labelled").alias("b_labelled"), F.when(merges, F.col("all_labelled")).otherwise(F.col("labelled")).alias("m_labelled"),
                           F.when(merges, F.col("all_blocked")).otherwise(F.col("blocked")).alias("m_blocked"))
    hosts = tree.groupBy("host").agg(*(F.sum(c).alias(f"h_{c}") for c in ("labelled", "blocked")))
    overall = tree.agg(F.sum("labelled").alias("o_labelled"), F.sum("blocked").alias("o_blocked")).first()
    share = F.lit((overall["o_blocked"] or 0) / max(overall["o_labelled"] or 0, 1))
    by_template = tree.groupBy("host", "parent", "branch", "template").agg(*(F.sum(c).alias(f"t_{c}") for c in ("labelled", "blocked")))
    # a host says as much as PRIOR urls at most: with many it would draw all it holds to one side
    weight = F.least(F.col("h_labelled"), F.lit(PRIOR))
    purity = _smoothed(F.coalesce(F.try_divide("h_blocked", "h_labelled"), F.lit(0)) * weight, weight, share)
    purity = _smoothed(F.col("m_blocked"), F.col("m_labelled"), purity)
    purity = _smoothed(F.col("t_blocked"), F.col("t_labelled"), purity)
    known = (F.col("t_labelled") > 0) | (F.col("b_labelled") > 0) & (F.col("m_blocked") > 0) & (F.col("m_blocked") < F.col("m_labelled"))
    rated = by_template.join(merged, ["host", "parent", "branch"]).join(hosts, "host").select("host", "parent", "branch", "template", purity.alias("purity"), known.alias("known"))
    return tree.select("host", "shape", "template", "parent", "branch").join(rated, ["host", "parent", "branch", "template"]).select("host", "shape", "template", "purity", "known")


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    The verdict is the rule's; without a rule, `block` for templates of a known purity of PURITY and more, else `allow`. Null urls, and those
    without `://`, have an empty host and path and count as one template. Repeated rows stay.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", rule_for(F.col("host"), F.col("path"), rules))
    rated = templates(rows.select("host", "path", (F.col("best.verdict") == "block").cast("int").alias("blocked")))
    return (
        rows.withColumn("shape", _shape(F.col("path"))).join(rated, ["host", "shape"])
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce(F.col("best.verdict"), F.when(F.col("known") & (F.col("purity") >= PURITY), "block").otherwise("allow")).alias("verdict"), "template", "purity")
    )
