"""URL verdicts: explicit rules first, then a path-template tree per host, with DataFrame functions only.

1. Templates: a path's segments are generalised (digit runs to #, long mixed ids to *); a position of a host at which most pages
   have a segment of their own becomes * too. Templates are counted per host with the pages that a rule labels.
2. Tree: every prefix of a template is a node with the labelled counts below it. A branch whose share of blocked pages is not
   statistically different from its parent's is merged into the parent; a branch that differs stands alone. A branch without
   any labelled page is merged with siblings of its shape: the labelled siblings, pooled by whether they are rejected, form at
   most two profiles (pages by number and kind of the segments below); of those that a two-sample chi-square test at ``z_shape``
   does not tell from the branch's, it joins the nearest (equally near: the one not rejected) and gets that pool's labels. It
   stands alone, without labels, if its shape is another one or it has fewer than ``branch_least`` pages, too few to test.
3. A node is rejected if its smoothed purity (blocked + 1) / (labelled + 2) reaches ``purity``. Pages without a rule get their
   node's verdict: block if rejected, else allow.

Everything after the templates works on counts per template, summed before the shuffle, so one host with a third of all
pages costs one row a template.

Defined cases: a null url and one without :// have an empty host and path and are judged like any other. Repeated rows
each count and each get a row. An empty table gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def static_segments(path: Column) -> Column:
    """Non-empty segments, digit runs as #, ids of 16 and more characters with digits as *."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.when((F.length(s) >= 16) & s.rlike("[0-9]"), F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))


def adopted(walked: DataFrame, nodes: DataFrame, purity: float, branch_least: int, z_shape: float) -> DataFrame:
    """(host, branch, depth, like_lab, like_blk): labels of the sibling pool that an unlabelled branch is merged with."""
    group = ["host", "depth", "parent"]
    kin = nodes.where("depth > 0").withColumn("bad", F.when(F.col("lab") > 0, (F.col("blk") + 1) / (F.col("lab") + 2) >= purity))
    cells = walked.where("depth > 0").groupBy(*group, "node", "cell").agg(F.sum("n").alias("a"))
    cells = cells.join(kin.select(*group, "node", "bad", F.col("n").alias("in_branch")), [*group, "node"])
    pools = cells.where("bad is not null").groupBy(*group, "bad", "cell").agg(F.sum("a").alias("b"))
    totals = pools.groupBy(*group, "bad").agg(F.sum("b").alias("in_pool"), F.count("*").alias("pool_cells"))
    labels = kin.where("bad is not null").groupBy(*group, "bad").agg(F.sum("lab").alias("like_lab"), F.sum("blk").alias("like_blk"))
    totals = totals.join(labels, [*group, "bad"])
    mine = cells.where((F.col("bad").isNull()) & (F.col("in_branch") >= branch_least)).drop("bad")
    branches = mine.groupBy(*group, "node", "in_branch").agg(F.count("*").alias("own_cells")).join(totals, group)  # at most two pools a branch
    n, m = F.col("in_branch").cast("double"), F.col("in_pool").cast("double")
    met = mine.join(pools, [*group, "cell"]).join(totals.select(*group, "bad", "in_pool"), [*group, "bad"])
    apart = (m * F.col("a") - n * F.col("b")) * (m * F.col("a") - n * F.col("b")) / (F.col("a") + F.col("b"))
    met = met.groupBy(*group, "node", "bad").agg(F.sum(apart).alias("s"), F.count("*").alias("both"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    tested = branches.join(met, [*group, "node", "bad"], "left").na.fill(0, ["s", "both", "sa", "sb"])
    # cells of one side only add n * b / m or m * a / n
    tested = tested.withColumn("far", F.round((F.col("s") + n * n * (m - F.col("sb")) + m * m * (n - F.col("sa"))) / (n * m), 9))
    free = F.col("own_cells") + F.col("pool_cells") - F.col("both") - 1
    root = 1 - 2 / (9 * free) + z_shape * F.sqrt(2 / (9 * free))
    like = tested.where(F.when(free > 0, F.col("far") <= free * root * root * root).otherwise(F.col("far") == 0))
    nearest = like.groupBy("host", F.col("node").alias("branch"), "depth").agg(F.min_by(F.struct("like_lab", "like_blk"), F.struct("far", "bad")).alias("best"))
    return nearest.select("host", "branch", "depth", "best.*")


def judged(pages: DataFrame, rules=RULES, purity: float = 0.8, z: float = 1.96, distinct_least: int = 20, branch_least: int = 5, z_shape: float = 1.645) -> DataFrame:
    """(page_id, url, ...) -> (page_id, host, path, rule, verdict)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("seg", static_segments(F.col("path")))
    label = [
        F.count("*").alias("n"),
        F.count("ruled").alias("labelled"),
        F.coalesce(F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)), F.lit(0)).alias("blocked"),
    ]
    shapes = common.scratch(urls.groupBy("host", "seg").agg(*label), "url-shapes")

    # positions of a host (among paths of as many segments) at which pages mostly have segments of their own
    cells = shapes.select("host", F.size("seg").alias("len"), "n", F.posexplode("seg").alias("pos", "value"))
    values = cells.groupBy("host", "len", "pos", "value").agg(F.sum("n").alias("n"))
    spread = values.groupBy("host", "len", "pos").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where(f"d >= {distinct_least} and 2 * d >= n")
    variable = spread.groupBy("host", "len").agg(F.collect_set("pos").alias("at")).withColumnsRenamed({"host": "_host", "len": "_len"})
    generalised = F.transform("seg", lambda s, i: F.when(F.array_contains(F.coalesce("at", F.array().cast("array<int>")), i), F.lit("*")).otherwise(s))
    shaped = shapes.join(variable, (F.col("host") == F.col("_host")) & (F.size("seg") == F.col("_len")), "left")
    shaped = common.scratch(shaped.select("host", "seg", generalised.alias("t"), "n", "labelled", "blocked"), "url-templates")

    # the tree: all prefixes of the templates, with counts of the pages below
    prefix = lambda i: F.array_join(F.slice("t", 1, i), "/")
    kind = lambda s: F.when(s == "*", "*").when(F.contains(s, F.lit("#")), "#").otherwise("a")
    below = lambda i: F.array_join(F.transform(F.slice("t", i + 1, F.size("t") - i), kind), "/")
    step = lambda i: F.struct(i.alias("depth"), prefix(i).alias("node"), F.when(i > 0, prefix(i - 1)).alias("parent"), below(i).alias("cell"))
    steps = F.transform(F.sequence(F.lit(0), F.size("t")), step)
    templates = shaped.groupBy("host", "t").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    walked = templates.select("host", "t", "n", "labelled", "blocked", F.explode(steps).alias("s")).select("host", "t", "n", "labelled", "blocked", "s.*")
    nodes = walked.groupBy("host", "depth", "node", "parent").agg(F.sum("n").alias("n"), F.sum("labelled").alias("lab"), F.sum("blocked").alias("blk"))
    parents = nodes.select(F.col("host").alias("ph"), (F.col("depth") + 1).alias("pd"), F.col("node").alias("pn"), F.col("lab").alias("plab"), F.col("blk").alias("pblk"))
    p = (F.col("pblk") + 1) / (F.col("plab") + 2)
    apart = F.abs(F.col("blk") / F.nullif(F.col("lab"), F.lit(0)) - p) > z * F.sqrt(p * (1 - p) / F.nullif(F.col("lab"), F.lit(0)))
    stands = F.col("plab").isNull() | ((F.col("lab") == 0) & (F.col("plab") > 0)) | F.coalesce(apart, F.lit(False))
    anchors = nodes.join(parents, (F.col("host") == F.col("ph")) & (F.col("depth") == F.col("pd")) & (F.col("parent") == F.col("pn")), "left").where(stands)
    anchors = anchors.select(F.col("host").alias("ah"), F.col("depth").alias("ad"), F.col("node").alias("an"))
    own = walked.join(anchors, (F.col("host") == F.col("ah")) & (F.col("depth") == F.col("ad")) & (F.col("node") == F.col("an")))
    placed = own.groupBy("host", "t").agg(F.max_by("node", "depth").alias("branch"), F.max("depth").alias("depth"), F.first("labelled").alias("labelled"), F.first("blocked").alias("blocked"))
    pooled = placed.groupBy("host", "branch", "depth").agg(F.sum("labelled").alias("lab"), F.sum("blocked").alias("blk"))
    pooled = pooled.join(adopted(walked, nodes, purity, branch_least, z_shape), ["host", "branch", "depth"], "left")
    pooled = pooled.select("host", "branch", "depth", F.coalesce("like_lab", "lab").alias("lab"), F.coalesce("like_blk", "blk").alias("blk"))
    bad = pooled.where((F.col("blk") + 1) / (F.col("lab") + 2) >= purity).select("host", "branch", "depth")
    bad_templates = placed.join(bad, ["host", "branch", "depth"], "left_semi").select("host", "t")
    rejected = shaped.join(bad_templates, ["host", "t"], "left_semi").select(F.col("host").alias("_host"), F.col("seg").alias("_seg")).withColumn("rejected", F.lit(True))

    met = urls.join(rejected, (F.col("host") == F.col("_host")) & (F.col("seg") == F.col("_seg")), "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
