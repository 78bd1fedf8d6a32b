"""URL filters: listed rules first, then a tree of path templates for each host.

The tree is grown level by level on counts, not on pages. A segment becomes a wildcard ``*`` if it looks like
an identifier (it has a digit), or if its parent has more than ``BRANCHES`` different segments that are rarely
seen twice. Of the other branches of a parent, those that are statistically alike are merged into one, ``+``:
- by what lies below: the segments that follow are spread as among all siblings together, by a chi-square
  test (branches that end there, and those seen fewer than ``LEAST`` times, tell nothing);
- by their labels: a branch whose bad share differs from that of its labelled siblings by a two-proportion test
  stays apart, and so do branches that only labels could tell alike if none of them has any.
A template is rejected if its smoothed labelled purity is at least ``REJECT``: (bad + a) / (labelled + 2 a), with
a = 1 + ``UNSEEN`` x its pages without a label. The smoothing grows with those, so a few labels don't speak for
many pages; a template without labels has 0.5 and is allowed.
A path of more than ``DEPTH`` segments has its whole tail as the last one: nothing is cut off.

All of it is DataFrame work: pages are summed by host and template before any exchange, so a host with a
third of all pages is as many rows as it has templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import settle

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Levels of the tree; the last one holds all that lies deeper, as one segment.
DEPTH = 6
BRANCHES, REPEATS, LEAST = 20, 3.0, 5
REJECT, Z, UNSEEN = 0.8, 1.96, 0.1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Segments, identifiers as wildcards (an ending such as .html stays); of more than DEPTH, the tail as one."""
    ending = r"^(?=.*\d).*?(\.[a-z]{1,5})?$"
    general = lambda s: F.when(s.rlike(r"\d"), F.concat(F.lit("*"), F.regexp_extract(s, ending, 1))).otherwise(s)
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)
    tail = F.array_join(F.slice(parts, F.lit(DEPTH), F.greatest(F.size(parts) - (DEPTH - 1), F.lit(1))), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(tail))).otherwise(parts)


def _branches(tree: DataFrame, level: int) -> DataFrame:
    """``(host, template, _s, _name)``: what each segment of a level is called under its parent template."""
    by, below = ["host", "template"], F.coalesce(F.get(F.col("shape"), F.lit(level + 1)), F.lit("/"))
    sums = lambda n: F.sum(n).alias(n)
    fine = tree.groupBy(*by, "_s", below.alias("_c")).agg(sums("n"), sums("bad"), sums("labelled"))
    # wildcards and ends are what they are; the others are the branches
    fine = fine.filter(F.col("_s").isNotNull() & ~F.startswith(F.col("_s"), F.lit("*")))
    fine = settle(fine, "url-branches")
    shares = fine.groupBy(*by, "_c").agg(F.sum("n").alias("_m")).withColumnRenamed("_m", "_met")
    parent = fine.groupBy(*by).agg(
        F.count_distinct("_s").alias("kinds"), F.sum("n").alias("seen"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all"), F.count_distinct("_c").alias("freedom")
    )
    expected = F.col("_met") / F.col("seen")
    kids = (
        fine.join(shares, [*by, "_c"])
        .join(parent, by)
        .groupBy(*by, "_s", "kinds", "seen", "all_bad", "all", "freedom")
        .agg(sums("n"), sums("bad"), sums("labelled"), F.sum(F.col("n") * F.col("n") / expected).alias("_o"), F.max(F.col("_c") != "/").alias("deeper"))
    )
    # the sum of (seen - expected)^2 / expected, with expected counts that add up to n
    chi, free = F.col("_o") / F.col("n") - F.col("n"), F.col("freedom") - 1
    form = F.col("deeper") & (F.col("n") >= LEAST) & (chi <= free + Z * F.sqrt(2 * free) + 1e-9)
    rest = F.col("all") - F.col("labelled")
    pooled = F.try_divide("all_bad", "all")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("labelled")) + F.try_divide(F.lit(1), rest)))
    gap = F.abs(F.try_divide("bad", "labelled") - F.try_divide(F.col("all_bad") - F.col("bad"), rest))
    both = (F.col("labelled") > 0) & (rest > 0)
    differs = both & (error > 0) & (gap >= Z * error)
    many = (F.col("kinds") > BRANCHES) & (F.col("seen") < REPEATS * F.col("kinds"))
    alike = (F.col("kinds") > 1) & ~differs & (form | (both & ~F.col("deeper")))
    return kids.select(*by, "_s", F.when(many, F.lit("*")).when(alike, F.lit("+")).otherwise(F.col("_s")).alias("_name"))


def templates(urls: DataFrame) -> DataFrame:
    """``urls(host, shape, bad, labelled, n)`` -> settled ``(host, shape, template, score)``.

    ``shape``: segments after the syntactic step; ``template``: the segments after the statistical one;
    ``score``: smoothed share of bad among the labelled.
    """
    tree = urls.withColumn("template", F.array().cast("array<string>"))
    deepest = urls.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(deepest):  # DEPTH at most
        tree = tree.withColumn("_s", F.get(F.col("shape"), F.lit(level)))
        names = _branches(tree, level)
        same = (F.col("t.host") == F.col("k.host")) & (F.col("t.template") == F.col("k.template")) & (F.col("t._s") == F.col("k._s"))
        named = F.coalesce("k._name", "t._s")
        grown = F.when(F.col("t._s").isNull(), F.col("t.template")).otherwise(F.concat("t.template", F.array(named)))
        tree = settle(tree.alias("t").join(names.alias("k"), same, "left").select("t.host", "t.shape", "t.bad", "t.labelled", "t.n", grown.alias("template")), "url-level")
    sums = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.sum("n").alias("n"))
    weight = 1 + UNSEEN * F.greatest(F.lit(0), F.col("n") - F.col("labelled"))
    scored = sums.select("host", "template", F.when(F.col("labelled") > 0, (F.col("bad") + weight) / (F.col("labelled") + 2 * weight)).otherwise(0.5).alias("score"))
    return settle(tree.select("host", "shape", "template").join(scored, ["host", "template"]), "url-templates")


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, score)`` of every row of ``pages(page_id, url)``.

    A page that a rule fits has the rule's verdict. Others are blocked if their template is rejected.
    Labels: ``labels(url, bad)`` if given (they count as seen pages of their hosts), else the pages that the rules decide. A null url, or one without
    ``://``, has an empty host and path and a template of its own; repeated rows are judged alike, ids may
    be null; without labels everything else is allowed; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_listed"), _segments(F.col("path")).alias("shape"))
    if labels is None:
        seen = rows.select("host", "shape", (F.col("_listed") == "block").cast("long").alias("bad"), F.col("_listed").isNotNull().cast("long").alias("labelled"), F.lit(1).alias("n"))
    else:
        h, p = host_and_path(F.col("url"))
        given = labels.select(h.alias("host"), _segments(p).alias("shape"), F.col("bad").cast("long").alias("bad"), F.lit(1).alias("labelled"), F.lit(1).alias("n"))
        seen = rows.select("host", "shape", F.lit(None).cast("long").alias("bad"), F.lit(0).alias("labelled"), F.lit(1).alias("n")).unionByName(given)
    urls = settle(seen.groupBy("host", "shape").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.sum("labelled").alias("labelled"), F.sum("n").alias("n")), "url-shapes")
    found = templates(urls)
    joined = rows.alias("r").join(found.alias("f"), (F.col("r.host") == F.col("f.host")) & (F.col("r.shape") == F.col("f.shape")), "left")
    own = F.when(F.col("f.score") >= REJECT, "block").otherwise("allow")
    return joined.select(
        "r.page_id", "r.host", "r.path", "r.rule", F.coalesce("r._listed", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("f.template", "/")).alias("template"), F.col("f.score").alias("score")
    )
