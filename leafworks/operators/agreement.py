"""Agreement of a page's text with a second, independent reading, and what follows for sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafworks.functions import text as X
from leafworks.functions.once import once

TRUSTED, SUSPECT, WHOLE_PAGE, LEAST = 0.85, 0.60, 0.60, 24
PROSE, FLOOR_CHARS, FLOOR_SCORE = 0.75, 20, 0.70
SECTION, SECONDS, GATE_SECONDS = 0.30, 30, 2700
SAMPLE, LEAST_TRUSTED = 20, 10
COVER, INVISIBLE, OVERLAY = 0.9, 0.5, 30
#: So many characters at most are looked for one by one.
FEW = 64


def verdict(score: Column) -> Column:
    return F.when(score >= TRUSTED, "trusted").when(score <= SUSPECT, "suspect").otherwise("ambiguous")


def compare(pages: DataFrame, layer: str, reference: str, ranges=None, least: int = LEAST) -> DataFrame:
    """``pages`` with layer_chars, agreement, bigram_agreement and agreement_verdict.

    ``ranges``: the characters that are compared (the CJK skeleton unless given). A page with fewer than
    ``least`` of them, or whose second reading is empty, can't be judged.
    """
    ranges = tuple(ranges) if ranges else None
    part = lambda c: X.skeleton(F.col(c), ranges) if ranges else X.skeleton(F.col(c))
    out = once(pages, _l=part(layer), _r=part(reference))
    few = ranges and sum(b - a + 1 for a, b in ranges) <= FEW
    one = X.share(X.present(F.col("_l"), ranges), X.present(F.col("_r"), ranges)) if few else X.containment(F.col("_l"), F.col("_r"), 1)
    two = X.containment(F.col("_l"), F.col("_r"), 2)
    out = once(out, layer_chars=F.char_length("_l"), agreement=one).withColumn("bigram_agreement", two)
    dull = (F.col("layer_chars") < least) | (X.strip(F.coalesce(F.col(reference), F.lit(""))) == "")
    return out.withColumn("agreement_verdict", F.when(dull, "n/a").otherwise(verdict(F.col("agreement")))).drop("_l", "_r")


def bucket(score: Column) -> Column:
    """The histogram's bucket by binary floor division, ``0.85+``; the last one is ``0.95+``."""
    # a // 0.05 in doubles is floor((a - fmod(a, 0.05)) / 0.05), rounded
    steps = F.round((score - score % 0.05) / 0.05)
    return F.format_string("%.2f+", F.least(F.lit(0.95), steps * 0.05))


def histogram(judged: DataFrame, *by: str) -> DataFrame:
    return judged.filter(F.col("agreement_verdict") != "n/a").groupBy(*by, bucket(F.col("agreement")).alias("bucket")).agg(F.count("*").alias("pages"))


def corruption(judged: DataFrame, by: str, column: str = "verdict") -> DataFrame:
    """Verdict counts and the suspect share of all pages, those that can't be judged included."""
    count = lambda v: F.count_if(F.col(column) == v)
    return judged.groupBy(by).agg(
        F.count("*").alias("pages"),
        count("trusted").alias("trusted"),
        count("suspect").alias("suspect"),
        count("n/a").alias("unjudged"),
        F.round(count("suspect") / F.greatest(F.count("*"), F.lit(1)), 4).alias("corruption_rate"),
    )


def arbitrate(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Verdict of a page from its prose blocks ``(role, chars, score)``: the mean of primary scores weighted
    by characters, and a floor for each large block; null verdict where no primary block has characters."""
    primary = (F.col("role") == "primary") & (F.col("chars") > 0)
    weight = F.sum(F.when(primary, F.col("chars")))
    # decimals, since sums of doubles depend on their order
    exact = F.sum(F.when(primary, F.col("chars").cast("decimal(12,0)") * F.col("score").cast("decimal(12,9)")))
    mean = F.round(exact / weight.cast("decimal(22,0)"), 4).cast("double")
    floor = F.coalesce(F.bool_or((F.col("role") == "primary") & (F.col("chars") >= FLOOR_CHARS) & (F.col("score") < FLOOR_SCORE)), F.lit(False))
    zero = F.coalesce(F.sum(F.when((F.col("role") == "secondary") & (F.col("score") < 0.3), F.col("chars"))), F.lit(0))
    return blocks.groupBy(*by).agg(
        mean.alias("arbiter_score"), floor.alias("below_floor"), zero.alias("secondary_zero_chars"), F.when(weight.isNull(), None).when((mean < PROSE) | floor, "suspect").otherwise("trusted").alias("verdict")
    )


def settle_verdicts(judged: DataFrame, arbitrated: DataFrame, keys: list[str], cap: int | None = 250, whole: str | None = None) -> DataFrame:
    """``judged`` with its final ``verdict`` and ``mode``: ambiguous pages take the arbiter's, up to ``cap`` of
    them in page order in each document (all if it is None); then the whole-page score; the others are suspect."""
    ambiguous = F.col("agreement_verdict") == "ambiguous"
    # only ambiguous pages are numbered, so the window sees a document's few
    waiting = judged.filter(ambiguous).withColumn("_nth", F.lit(0) if cap is None else F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])))
    joined = waiting.join(arbitrated.select(*keys, F.col("verdict").alias("_v")), keys, "left")
    late = F.when(F.col(whole) >= WHOLE_PAGE, "trusted").when(F.col(whole).isNotNull(), "suspect") if whole else F.lit(None).cast("string")
    over = F.lit(False) if cap is None else F.col("_nth") > cap
    final = F.when(~over, F.coalesce("_v", late))
    mode = F.when(over, "cap").when(F.col("_v").isNotNull(), "prose_crop").when(late.isNotNull(), "whole_page").otherwise("arbiter-unavailable")
    decided = joined.withColumns({"verdict": F.coalesce(final, F.lit("suspect")), "mode": mode}).drop("_nth", "_v")
    others = judged.filter(~ambiguous).withColumns({"verdict": F.col("agreement_verdict"), "mode": F.lit("direct")})
    return others.unionByName(decided)


def sections(mapped: DataFrame, audited: DataFrame, doc: str = "doc") -> DataFrame:
    """Sections ``(doc, title, path, pages)`` with what is known of their pages ``(doc, page, verdict)``.

    Pages that weren't audited count for nothing. ``auto_repair``: the suspect share reaches 0.30.
    """
    pages = mapped.select(doc, "title", "path", F.explode_outer("pages").alias("page"))
    joined = pages.join(audited.select(doc, "page", "verdict"), [doc, "page"], "left")
    sus = F.col("verdict") == "suspect"
    out = joined.groupBy(doc, "title", "path").agg(
        F.count("verdict").alias("audited"),
        F.array_sort(F.collect_list(F.when(sus, F.col("page")))).alias("suspect_pages"),
        F.coalesce(F.bool_or(F.col("verdict") == "n/a"), F.lit(False)).alias("unjudgeable"),
    )
    ratio = F.when(F.col("audited") > 0, F.size("suspect_pages") / F.col("audited")).otherwise(0.0)
    return out.withColumns({"suspect_ratio": F.round(ratio, 3), "auto_repair": (F.col("audited") > 0) & (ratio >= SECTION)})


def repair_plan(found: DataFrame, by: str = "doc") -> DataFrame:
    """Pages and seconds of repair, and whether that needs consent."""
    pages = F.sum(F.size("suspect_pages"))
    return found.filter("auto_repair").groupBy(by).agg(
        F.count("*").alias("sections"), pages.alias("repair_pages"), (pages * SECONDS).alias("estimate_s"), (pages * SECONDS > GATE_SECONDS).alias("needs_consent")
    )


def sample(pages: DataFrame, doc: str = "doc", page: str = "page", n: int = SAMPLE, salt: str = "") -> DataFrame:
    """A stable sample of ``n`` pages of each document, by hash order."""
    order = F.md5(F.concat_ws(":", F.lit(salt), F.col(doc), F.col(page)))
    return pages.withColumn("_nth", F.row_number().over(Window.partitionBy(doc).orderBy(order, page))).filter(F.col("_nth") <= n).drop("_nth")


def digital_gate(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Whether no trusted page ``(doc, page, tier, coverage, chars, invisible)`` looks scanned or overlaid."""
    scan = F.col("coverage") > COVER
    over = (F.col("chars") >= OVERLAY) & (F.col("invisible") / F.greatest(F.col("chars"), F.lit(1)) >= INVISIBLE)
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page"))))
    flagged = (F.col("tier") == "trusted") & (scan | over)
    return pages.groupBy(doc).agg(
        F.count("*").alias("total_pages"),
        listed(scan).alias("scan_like_pages"),
        listed(over).alias("overlay_like_pages"),
        listed(flagged).alias("trusted_scan_like_pages"),
        (~F.coalesce(F.bool_or(flagged), F.lit(False))).alias("gate_pass"),
    )


def pending(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without a finished result; pages still in arbitration are not finished."""
    return targets.join(done.filter(F.col("verdict") != "arbitrating").select(*keys), keys, "left_anti")


def completed(done: DataFrame, by: str = "doc") -> DataFrame:
    return done.groupBy(by).agg(F.count_if(F.col("verdict") != "arbitrating").alias("completed"))
