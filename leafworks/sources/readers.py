"""Files as tables. Sidecars have explicit schemas, so nothing is inferred and columns are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DERIVED = ("split_pdfs", "extraction", "_references")
REGION = "struct<bbox_pt:array<double>,text:string,class:string,source:string,label:string>"
REGIONS = f"fingerprint string, dpi int, generated_at string, known_limits array<string>, pages map<string,array<{REGION}>>, skipped map<string,string>"
CHECK = "struct<status:string,method:string,rule_version:int,region_fingerprint:string,checked_at:string>"
VERDICT = f"struct<bbox_pt:array<double>,text:string,class:string,source:string,verdict:string,signals:array<string>,l3_check:{CHECK}>"
AUDIT = f"fingerprint string, pages map<string,struct<page_verdict:string,page_tier:string,verdicts:array<{VERDICT}>>>"
CACHE = "version int, entries map<string,struct<fingerprint:string,verdict:string,pdf:string,checked_at:string,reason:string>>"
DECISION = "struct<page:int,region_fingerprint:string,status:string,method:string>"


def pdf_files(spark: SparkSession, root: str, derived: tuple[str, ...] = DERIVED, content: bool = False) -> DataFrame:
    """``(path, length, modificationTime[, content])`` of the PDF files below ``root``, without derived folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    inside = F.expr("substring(path, 1, length(path))")
    for name in derived:
        found = found.filter(~inside.contains(f"/{name}/"))
    return found if content else found.drop("content")


def texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``(path, text)`` of whole files."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(log, line_no, line)``; bytes that aren't UTF-8 are replaced. A log is a small file, read whole."""
    files = texts(spark, path, "*")
    return files.select(F.col("path").alias("log"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def sidecars(spark: SparkSession, path: str, schema: str, glob: str, strict: bool = False) -> DataFrame:
    """JSON sidecars with their paths; a damaged one is a row of nulls, or with ``strict`` an error."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    reader = spark.read.schema(schema).option("multiLine", "true").option("mode", mode).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """``(path, fingerprint, page, ord, bbox, text, class, source)`` of region sidecars."""
    rows = sidecars(spark, path, REGIONS, "*.regions.json").filter("fingerprint is not null")
    pages = rows.select("path", "fingerprint", F.explode("pages").alias("page", "_r"))
    each = pages.select("path", "fingerprint", F.col("page").cast("int").alias("page"), F.posexplode("_r").alias("ord", "r"))
    b = F.col("r.bbox_pt")
    box = F.struct(*[b[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return each.select("path", "fingerprint", "page", "ord", box.alias("bbox"), "r.text", "r.class", "r.source", "r.label")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, fingerprint, page, ord, ...)`` of audit sidecars."""
    rows = sidecars(spark, path, AUDIT, "*.faudit.json").filter("fingerprint is not null")
    pages = rows.select("path", "fingerprint", F.explode("pages").alias("page", "p"))
    each = pages.select("path", "fingerprint", F.col("page").cast("int").alias("page"), "p.page_verdict", F.posexplode_outer("p.verdicts").alias("ord", "v"))
    return each.select("path", "fingerprint", "page", "page_verdict", "ord", "v.*")


def check_cache(spark: SparkSession, path: str) -> DataFrame:
    """``(path, fingerprint, verdict, pdf, checked_at, reason)``; a damaged cache is an error."""
    return sidecars(spark, path, CACHE, "*.json", strict=True).select(F.explode("entries").alias("path", "e")).select("path", "e.*")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions from a list, or from an object with ``checks``; anything else is an error."""
    raw = texts(spark, path, "*").select("text")
    as_list = F.from_json("text", f"array<{DECISION}>")
    as_object = F.from_json("text", f"struct<checks:array<{DECISION}>>")["checks"]
    rows = F.when(F.ltrim("text").startswith("["), as_list).otherwise(as_object)
    return raw.select(F.posexplode(F.coalesce(rows, F.raise_error(F.lit("not a list of decisions")).cast(f"array<{DECISION}>"))).alias("seq", "c")).select("seq", "c.*")
