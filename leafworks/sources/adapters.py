"""Optional adapters, none of which the rest needs: PDF pages by PyMuPDF, and readings by model services.

Neither a PDF library nor a network is part of this environment, so these are untested here."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "doc string, page int, width double, height double, text string"
LINES = "doc string, page int, height double, line_no int, x0 double, y0 double, x1 double, y1 double, text string"


def pdf_pages(files: DataFrame) -> DataFrame:
    """``PAGES`` of ``files(path, content)``; a page that can't be read has an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                with pymupdf.open(stream=content, filetype="pdf") as book:
                    for number, page in enumerate(book, 1):
                        try:
                            text = page.get_text() or ""
                        except RuntimeError:
                            text = ""
                        rows.append((path, number, page.rect.width, page.rect.height, text))
            yield pd.DataFrame(rows, columns=["doc", "page", "width", "height", "text"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def pdf_lines(files: DataFrame) -> DataFrame:
    """``LINES`` of ``files(path, content)``: text lines with their boxes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                with pymupdf.open(stream=content, filetype="pdf") as book:
                    for number, page in enumerate(book, 1):
                        found = (ln for b in page.get_text("dict")["blocks"] if b.get("type") == 0 for ln in b["lines"])
                        for k, ln in enumerate(found):
                            if (text := "".join(s["text"] for s in ln["spans"])).strip():
                                rows.append((path, number, page.rect.height, k, *ln["bbox"], text))
            yield pd.DataFrame(rows, columns=["doc", "page", "height", "line_no", "x0", "y0", "x1", "y1", "text"])

    return files.select("path", "content").mapInPandas(run, LINES)


def endpoint(role: str, prefix: str = "LEAFWORKS") -> dict[str, str] | None:
    """A provider's settings from the environment: the role's own, else the general ones, else none."""
    name = "".join(c if c.isalnum() else "_" for c in role.upper())
    for stem in (f"{prefix}_{name}", prefix):
        if url := os.environ.get(f"{stem}_BASE_URL"):
            return {"url": url, "model": os.environ.get(f"{stem}_MODEL", ""), "key": os.environ.get(f"{stem}_API_KEY", "")}
    return None


def readings(images: DataFrame, name: str, read: Callable[[bytes], str | None]) -> DataFrame:
    """``images(doc, page, png)`` with a column ``name`` of what ``read`` makes of them; a failure is null.

    Filter to the pages that need a reading first: predicates aren't pushed through Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(png: bytes) -> str | None:
            for _ in range(2):
                try:
                    return read(bytes(png))
                except OSError:
                    continue
            return None

        for batch in batches:
            yield batch[["doc", "page"]].assign(**{name: [safe(x) for x in batch.png]})

    return images.select("doc", "page", "png").mapInPandas(run, f"doc string, page int, {name} string")
