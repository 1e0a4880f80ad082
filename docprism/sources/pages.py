"""Pages folded into documents: by a table function that stops reading a document at its bounds, or whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import SkipRestOfInputTableException

MAX_PAGES, MAX_CHARS = 20, 100_000


def _whole(pages: DataFrame) -> DataFrame:
    """All pages of each document, without a bound: an aggregation, as there is nothing to stop at."""
    text = F.coalesce("text", F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("page", text.alias("text"))))
    out = pages.groupBy("doc_id").agg(parts.alias("p"), F.count_if(~text.rlike(r"[^ \t\n\r\f\x0B]")).cast("int").alias("pages_without_text"))
    return out.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.size("p").alias("pages_read"), "pages_without_text", F.lit("end").alias("stopped"))


def fold_pages(pages: DataFrame, limit: int | None = MAX_CHARS, most: int | None = MAX_PAGES) -> DataFrame:
    """``doc_id, text, pages_read, pages_without_text, stopped`` of ``pages`` (``doc_id, page, text``).

    The function sees a document's pages one after the other and keeps what fits; a
    page that passes ``limit`` characters, or one beyond ``most`` pages, ends the
    document, and its other pages are not handed to it.  ``stopped`` says why:
    ``characters``, ``pages``, or ``end``.  Page texts are joined by line feeds,
    which don't count; a page of white space or null is one without text.  ``None``:
    no bound.
    """
    rows = pages.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "text")
    if limit is None and most is None:
        return _whole(rows)

    @F.udtf(returnType="doc_id bigint, text string, pages_read bigint, pages_without_text bigint, stopped string")
    class Fold:
        def __init__(self):
            self.doc, self.parts, self.left, self.blank, self.why = None, [], limit, 0, "end"

        def eval(self, row):
            if len(self.parts) == most:
                self.why = "pages"
                raise SkipRestOfInputTableException("page bound")
            text = row["text"] or ""
            self.doc = row["doc_id"]
            self.blank += not text.strip(" \t\n\r\f\v")
            self.parts.append(text[: self.left])
            if self.left is not None and len(text) > self.left:
                self.why = "characters"
                raise SkipRestOfInputTableException("character bound")
            if self.left is not None:
                self.left -= len(text)

        def terminate(self):
            if self.parts:
                yield self.doc, "\n".join(self.parts), len(self.parts), self.blank, self.why

    return Fold(rows.asTable().partitionBy("doc_id").orderBy("page"))
