"""From recorded replies to a document's register: two extraction plans and the choice between them.

The order of the steps is part of the result. The main steps are written as stage tables, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import captable, drafts, layout, reconcile
from ..operators.trace import trace
from ..sources.readers import model_rows
from .stages import written

PAGE = ["doc_id", "page_num"]
#: What a row is known by from its reply or OCR line to the register.
ROW = [*PAGE, "source", "row_index"]
#: The page plan's stages, by what each has done.
STAGES = ("read", "validated", "picked", "inserted", "typed", "divided", "summed", "forms", "repeated", "document", "filled", "deduplicated")


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("int"))


def by_pages(words: DataFrame, replies: DataFrame, page_texts: DataFrame) -> dict[str, DataFrame]:
    """OCR words and model replies (attempt 1, and 2 where it was repeated), page by page.

    Keys: ocr, first, deficits, page_rows (before form and repeated pages go), accepted, shareholders; and of STAGES, each stage's rows with
    their identity (ROW).
    """
    words = written(layout.marked_words(words))  # the one pass over the words as they come
    ocr, totals = written(layout.rows_from_marked(words)), written(layout.page_totals(words))
    made = written(model_rows(replies))
    shape = ocr.columns
    one, two = (written(reconcile.validated(made.where(t).select(*shape))) for t in ("attempt = 1", "attempt = 2"))
    pages = replies.select(*PAGE).unionByName(words.select(*PAGE)).distinct()
    lacking = reconcile.deficits(one, ocr, totals, pages)
    again = two.join(lacking.where("needs_retry").select(*PAGE), PAGE, "left_semi")
    picked = written(reconcile.pick_attempt(one, again).select(*shape))
    inserted = written(reconcile.insert_from_ocr(picked, ocr, totals))
    typed = written(reconcile.override_types(inserted, ocr))
    divided = written(reconcile.correct_face_values(typed, ocr, layout.face_values(words, ocr)))
    summed = written(reconcile.drop_aggregates(divided, totals))
    forms = written(reconcile.reject_forms(summed, ocr))
    kept = written(reconcile.drop_repeated_pages(forms))
    document = reconcile.drop_document_aggregates(_ordered(kept, "page_num", "row_index"))
    filled = captable.fill_missing_types(document, layout.text_layers(page_texts))
    final = written(reconcile.deduplicated(filled.select("doc_id", "ord", "name", "share_type", "share_count", "page_num", "source", "row_index")))
    tables = (made, one.unionByName(two), picked, inserted, typed, divided, summed, forms, kept, document, filled, final)
    out = {"ocr": ocr, "first": one, "deficits": lacking, "page_rows": summed, "accepted": kept}
    return out | dict(zip(STAGES, tables)) | {"shareholders": final.select("doc_id", "ord", "name", "share_type", "share_count")}


def page_trace(plan: dict[str, DataFrame]) -> DataFrame:
    """trace() of by_pages(): what each stage did to each row's name, type and count, and which one dropped it."""
    return trace([(s, plan[s]) for s in STAGES], ROW, ["name", "share_type", "share_count"])


def by_reading(read: DataFrame, repaired: DataFrame, page_texts: DataFrame) -> dict[str, DataFrame]:
    """Drafts read from whole documents (doc_id, text), with repaired ones where the first is incomplete.

    Keys: checked, structured, shareholders (of trusted documents only).
    """
    totals = layout.document_totals(page_texts)
    checked = written(drafts.completeness(read, totals))
    better = repaired.join(checked.where("NOT passed").select("doc_id"), "doc_id", "left_semi")
    used = better.unionByName(read.join(better.select("doc_id"), "doc_id", "left_anti"))
    rows = drafts.verified_counts(drafts.structured(used), used)
    rows = rows.withColumns({"page_num": F.lit(1), "confidence": F.lit(1.0), "raw_cells": F.array().cast("array<string>")})
    rows = written(reconcile.validated(rows))
    final = rows.join(drafts.trusted(rows, totals), "doc_id", "left_semi")
    final = written(reconcile.deduplicated(_ordered(final, "row_index").select("doc_id", "ord", "name", "share_type", "share_count")))
    return {"checked": checked, "structured": rows, "shareholders": final}


def chosen(pages: dict[str, DataFrame], reading: dict[str, DataFrame], all_pages: DataFrame) -> DataFrame:
    """The page plan's rows; the reading's where OCR found nothing and the reading has at least as many rows (and any)."""
    low = reconcile.low_confidence(all_pages, pages["ocr"])
    n = lambda d, c: d.groupBy("doc_id").agg(F.count("*").alias(c))
    other = low.join(n(reading["shareholders"], "r"), "doc_id").join(n(pages["shareholders"], "p"), "doc_id", "left").where("r >= coalesce(p, 0)").select("doc_id")
    return reading["shareholders"].join(other, "doc_id", "left_semi").unionByName(pages["shareholders"].join(other, "doc_id", "left_anti"))


def results(shareholders: DataFrame, all_documents: DataFrame) -> DataFrame:
    """doc_id, n, success of every document."""
    n = shareholders.groupBy("doc_id").agg(F.count("*").alias("n"))
    return all_documents.select("doc_id").distinct().join(n, "doc_id", "left").na.fill(0, ["n"]).withColumn("success", F.col("n") > 0)
