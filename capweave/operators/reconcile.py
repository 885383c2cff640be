"""OCR rows and model rows of a page, brought together; then pages, brought to a document.

Rows (both kinds): doc_id, page_num, row_index, name, share_type, share_count, source, confidence, flags, raw_cells.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.rules import form_hits, is_aggregate_label, is_form_page, may_insert, name_has_address, usable_name
from ..functions.text import clean_name, contains_any, count_contained, known_share_type, name_prefix, no_space, parse_count
from .folds import by_key
from .relational import deficit_flags, first_of, leave_one_out, override, sorted_agreement, typed_preferred, unique_only, upper_median

PAGE = ["doc_id", "page_num"]


def count_of(c: str = "share_count"):
    return F.coalesce(F.col(c), F.lit(0))


def ocr_counts(ocr: DataFrame) -> DataFrame:
    """OCR rows with n, the count of their last cell."""
    return ocr.withColumn("n", parse_count(F.element_at("raw_cells", -1)))


def missing_details(rows: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR rows whose count no model row has."""
    known = rows.select(*PAGE, F.col("share_count").alias("n")).distinct()
    return ocr_counts(ocr).where("n IS NOT NULL").join(known, [*PAGE, "n"], "left_anti")


def deficits(rows: DataFrame, ocr: DataFrame, totals: DataFrame, pages: DataFrame) -> DataFrame:
    """By page of `pages`: sums and counts on both sides, sum_deficit, count_deficit, needs_retry."""
    clean = F.count_if(usable_name(F.element_at("raw_cells", 1)))
    r = rows.groupBy(*PAGE).agg(F.sum(count_of()).alias("total"), F.count("*").alias("n"))
    o = ocr.groupBy(*PAGE).agg(clean.alias("n_ocr"))
    out = pages.select(*PAGE).distinct().join(r, PAGE, "left").join(o, PAGE, "left").join(totals, PAGE, "left").na.fill(0, ["total", "n", "n_ocr"])
    out = deficit_flags(out, "ocr_total", "total", "n_ocr", "n", W.SUM_DEFICIT)
    return out.withColumn("needs_retry", F.col("sum_deficit") | F.col("count_deficit"))


def pick_attempt(first: DataFrame, retry: DataFrame) -> DataFrame:
    """The retry's rows of the pages where its sum or its number of rows is greater, else the first's."""
    agg = lambda d, x: d.groupBy(*PAGE).agg(F.sum(count_of()).alias(f"s{x}"), F.count("*").alias(f"k{x}"))
    better = agg(retry, 2).join(agg(first, 1), PAGE, "left").na.fill(0, ["s1", "k1"]).where("s2 > s1 OR k2 > k1").select(*PAGE)
    return retry.join(better, PAGE, "left_semi").unionByName(first.join(better, PAGE, "left_anti"))


def insert_from_ocr(rows: DataFrame, ocr: DataFrame, totals: DataFrame) -> DataFrame:
    """rows and the OCR rows that may be added: the count is unique in OCR, absent from the model, and the row is valid."""
    raw = F.element_at("raw_cells", 1)
    o = unique_only(ocr_counts(ocr).where("n > 0"), [*PAGE, "n"])
    o = o.join(rows.select(*PAGE, F.col("share_count").alias("n")).distinct(), [*PAGE, "n"], "left_anti")
    # Exploded, so that the tests on the name read it and don't each hold a copy of its expression.
    named = F.struct(name_has_address(raw).alias("trimmed"), clean_name(F.when(name_has_address(raw), name_prefix(raw)).otherwise(raw)).alias("name"))
    o = o.drop("name").select("*", F.inline(F.array(named)))
    page = rows.groupBy(*PAGE).agg(upper_median(count_of()).alias("median"), (F.max("row_index") + 1).alias("k"))
    o = o.join(page, PAGE, "left").join(totals, PAGE, "left")
    o = o.where((F.col("name") != "") & ~is_aggregate_label(F.col("name")) & may_insert(F.col("name"), F.col("n"), F.col("median"), F.col("ocr_total")))
    kind = F.when(F.size("raw_cells") == 3, known_share_type(F.element_at("raw_cells", 2))).otherwise("")
    flags = F.when(F.col("trimmed"), F.array(F.lit("count_only_match"), F.lit("address_trimmed"))).otherwise(F.array(F.lit("count_only_match")))
    place = F.coalesce("k", F.lit(0)) + F.row_number().over(Window.partitionBy(*PAGE).orderBy("row_index")) - 1
    new = o.select(*PAGE, place.cast("int").alias("row_index"), "name", kind.alias("share_type"), F.col("n").alias("share_count"), F.lit("ocr_fallback").alias("source"), F.lit(1.0).alias("confidence"), flags.alias("flags"), "raw_cells")
    return rows.select(*new.columns).unionByName(new)


def override_types(rows: DataFrame, ocr: DataFrame) -> DataFrame:
    """The OCR row's known type, where its count is unique among the page's OCR rows."""
    dim = unique_only(ocr_counts(ocr).where("n IS NOT NULL"), [*PAGE, "n"])
    dim = dim.where(F.size("raw_cells") == 3).select(*PAGE, F.col("n").alias("share_count"), known_share_type(F.element_at("raw_cells", 2)).alias("share_type"))
    return override(rows, dim, [*PAGE, "share_count"], "share_type", "type_ocr_override").select(*rows.columns)


def correct_face_values(rows: DataFrame, ocr: DataFrame, faces: DataFrame) -> DataFrame:
    """Divides a page's counts by its face value if all are multiples and OCR read the same numbers."""
    agree = sorted_agreement(ocr.where("share_count <> 0"), rows.where("share_count > 0"), PAGE, "share_count", W.FACE_AGREEMENT)
    page = Window.partitionBy(*PAGE)
    # Only pages with a face value can change.
    out = rows.join(faces.join(agree, PAGE), PAGE, "left")
    fits = F.coalesce(F.bool_and((count_of() > 0) & (F.pmod(count_of(), F.col("face_value")) == 0)).over(page) & (F.count("*").over(page) >= 2) & F.col("agree"), F.lit(False))
    out = out.withColumn("__fits", fits)
    flagged = F.when(F.col("__fits"), F.array_append("flags", F.lit("face_value_corrected"))).otherwise(F.col("flags"))
    return out.withColumns({"flags": flagged, "share_count": F.when(F.col("__fits"), F.expr("share_count div face_value")).otherwise(F.col("share_count"))}).select(*rows.columns)


def validated(rows: DataFrame) -> DataFrame:
    """Rows that stay, some with their name trimmed, and needs_review (of the page). A trimmed row's count isn't looked at."""
    name, packed = F.col("name"), no_space(F.col("name"))
    prefix = name_prefix(name)
    address = count_contained(name, W.ADDRESS_WORDS) >= 2
    verdict = (
        F.when(packed.startswith(W.CHIEF) | contains_any(packed, W.MODEL_REJECTS) | is_aggregate_label(name), "drop")
        .when(address & (F.length(prefix) >= 2), "trim")
        .when(address | (count_of() <= 0) | (count_of() > W.COUNT_LIMIT), "drop")
        .otherwise("keep")
    )
    out = rows.withColumn("__v", verdict)
    page = Window.partitionBy(*PAGE)
    out = out.withColumn("needs_review", F.bool_or(F.col("__v") != "keep").over(page)).where("__v <> 'drop'")
    trimmed = F.col("__v") == "trim"
    return out.withColumns({"name": F.when(trimmed, clean_name(prefix)).otherwise(name), "flags": F.when(trimmed, F.array_append("flags", F.lit("address_trimmed"))).otherwise(F.col("flags"))}).drop("__v")


def drop_aggregates(rows: DataFrame, totals: DataFrame) -> DataFrame:
    return leave_one_out(rows.join(totals, PAGE, "left"), PAGE, "share_count", W.AGGREGATE_TOLERANCE, total="ocr_total").drop("ocr_total")


def drop_document_aggregates(rows: DataFrame) -> DataFrame:
    return leave_one_out(rows, ["doc_id"], "share_count", W.AGGREGATE_TOLERANCE, positive=False)


def reject_forms(rows: DataFrame, ocr: DataFrame) -> DataFrame:
    """Without the pages that are tax forms; documents of one page keep theirs."""
    text = ocr.groupBy(*PAGE).agg(F.array_join(F.flatten(F.collect_list("raw_cells")), " ").alias("t"))
    page = rows.groupBy(*PAGE).agg(F.avg((F.length("name") > 15).cast("int")).alias("long"), F.avg((F.coalesce("share_type", F.lit("")) == "").cast("int")).alias("untyped"))
    pages = rows.select(*PAGE).unionByName(ocr.select(*PAGE)).groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"))
    bad = page.join(text, PAGE, "left").join(pages, "doc_id").where((F.col("pages") > 1) & is_form_page(form_hits(F.coalesce("t", F.lit(""))), F.col("long"), F.col("untyped")))
    return rows.join(bad.select(*PAGE), PAGE, "left_anti")


def _accept_pages(doc: object, columns: list[list]) -> list[tuple]:
    """Whether a page is new depends on the pages accepted before it: one pass over a document's rows, sorted by page."""
    names, counts, kept = set(), set(), []
    for page, rows in groupby(zip(*columns), key=lambda r: r[0]):
        _, packed, n = zip(*rows)
        if names and len(n) >= 2 and max(sum(x in names for x in packed), sum(x in counts for x in n)) / len(n) >= W.DUPLICATE_PAGE:
            continue
        kept.append((doc, page))
        names.update(packed)
        counts.update(n)
    return kept


def drop_repeated_pages(rows: DataFrame) -> DataFrame:
    """Without pages half of whose rows (by name or by count) were on pages accepted before. Only slim rows of one document meet in a task."""
    slim = rows.select("doc_id", "page_num", no_space(F.coalesce("name", F.lit(""))).alias("name"), count_of().alias("n"))
    kept = by_key(slim, ["page_num"], _accept_pages, rows.select(*PAGE).schema)
    return rows.join(kept, PAGE, "left_semi")


def deduplicated(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Exact copies go; of rows with one name (without spaces) and count, typed ones stay, or else the first. New `ord` from 0."""
    once = first_of(rows, ["doc_id", "name", "share_type", "share_count"], [order]).withColumn("__name", no_space(F.col("name")))
    out = typed_preferred(once, ["doc_id", "__name", "share_count"], "share_type", order)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", order)) - 1
    return out.withColumn("__o", place.cast("int")).drop("__name", "place", order).withColumnRenamed("__o", order)


def low_confidence(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Documents with pages on which OCR found no row at all."""
    return pages.select("doc_id").distinct().join(ocr.select("doc_id").distinct(), "doc_id", "left_anti")
