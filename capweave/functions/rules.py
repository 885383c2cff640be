"""Row and page predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .text import contains_any, count_contained, is_place, name_prefix, name_words, no_space, stripped


def is_aggregate_label(x: Column) -> Column:
    """A total's label: exactly one of them, or holding one of two characters or more. Labels listed with spaces never match."""
    packed = no_space(stripped(x))
    return packed.isin(*W.AGGREGATE_LABELS) | contains_any(packed, [w for w in W.AGGREGATE_LABELS if len(w) > 1])


def may_insert(name: Column, count: Column, median: Column, total: Column) -> Column:
    """Whether a row read by OCR may be added; median: the upper median of the page's counts (null: none), total: null if unknown."""
    bad = (
        contains_any(no_space(name), W.INSERT_REJECTS)
        | F.contains(name, F.lit("@"))
        | name.rlike(r"^\d+\s+")
        | name.rlike(r"\d{6}-\*+")
        | name.rlike("\\d{1,2}월|\\d{1,2}일|\\d{4}년")
        | F.coalesce((median > 0) & (count > median * W.MEDIAN_FACTOR), F.lit(False))
        | (count >= W.INSERT_LIMIT)
        | stripped(name).rlike("^\\d+[명건개호주]?$")
        | (F.length(stripped(name)) < 2)
        | F.coalesce(count == total, F.lit(False))
    )
    return ~bad


def is_signature_row(x: Column) -> Column:
    """x: a row's cells joined by spaces."""
    rest = F.length(F.regexp_replace(x, "[\\d년월일\\s]", ""))
    mostly_date = (F.length(x) > 0) & ((F.length(x) - rest) / F.length(x) > 0.7)
    return contains_any(no_space(x), W.SIGNATURE_WORDS) | F.contains(x, F.lit("(인)")) | F.contains(x, F.lit("( 인 )")) | mostly_date


def keeps_line(cells: Column) -> Column:
    """Whether an OCR line may be data: no total, no lone heading, no long text without digits, no registration numbers alone, no signature."""
    text = F.array_join(cells, " ")
    numbers = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"\d+"), F.lit(0))
    ids_only = (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.length(n) >= 13)
    heading = (F.size(cells) == 1) & F.lower(stripped(cells[0])).isin(*W.HEADINGS)
    return ~(F.exists(cells, is_aggregate_label) | heading | ((F.length(text) > 30) & (F.size(numbers) == 0)) | ids_only | is_signature_row(text))


def is_address(x: Column) -> Column:
    return x.rlike("(?U)\\d+\\s*[동호층]") | (count_contained(x, W.ADDRESS_WORDS) >= 2)


def name_has_address(x: Column) -> Column:
    """Two address words, or any word but the first that is a place."""
    words = name_words(x)
    return (count_contained(x, W.NAME_ADDRESS_WORDS) >= 2) | F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), is_place)


def usable_name(x: Column) -> Column:
    """A name without an address in it, or with a prefix before the address."""
    return ~name_has_address(x) | (name_prefix(x) != "")


def is_digit_heavy(x: Column) -> Column:
    """Five characters or more, over 60 % of them digits, hyphens or points."""
    t = stripped(x)
    return (F.length(t) >= 5) & ((F.length(t) - F.length(F.regexp_replace(t, r"(?U)[\d.-]", ""))) / F.length(t) > 0.60)


def is_form_page(hits: Column, long_share: Column, untyped_share: Column) -> Column:
    """hits: form words on the page; the shares are of its rows, null without rows."""
    return (hits >= 3) | F.coalesce((hits >= 2) & (long_share >= 0.3) & (untyped_share >= 0.5), F.lit(False))


def form_hits(text: Column) -> Column:
    return count_contained(no_space(text), W.FORM_WORDS)


def is_pdf_upload(path: Column, length: Column) -> Column:
    return F.lower(path).endswith(".pdf") & (length > 0)


def is_valid_request(holders: Column, pre_money: Column, lead_amount: Column) -> Column:
    return (F.size(holders) > 0) & (pre_money > 0) & (lead_amount > 0)


def ready_rows(names: Column, counts: Column) -> Column:
    """A form's first step: rows, all named, all with a positive count (arrays)."""
    return (F.size(names) > 0) & F.forall(names, lambda n: F.coalesce(stripped(n) != "", F.lit(False))) & F.forall(counts, lambda c: F.coalesce(c > 0, F.lit(False)))


def ready_terms(company: Column, stage: Column, pre_money: Column) -> Column:
    return (stripped(company) != "") & (stripped(stage) != "") & (pre_money > 0)


def ready_investors(names: Column, amounts: Column) -> Column:
    """The lead first; every investor has a name and a positive amount."""
    return ready_rows(names, amounts)
