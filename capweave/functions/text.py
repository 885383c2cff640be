"""Scalar functions on names, share types, counts and replies, as Column expressions.

All take and return Columns and stay in the JVM. Null in gives null out unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

# A trailing parenthesis with one level of nesting; numbers that may be totals.
_PAREN = r"\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*$"
TOTAL_NUMBER = r"\d{1,3}(?:,\d{3})+|\d{4,}"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeezed(x: Column) -> Column:
    return stripped(F.regexp_replace(x, r"(?U)\s+", " "))


def no_space(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def contains_any(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def count_contained(x: Column, words) -> Column:
    return sum((F.contains(x, F.lit(w)).cast("int") for w in words), F.lit(0))


def parse_count(x: Column) -> Column:
    """The digits and points of x as a positive whole number, decimals cut off; null if there is none."""
    number = F.regexp_replace(x, r"[^\d.]", "")
    n = number.try_cast("double").try_cast("bigint")
    return F.when(n > 0, n)


def join_single_syllables(x: Column) -> Column:
    """Runs of single Hangul syllables become one word; other words keep one space between them."""
    return F.regexp_replace(squeezed(x), r"(?<=(?:^|\s)[가-힣])\s+(?=[가-힣](?:\s|$))", "")


def ascii_romans(x: Column) -> Column:
    for base, make in ((0x2160, str), (0x2170, str.lower)):
        for i, numeral in enumerate(W.ROMAN):
            x = F.replace(x, F.lit(chr(base + i)), F.lit(make(numeral)))
    return x


def clean_name(x: Column) -> Column:
    """White space, a leading number, a birth date in parentheses, numeral glyphs, then single syllables."""
    x = F.regexp_replace(squeezed(x), r"^\d+[.)]\s*", "")
    x = F.regexp_replace(x, r"\(\d{6}(?:-[\d*]+)?\)", "")
    return stripped(join_single_syllables(ascii_romans(x)))


def normal_share_type(x: Column) -> Column:
    x = stripped(x)
    return (
        F.when(x.isin("RCPS", "종류주식", "의결권없는주식"), x)
        .when(F.contains(x, F.lit("보통")), W.COMMON)
        .when(F.contains(x, F.lit("우선")), W.PREFERRED)
        .when(x == "", W.COMMON)
        .otherwise(x)
    )


def known_share_type(x: Column) -> Column:
    """The normal form if it is a known type, else ''."""
    n = normal_share_type(x)
    return F.when((F.coalesce(x, F.lit("")) != "") & n.isin(*W.SHARE_TYPES), n).otherwise("")


def strip_parentheses(x: Column, organisations=W.ORGANISATIONS, business_number: bool = True) -> Column:
    """Removes trailing parentheses (one level of nesting) that name an organisation, however many; then a business number."""
    cut = lambda t: F.regexp_replace(F.regexp_replace(t, _PAREN, ""), r"(?U)\s+$", "")
    step = lambda t, _: F.when(contains_any(F.regexp_extract(t, _PAREN, 1), organisations), cut(t)).otherwise(t)
    most = F.length(x) - F.length(F.replace(x, F.lit("("), F.lit("")))
    x = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), x, step)).otherwise(x)
    return F.regexp_replace(x, r"\s*\(\d{3}-\d{2,}-\d{4,}\)\s*$", "") if business_number else x


def scoring_name(x: Column) -> Column:
    """The form of a name in which scoring compares it."""
    x = F.replace(squeezed(x), F.lit("㈜"), F.lit("(주)"))
    x = F.regexp_replace(x, r"(?U)주식회사\s*", "(주)")
    for token in W.COMPOUNDS:
        x = F.regexp_replace(x, r"(?U)" + r"\s*".join(token), token)
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s*\(\s*", "("), r"(?U)\s*\)\s*", ")")
    return stripped(x)


def scoring_keys(x: Column) -> Column:
    """plain, packed (no spaces) and bare (without organisations, no spaces), made once a row."""
    plain = scoring_name(x)
    bare = no_space(scoring_name(strip_parentheses(x, W.SCORING_ORGANISATIONS, business_number=False)))
    return F.struct(plain.alias("plain"), no_space(plain).alias("packed"), bare.alias("bare"))


def names_match(a: Column, b: Column) -> Column:
    """a, b: scoring_keys(). Equal or one edit apart, with or without organisations."""
    near = lambda p, q: (p == q) | (F.levenshtein(p, q, 1) >= 0)
    return near(a["packed"], b["packed"]) | near(a["bare"], b["bare"])


def is_place(w: Column) -> Column:
    return w.isin(*W.PLACES) | ((F.length(w) >= 2) & F.contains(F.lit(W.UNIT_ENDINGS), F.right(w, F.lit(1))))


def name_words(x: Column) -> Column:
    return F.filter(F.split(squeezed(x), " "), lambda w: w != "")


def name_prefix(x: Column) -> Column:
    """The words before the first place; if shorter than 2 characters, the first short Hangul word that is no place; else ''."""
    words = name_words(x)
    first = F.array_position(F.transform(words, is_place), True)
    prefix = F.array_join(F.when(first == 0, words).otherwise(F.slice(words, 1, F.greatest(first - 1, F.lit(0)).cast("int"))), " ")
    person = F.filter(words, lambda w: w.rlike("^[가-힣]{2,4}$") & ~w.isin(*W.PLACES) & ~F.contains(F.lit(W.PLACE_ENDINGS), F.right(w, F.lit(1))))
    return F.when(F.length(prefix) >= 2, prefix).otherwise(F.coalesce(F.try_element_at(person, F.lit(1)), F.lit("")))


def hint_line(cells: Column, ordinal: Column) -> Column:
    """A numbered prompt line of a row's cells."""
    return F.concat(ordinal.cast("string"), F.lit(": "), F.array_join(cells, " | "))


def unfenced(x: Column) -> Column:
    """A reply without the code fence around it, whatever the case of its label."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(x), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def once(x: Column, use) -> Column:
    """use(x) with x computed once, however often it is used: as the one member of an array, since Spark shares no parts of lambdas."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _kind(v: Column) -> Column:
    """Of a variant: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, FLOAT, BOOLEAN or VOID; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _shown(v: Column, kind: Column) -> Column:
    """A value as a name is read from it: texts as they are, numbers as they are printed, True, False, None; a list or an object as JSON."""

    def printed(number):
        whole = (number == F.floor(number)) & (F.abs(number) < 1e16)
        return F.when(whole, F.concat(number.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))

    text = F.try_variant_get(v, "$", "string")
    point = once(F.try_variant_get(v, "$", "double"), printed)
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), point).when(v.isNotNull(), F.coalesce(text, F.to_json(v))).otherwise("")


def _counted(v: Column, kind: Column) -> Column:
    """A count: of a text, its digits; of a number, its whole part; true is 1; anything else 0."""
    return F.coalesce(
        F.when(kind == "STRING", parse_count(F.try_variant_get(v, "$", "string")))
        .when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double").try_cast("bigint"))
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")),
        F.lit(0).cast("bigint"),
    )


def parsed_reply(x: Column) -> Column:
    """state, items of a reply. state: failed (no reply, or a blank one), broken (no JSON), shape (no object, or one of its rows is none), read. items: an
    array of variants if it was read, empty where there are no rows, or they aren't a list. An object that repeats a key is broken."""

    def judged(v, items):
        state = F.when(x.isNull() | (stripped(x) == ""), "failed").when(v.isNull(), "broken").when(_kind(v) != "OBJECT", "shape").when(F.exists(items, lambda i: _kind(i) != "OBJECT"), "shape").otherwise("read")
        return once(state, lambda s: F.struct(s.alias("state"), F.when(s == "read", items).alias("items")))

    rows = lambda v: F.coalesce(F.try_variant_get(v, "$.shareholders", "array<variant>"), F.array().cast("array<variant>"))
    # As the one member of a list, so that anything behind the object is an error.
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), unfenced(x), F.lit("]"))), "$", "array<variant>")
    one = once(whole, lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))))
    return once(one, lambda v: once(rows(v), lambda items: judged(v, items)))


def reply_rows(x: Column) -> Column:
    """array<row_index, name, share_type, share_count> of a JSON reply; row_index is the place in the reply, whichever rows drop out for want of a name or a
    count. Broken JSON is an empty list; a failed call and a reply of another shape give null."""

    def row(i, at):
        of = lambda k, use: once(F.try_variant_get(i, f"$.{k}", "variant"), lambda v: once(_kind(v), lambda kind: use(v, kind)))
        typed = lambda v, kind: F.when(v.isNull() | (kind == "VOID"), "").otherwise(once(_shown(v, kind), normal_share_type))
        return F.struct(at.alias("row_index"), clean_name(of("name", _shown)).alias("name"), of("shareType", typed).alias("share_type"), of("shareCount", _counted).alias("share_count"))

    def rows(got):
        found = F.filter(F.transform(got["items"], row), lambda r: (r["name"] != "") & (r["share_count"] > 0))
        return F.when(got["state"] == "broken", F.array().cast("array<struct<row_index:int,name:string,share_type:string,share_count:bigint>>")).otherwise(found)

    return once(parsed_reply(x), rows)


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def draft_line(x: Column) -> Column:
    """name, share_type, share_count of a numbered line `N. name / type / count`; null for other lines."""
    parts = F.transform(F.split(F.regexp_extract(x, r"^(\d+)\.\s*(.+)", 2), "/"), stripped)
    name = clean_name(parts[0])
    count = parse_count(F.element_at(parts, -1))
    kind = F.when(F.size(parts) >= 3, known_share_type(F.try_element_at(parts, F.lit(2)))).otherwise("")
    return F.when(x.rlike(r"^\d+\.\s*.+") & (F.size(parts) >= 2), F.struct(name.alias("name"), kind.alias("share_type"), count.alias("share_count")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def from_millions(n: Column) -> Column:
    return n * 1_000_000


def totals_in(x: Column) -> Column:
    """The numbers of a text that may be totals: over 100, fewer than 13 digits."""
    digits = F.transform(F.regexp_extract_all(x, F.lit(TOTAL_NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.filter(F.transform(F.filter(digits, lambda n: F.length(n) < 13), lambda n: n.cast("bigint")), lambda n: n > 100)


def natural_key(x: Column) -> Column:
    """The first whole number in a text."""
    return F.nullif(F.regexp_extract(x, r"\d+", 0), F.lit("")).try_cast("bigint")


def safe_dpi(w_pt: Column, h_pt: Column, pixels: int = 60_000_000, target: int = 300, least: int = 240) -> Column:
    """The resolution at which a page stays within `pixels`, between `least` and `target`."""
    return F.greatest(F.lit(least), F.least(F.lit(target), F.floor(F.sqrt(F.lit(pixels * 72.0 * 72.0) / (w_pt * h_pt))))).cast("int")
