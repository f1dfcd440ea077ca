"""Text normalisation, page text and identity columns."""

from __future__ import annotations

import json
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from yushi import fixed_values as V
from yushi.functions.regex import group, has_any, hit, let

# full-width forms U+FF01..U+FF5E stand at a fixed distance from ASCII
_IDEOGRAPHIC_SPACE, _NO_BREAK_SPACE = chr(0x3000), chr(0xA0)
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + _IDEOGRAPHIC_SPACE + _NO_BREAK_SPACE
NARROW = "".join(chr(0x21 + i) for i in range(94)) + "  "
WIDE_DIGITS = "０１２３４５６７８９" + _IDEOGRAPHIC_SPACE + _NO_BREAK_SPACE
NARROW_DIGITS = "0123456789  "
_DASHES, _WAVES = "‐‑‒–—―−－", "~〜～"
_MARKS = (_DASHES + _WAVES, "-" * len(_DASHES) + "〜" * len(_WAVES))
# both translations in one: what a wide form becomes may be a mark itself
_WIDE_AND_MARKS = (WIDE + _MARKS[0], (NARROW + _MARKS[1]).replace("~", "〜"))
_MARK = chr(1)

# characters that compatibility normalisation leaves alone (ASCII, kana, kanji,
# marks, shapes) or that WIDE covers; few ranges, as each costs time per character
_PLAIN = (
    r"^[\x{4E00}-\x{9FFF}\x{3041}-\x{3096}\x00-\x7F\x{30A1}-\x{30FE}\x{FF01}-\x{FF5E}"
    r"\x{3000}-\x{3011}\x{3014}-\x{301C}\x{25A0}-\x{25FF}\x{A0}\x{BF}-\x{FF}]*+$"
)
_BLANKS = r"[\s\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+"
_EDGE = " \t\n\v\f\r" + "".join(chr(x) for x in (0x85, 0xA0, 0x2028, 0x2029, 0x3000))


def _arrow_nfkc():
    # a nested function travels to the workers by value: they need not have the package
    def normalized(s: pd.Series) -> pd.Series:
        from unicodedata import normalize

        return s.map(lambda t: normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(normalized, StringType())


_nfkc = _arrow_nfkc()


def nfkc(text: Column) -> Column:
    """Compatibility normalisation.

    Text made only of characters with a known one-to-one form is translated in
    the JVM; only the rest travels to the Arrow function (others are sent as NULL).
    """
    return F.coalesce(_nfkc(F.when(~text.rlike(_PLAIN), text)), F.translate(text, WIDE, NARROW))


def fold(text: Column) -> Column:
    """Digits and blanks to ASCII so that ASCII-only patterns see them."""
    return F.translate(text, WIDE_DIGITS, NARROW_DIGITS)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_EDGE))


def normalize_cell(text: Column) -> Column:
    """Half-width, single blanks, trimmed; NULL becomes the empty string."""
    return F.coalesce(strip(F.regexp_replace(nfkc(text), _BLANKS, " ")), F.lit(""))


def _unify_months(text: Column) -> Column:
    return F.regexp_replace(text, "[かカヵケ]月", "ヶ月")


def unify_marks(text: Column) -> Column:
    """One dash, one wave dash, one spelling of "months"."""
    return _unify_months(F.translate(text, *_MARKS))


def normalize_text(text: Column) -> Column:
    """Compatibility form with unified marks; plain text needs one translation."""
    odd = F.translate(_nfkc(F.when(~text.rlike(_PLAIN), text)), *_MARKS)
    return _unify_months(F.coalesce(odd, F.translate(text, *_WIDE_AND_MARKS)))


def normalize_brochure(text: Column) -> Column:
    t = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "[－–—]", "-")
    return F.regexp_replace(t, "[〜～]", "~")


def normalize_rate_page(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?|\n+", "\n")
    t = F.regexp_replace(t, r"[\x{2010}-\x{2015}\x{2212}\x{FF0D}]", "-")
    return F.regexp_replace(t, "[~〜～]", "〜")


# named, decimal and hexadecimal references; a final semicolon is part of the name
_REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});?"
# names that need no semicolon, the longest first: a longer word may begin with one
_BARE = "^&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
_FREQUENT = ["amp;", "nbsp;", "lt;", "gt;", "quot;", "yen;", "copy;", "middot;", "apos;", "hellip;", "times;"]


def _names() -> Column:
    """All names of HTML as one map literal; look-ups go through it in order, so frequent names come first."""
    table = {n: html5[n] for n in [*_FREQUENT, *sorted(html5)]}
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>")


def _windows_1252() -> Column:
    """What the code points 128 to 159 stand for on pages."""
    known = {str(n): bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return F.from_json(F.lit(json.dumps({k: v for k, v in known.items() if v}, ensure_ascii=False)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a number; control characters and code points that are none give nothing, numbers out of range the mark for it."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    odd = F.when(code.between(128, 159), F.try_element_at(_windows_1252(), code.cast("string")))
    return F.when(bad, chr(0xFFFD)).when(none, "").otherwise(F.coalesce(odd, plain))


def _decoded(reference: Column, bare: bool) -> Column:
    """The characters of one reference, itself if there is no such name.

    Numbers have any number of digits; with `bare`, a word that is no name is read as the longest name it begins with, if that needs no semicolon."""
    def numbered(digits):
        hexadecimal = digits.startswith("&#x")
        rest = F.ltrim(F.when(hexadecimal, F.substring(digits, 4, 1 << 30)).otherwise(F.substring(digits, 3, 1 << 30)), F.lit("0"))
        short = let(rest, lambda r: F.when(F.length(r) <= 8, r))  # a longer number is no code point
        return let(F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).try_cast("bigint"), _character)

    number = let(F.rtrim(F.lower(reference), F.lit(";")), numbered)
    name, start = F.substring(reference, 2, 40), F.regexp_extract(reference, _BARE, 1)
    known = F.try_element_at(_names(), name)
    begun = F.when(start != "", F.concat(F.try_element_at(_names(), start), F.substring(reference, F.length(start) + 2, F.lit(40))))
    return F.when(reference.startswith("&#"), number).otherwise(F.coalesce(known, *[begun] * bare, reference))


def unescape(text: Column, bare: bool = True) -> Column:
    """References to characters, each decoded once: what one becomes is never read as another.

    Without `bare`, only references that end with a semicolon count."""
    reference = _REFERENCE if bare else _REFERENCE[:-1]

    def replaced(t):
        pieces = F.zip_with(F.split(t, reference), F.regexp_extract_all(t, F.lit(reference), 0),
                            lambda a, r: F.concat(a, F.coalesce(_decoded(r, bare), F.lit(""))))
        return F.array_join(pieces, "")

    return let(text, lambda t: F.when(t.contains("&"), replaced(t)).otherwise(t))


# comments, hidden elements and tags in one pass over the page
_TAG = r"(?s)</?[a-zA-Z!?][^>]*>"
_MARKUP = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|</?[a-z!?][^>]*>"
_MARKUP_ALL = r"(?is)<!--.*?-->|<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>|</?[a-z!?][^>]*>"


def raw_text(html: Column, bare: bool = True) -> Column:
    """All text of a page, markup removed without a separator."""
    return strip(unescape(F.regexp_replace(html, _MARKUP, ""), bare))


def split_text(html: Column, bare: bool = True) -> Column:
    """One line per text node, scripts and styles dropped, nothing normalised."""
    pieces = F.split(unescape(F.regexp_replace(html, _MARKUP_ALL, _MARK), bare), _MARK)
    parts = F.transform(pieces, strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def with_page_text(df: DataFrame, html: str, name: str) -> DataFrame:
    """Add clean page text: one line per text node, normalised, no blank lines.

    The tag removal is a projection of its own, so normalisation, which looks at
    its input more than once, does not repeat it."""
    out = df.withColumn("_lines", split_text(F.col(html)))
    return out.withColumn(name, F.regexp_replace(normalize_text(F.col("_lines")), r"\n{2,}", "\n")).drop("_lines")


def element(html: Column, names: str) -> Column:
    """Text of the first element among `names` ("h1", "h1|h2"), NULL if none."""
    p = rf"(?is)<(?:{names})\b[^>]*>(.*?)</(?:{names})\s*>"
    return let(F.regexp_extract(html, p, 0), lambda e: F.when(
        e != "", strip(unescape(F.regexp_replace(F.regexp_extract(e, p, 1), _TAG, "")))))


def page_title(html: Column) -> Column:
    return element(html, "title")


def fix_encoding(text: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; anything else stays as it is."""
    suspect = text.rlike(r"^[\x00-\xFF]*$") & text.rlike(r"[\x80-\xFF]")
    # E'..' bytes come from the guarded copy, so no row can fail to encode
    raw = F.encode(F.when(suspect, text), "ISO-8859-1").cast("string")
    return F.coalesce(F.try_validate_utf8(raw), text)


def content_hash(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")), 256)


# ---------------------------------------------------------------- product name
def name_from_title(html: Column, loan_type: Column) -> Column:
    return F.coalesce(*[_named(element(html, n), V.NAME_WORDS_TITLE) for n in ("title", "h1")],
                      F.concat(F.lit(V.NAME_PREFIX), loan_type))


def _named(text: Column, words) -> Column:
    return let(text, lambda t: F.when(has_any(t, words), t))


def name_from_heading(html: Column) -> Column:
    return F.coalesce(*[_named(element(html, n), V.NAME_WORDS_HEADING) for n in ("h1", "h2", "title")],
                      F.lit(V.NAME_FALLBACK_HEADING))


def name_from_catalogue(html: Column) -> Column:
    def quoted(text, pattern):
        return let(group(text, pattern, 1), lambda q: F.when(q != "", q))

    return F.coalesce(
        let(element(html, "h1"), lambda h: F.coalesce(quoted(h, V.NAME_QUOTED_H1), h)),
        quoted(element(html, "title"), V.NAME_QUOTED_TITLE), F.lit(V.NAME_FALLBACK_CATALOGUE),
    )


def first_heading(html: Column) -> Column:
    """First h1 or h2, not normalised."""
    return element(html, "h1|h2")


def name_from_brochure(text: Column, fallback: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(n), n) for n in V.BROCHURE_NAMES], fallback)


def variant_name(base: Column, variant: Column) -> Column:
    """Profile or page name with the sales channel behind it."""
    out = base
    for key, suffix in V.VARIANT_SUFFIXES.items():
        out = F.when(variant == key, F.concat(base, F.lit(suffix))).otherwise(out)
    return out


def as_of_date(text: Column) -> Column:
    """First 20YY年M月D日 of a text as YYYY-MM-DD (digits as written)."""
    def date(h):
        part = lambda i: F.lpad(group(h, V.AS_OF_DATE, i), 2, "0")
        return F.when(h.isNotNull(), F.concat_ws("-", group(h, V.AS_OF_DATE, 1), part(2), part(3)))

    return let(hit(normalize_cell(text), V.AS_OF_DATE), date)


def checked_date(date_text: Column) -> Column:
    """NULL unless month and day lie in 1..12 and 1..31."""
    month = F.substring(date_text, 6, 2).try_cast("int")
    day = F.substring(date_text, 9, 2).try_cast("int")
    return F.when(month.between(1, 12) & day.between(1, 31), date_text)
