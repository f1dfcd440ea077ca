"""Tables of a page or brochure as array<array<string>> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions import amounts, rates, terms
from yushi.functions.regex import has_any, num, one, pair, two
from yushi.functions.text import _TAG, nfkc, strip, unescape

_ROW, _CELL = chr(1), chr(2)


def html_tables(html: Column) -> Column:
    """All tables of a page: array<array<array<string>>> of trimmed cell texts."""
    def inner(text, names):
        return F.regexp_extract_all(text, F.lit(rf"(?is)<{names}\b[^>]*>(.*?)</{names}\s*>"), F.lit(1))

    def cell(c):
        return strip(unescape(F.regexp_replace(c, _TAG, "")))

    return F.transform(inner(html, "table"), lambda t: F.transform(
        inner(t, "tr"), lambda r: F.transform(inner(r, "t[hd]"), cell)))


def html_cells(html: Column) -> Column:
    return F.flatten(F.flatten(html_tables(html)))


def from_text(text: Column) -> Column:
    """Rows per line, cells separated by '|'."""
    return F.transform(F.split(text, "\n"), lambda r: F.split(r, r"\|"))


def normalize(grid: Column) -> Column:
    """Half-width, single blanks and trimmed, all cells of a grid in one pass."""
    joined = F.array_join(F.transform(grid, lambda r: F.array_join(r, _CELL)), _ROW)
    return F.transform(F.split(nfkc(joined), _ROW), lambda r: F.transform(
        F.split(r, _CELL), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))))


def score(grid: Column) -> Column:
    """Relevance: key words + 0.2 per column + 0.1 per row, on a normalised grid."""
    flat = F.array_join(F.flatten(grid), " ")
    words = F.lit(0)
    for w in V.TABLE_SCORE_WORDS:
        words = words + F.size(F.split(flat, w)) - 1
    columns = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return words.cast("double") + (columns * F.lit(0.2) + F.size(grid) * F.lit(0.1))


def _column_like(header: Column, words) -> Column:
    """0-based index of the first header cell holding one of `words`, else NULL."""
    at = F.array_position(F.transform(header, lambda h: has_any(h, words)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def _rows_behind_header(df: DataFrame, grid: str) -> DataFrame:
    return (df.withColumn("header", F.get(F.col(grid), F.lit(0)))
            .select("*", F.posexplode(F.slice(F.col(grid), 2, F.greatest(F.size(grid) - 1, F.lit(0)))).alias("row_no", "row")))


def rate_records(df: DataFrame, grid: str) -> DataFrame:
    """One row per rate line of a normalised grid; empty lines are left out."""
    words = {k: [w.replace("／", "/") for w in v] for k, v in V.HEADER_ALIASES.items()}
    rows = _rows_behind_header(df, grid)
    at = {k: _column_like(F.col("header"), w) for k, w in words.items()}
    name = F.get(F.col("row"), F.coalesce(at.pop("product_name"), F.lit(0)))
    rows = rows.withColumn("product_name", F.nullif(name, F.lit("")))
    for key, idx in at.items():
        rows = rows.withColumn(key, rates.cell_decimal(F.get(F.col("row"), idx)))
    found = F.coalesce(F.col("product_name").isNotNull(), F.lit(False))
    for key in at:
        found = found | F.col(key).isNotNull()
    return rows.where(found).drop("header", "row")


def product_records(df: DataFrame, grid: str) -> DataFrame:
    """One row per known product of a web table with name, amount and term."""
    head = F.col("header")

    def last_index(cond):
        hits = F.filter(F.sequence(F.lit(0), F.size(head) - 1), lambda i: cond(F.get(head, i)))
        return F.array_max(hits)

    is_name = lambda h: h.contains("商品名")
    is_amount = lambda h: ~is_name(h) & (h.contains("融資金額") | (h.endswith("金額") & ~h.contains("融資")))
    is_term = lambda h: ~is_name(h) & ~is_amount(h) & has_any(h, ["融資期間", "返済期間"])
    rows = (_rows_behind_header(df, grid).where(F.size("header") >= 3)
            .withColumn("name_at", last_index(is_name))
            .withColumn("amount_at", last_index(is_amount))
            .withColumn("term_at", last_index(is_term)))
    widest = F.greatest("name_at", "amount_at", "term_at")
    amount = amounts.from_web_cell(F.get(F.col("row"), F.col("amount_at")))
    term = terms.from_cell(F.get(F.col("row"), F.col("term_at")))
    name = F.col("product_name")
    return (rows.where(F.size("row") >= widest + 1)
            .withColumn("product_name", F.get(F.col("row"), F.col("name_at")))
            .where(F.length(name).between(2, 50) & has_any(name, V.WEB_TABLE_NAMES))
            .withColumn("amount", amount).withColumn("term", term)
            .withColumns({"min_loan_amount": F.col("amount.lo"), "max_loan_amount": F.col("amount.hi"),
                          "min_loan_term": F.col("term.lo"), "max_loan_term": F.col("term.hi")})
            .drop("header", "row", "name_at", "amount_at", "term_at", "amount", "term"))


# ------------------------------------------------------- labelled two-cell rows
def _labelled(tables: Column) -> Column:
    return F.filter(F.flatten(tables), lambda r: F.size(r) >= 2)


def _last(rows: Column, label, parse) -> Column:
    """Parsed second cell of the last matching row that yields a value."""
    found = F.transform(F.filter(rows, lambda r: label(r[0])), lambda r: parse(r[1]))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))


def loan_fields(tables: Column) -> Column:
    """Limit, rate and term of the labelled rows of all tables of a page."""
    def rate(c):
        same = lambda x: pair(x, x)
        return F.coalesce(two(c, V.CELL_RANGE, num, pair), one(c, V.CELL_YEAR_ONE, num, same), one(c, V.CELL_ONE, num, same))

    rows = _labelled(tables)
    is_limit = lambda h: h.contains("限度額")
    is_rate = lambda h: ~is_limit(h) & has_any(h, ["利率", "金利"])
    is_term = lambda h: ~is_limit(h) & ~is_rate(h) & h.contains("期間")
    return F.struct(
        _last(rows, is_limit, amounts.labelled_limit).alias("amount"),
        _last(rows, is_rate, rate).alias("rate"),
        _last(rows, is_term, terms.labelled_years).alias("term"),
    )


def catalogue_fields(tables: Column) -> Column:
    """Fields of a catalogue page's labelled rows; each row serves one label."""
    labels = [["金利"], ["借入金額", "融資金額"], ["借入時年令", "年齢"], ["申込資格"], ["保証人"], ["資金使途"]]

    def only(k):
        def cond(h):
            earlier = F.lit(False)
            for words in labels[:k]:
                earlier = earlier | has_any(h, words)
            return has_any(h, labels[k]) & ~earlier
        return cond

    rows = _labelled(tables)
    text = lambda c: c
    return F.struct(
        _last(rows, only(0), rates.from_cell).alias("rate"),
        _last(rows, only(1), amounts.from_cell).alias("amount"),
        _last(rows, only(2), terms.ages_from_cell).alias("age"),
        _last(rows, only(3), text).alias("eligibility_requirements"),
        _last(rows, only(4), text).alias("guarantor_requirements"),
        _last(rows, only(5), text).alias("fund_usage"),
    )
