"""Product search: filters, text search, paging, favourites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yushi import fixed_values as V


@dataclass(frozen=True)
class LoanQuery:
    """Search conditions; None means no condition."""

    loan_type: str | None = V.DEFAULT_SEARCH_TYPE
    institution_id: int | None = None
    max_rate: float | None = None
    rate: tuple[float, float] | None = None
    amount: tuple[int, int] | None = None
    term: tuple[int, int] | None = None


#: Ranges of a product: smallest and largest bound as stored, and what stands for a bound that is missing.
RANGES = {"rate": ("interest_rate_min", "interest_rate_max", "double", -1e18, 1e18),
          "amount": ("loan_amount_min", "loan_amount_max", "bigint", -(2**62), 2**62),
          "term": ("loan_term_min", "loan_term_max", "int", -(2**30), 2**30)}


def with_open_ends(products: DataFrame) -> DataFrame:
    """Products with their ranges as rate_from, rate_to, …: a missing bound is one that no search is beyond.

    Conditions on these columns are plain comparisons, which the scan uses to skip row groups."""
    out = {}
    for name, (lo, hi, kind, least, most) in RANGES.items():
        out[f"{name}_from"] = F.coalesce(F.col(lo).cast(kind), F.lit(least).cast(kind))
        out[f"{name}_to"] = F.coalesce(F.col(hi).cast(kind), F.lit(most).cast(kind))
    return products.withColumns(out)


def curve() -> Column:
    """Place of a product on a curve through rates, amounts and terms: products that are near each other in all three are near here.

    Lower bounds in 256 steps each, their bits interleaved; the steps only decide how rows lie, never what is found."""
    step = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x))).cast("int")
    parts = [step(F.col("rate_from") * 12), step(F.log2(F.greatest(F.col("amount_from"), F.lit(1))) * 6), step(F.col("term_to").cast("double") * 5)]
    out = F.lit(0)
    for bit in range(8):
        for k, x in enumerate(parts):
            out = out + F.shiftleft(F.shiftright(x, bit).bitwiseAND(F.lit(1)), 3 * bit + k)
    return out


def _overlaps(products: DataFrame, name: str, wanted) -> DataFrame:
    """Interval overlap; an open side of a product does not exclude it."""
    if f"{name}_from" in products.columns:
        return products.where((F.col(f"{name}_from") <= wanted[1]) & (F.col(f"{name}_to") >= wanted[0]))
    lo, hi = RANGES[name][:2]
    return products.where(F.coalesce(F.col(lo) <= wanted[1], F.lit(True)) & F.coalesce(F.col(hi) >= wanted[0], F.lit(True)))


def search(products: DataFrame, query: LoanQuery) -> DataFrame:
    """Conjunction of the given conditions, pushed down to the product table."""
    if query.loan_type:
        products = products.where(F.col("loan_type") == query.loan_type)
    if query.institution_id is not None:
        products = products.where(F.col("institution_id") == query.institution_id)
    if query.max_rate is not None:
        products = products.where(F.col("interest_rate_min") <= query.max_rate)
    for name, wanted in (("rate", query.rate), ("amount", query.amount), ("term", query.term)):
        if wanted:
            products = _overlaps(products, name, wanted)
    return products


def get_by_id(products: DataFrame, key: str, value) -> DataFrame:
    return products.where(F.col(key) == value).limit(1)


def active(products: DataFrame) -> DataFrame:
    return products.where("is_active")


def bigrams(text: Column) -> Column:
    """Distinct two-character pieces, a lone character as it is."""
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, 2))
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


def text_search(docs: DataFrame, texts: list[str], words: str, exact: bool = False,
                share: float = 0.5, order: list[str] | None = None, best: int | None = None) -> DataFrame:
    """Documents with at least `share` of the query's bigrams, the number they have as score.

    The query is one short literal, so each row scores itself: for tables searched
    once or small ones; `textindex` is for those searched many times.  `exact` asks for the whole phrase; `best` keeps
    so many of the highest scores, ties by the columns in `order`."""
    body = F.concat_ws(" ", *texts)
    if exact:
        found = docs.where(body.contains(words)).withColumn("score", F.lit(1))
    else:
        asked = bigrams(F.lit(words))
        scored = docs.withColumn("score", F.size(F.array_intersect(bigrams(body), asked)))
        found = scored.where((F.col("score") > 0) & (F.col("score") >= F.ceil(F.lit(share) * F.size(asked))))
    if best is None:
        return found
    return found.orderBy(F.col("score").desc(), *(order or [])).limit(best)


def page(df: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """One page by number; use `after` or `pages` to go deep."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def after(df: DataFrame, sort: str, key: str, last_sort, last_key, size: int) -> DataFrame:
    """Next page behind the last row seen; cost does not grow with the depth."""
    behind = (F.col(sort) > last_sort) | ((F.col(sort) == last_sort) & (F.col(key) > last_key))
    return df.where(behind).orderBy(sort, key).limit(size)


def favourites(favs: DataFrame, products: DataFrame) -> DataFrame:
    """Newest favourites of each user with their products, at most the allowed number."""
    once = favs.groupBy("user_id", "product_id").agg(F.max("added_at").alias("added_at"))
    w = Window.partitionBy("user_id").orderBy(F.col("added_at").desc(), F.col("product_id"))
    kept = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= V.FAVOURITE_LIMIT)
    return kept.join(products, "product_id")
