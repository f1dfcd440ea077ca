"""Equal texts looked at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIGEST = "_digest"


def fenced(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator, which filters on what is made of them don't pass, as they wouldn't a scan."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def per_text(rows: DataFrame, text: str, make: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """`rows` without their text, with the columns that `make` adds to a frame of the different (text, *by).

    Captures repeat pages, so patterns run over each different page once, whatever the number of its captures. Copies are
    combined before the shuffle; rows travel with a SHA-256 of their text instead of the text. `make` keeps the
    other columns of its frame. A filter on what `make` adds stays behind the step that finds the different texts: before it,
    the patterns would run for every capture, in as few tasks as the source has row groups."""
    keyed = rows.withColumn(_DIGEST, F.coalesce(F.sha2(F.col(text), 256), F.lit("")))
    found = make(fenced(keyed.select(_DIGEST, text, *by).distinct())).drop(text)
    names = {k: f"_by{n}" for n, k in enumerate([_DIGEST, *by])}
    same = [F.col(k).eqNullSafe(F.col(n)) if k != _DIGEST else F.col(k) == F.col(n) for k, n in names.items()]
    return keyed.drop(text).join(found.withColumnsRenamed(names), same, "left").drop(*names.values(), _DIGEST)
