"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from labelled documents. A text, in lower case and with everything
but letters as spaces, is cut into pieces of `PIECE` bytes, each piece is compressed with every language's dictionary, and the language with the smallest sum wins. A
narrow margin between the two smallest sums is a rejection.

Fitting takes at most `SAMPLE_ROWS` labelled rows and `DICT_BYTES` bytes for each language, chosen by a hash of doc_id; with so many
languages that they would pass `ALL_DICTS` bytes together, each gets an equal part of that. The rest of the training rows is not needed. Every whole text is then classified.

Defined results: a null text or one without a letter is `und` with score 0; without any training rows so is every text; ties go to
the smaller language name; null doc_ids are never learned from and not held out; repeated rows are classified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yushi.llm.tables import stored

SAMPLE_ROWS, DICT_BYTES, ALL_DICTS = 256, 1 << 18, 128 << 20
#: Sample ids are broadcast up to this number (a few megabytes) and joined by a shuffle beyond it.
SENT_ROWS = 100_000
PIECE, LEVEL = 1 << 12, 5
LEAST_MARGIN = 0.01
UNKNOWN = "und"
_LETTER, _REST = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]+")


def plain(text: str) -> bytes:
    return f" {_REST.sub(' ', text.lower())} ".encode()


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language; labelled has doc_id, text, lang."""
    rank = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    # ids and sizes are ranked, not texts; the few chosen ids then fetch theirs
    few = rows.select("doc_id", "lang", F.octet_length("text").alias("n")).withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= SAMPLE_ROWS)
    near = few.withColumn("before", F.sum("n").over(W.partitionBy("lang").orderBy("k")) - F.col("n")).filter(F.col("before") < DICT_BYTES)
    chosen = stored(near.select("doc_id", "lang", "k", "before"), "sample")
    # what each language may have is known before any text is fetched
    most = min(DICT_BYTES, ALL_DICTS // max(1, chosen.select("lang").distinct().count()))
    ids = chosen.filter(F.col("before") < most).drop("before")
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(ids) if ids.count() <= SENT_ROWS else ids, ["doc_id", "lang"])
    cut = texts.select("lang", "k", F.substring(F.col("text").cast("binary"), 1, most).alias("text"))
    by: dict[str, list[bytes]] = {}
    for r in cut.groupBy("lang", "k").agg(F.min("text").alias("text")).orderBy("lang", "k").toLocalIterator():
        by.setdefault(r.lang, []).append(plain(bytes(r.text).decode(errors="ignore")))
    return {lang: b"\n".join(texts)[:most] for lang, texts in by.items()}


class Model:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i:i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.by]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin: how much larger the second smallest size is."""
        if text is None or not self.by or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(plain(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        return self.langs[best], margin / (margin + 0.05), margin


def identify(docs: DataFrame, content: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """doc_id, lang_best, score, margin, rejected, lang (`und` where rejected)."""
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for b in batches:
            found = [model.classify(t.as_py()) for t in b.column(1)]
            best, score, margin = ([x[k] for x in found] for k in range(3))
            reject = [x == UNKNOWN or m < least_margin for x, m in zip(best, margin)]
            lang = [UNKNOWN if r else x for x, r in zip(best, reject)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(reject, pa.bool_()), pa.array(lang, pa.string())],
                ["doc_id", "lang_best", "score", "margin", "rejected", "lang"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_best string, score double, margin double, rejected boolean, lang string")


def report(docs: DataFrame) -> DataFrame:
    """Learn on three of four folds, classify everything."""
    content = fit(docs.filter(fold() != 2))
    rows = identify(docs, content)
    return rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "margin", "rejected")
