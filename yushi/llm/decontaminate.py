"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of all test items are counted over the whole corpus (partial counts per task, one row per n-gram). An item is
sought by all its n-grams that occur. Those in at most `RARE` documents, or in no more than the item's middle one, and its rarest
`LEAST_SEEDS` are rare. Where a document has a rare one, a window around its diagonal is aligned with the item, word by word; a window with
frequent ones only is aligned if it has enough of the item's words for the least score, which leaves out nothing that could reach it.
So the same edited passage is found however many documents hold it. Insertions, deletions and changed words cost, so edited copies score
high and documents that share only common phrases score low. The score is the alignment's share of a perfect one.

Windows are aligned in groups of bounded size, one very long window alone; its memory grows with its length, its time with the square of the item's.
A window that shares too few words with its item for the least score is left out before, which loses nothing.

A document is read by one task and never shuffled, so a passage in a third of all documents is no hot key. The benchmark is sent in
blocks of at most `BLOCK_WORDS` words; a larger benchmark takes more passes, with the same result.

Defined results: words are runs of letters and digits in lower case; null or empty texts, and items without words, match nothing;
an item shorter than the n-gram is sought by all its words; repeated rows are matched one by one, repeated items under the same id are
merged to the best match; null doc_ids and item_ids stay null.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from yushi.llm.tables import by_place, read

WIDTH, LEAST_SCORE = 3, 0.5
RARE, LEAST_SEEDS = 8.0, 12
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Alignments at once: at most so many pairs, and so many cells of a row over all of them, or one pair.
_TOGETHER, _CELLS = 512, 1 << 18
#: Words of an item from which a window must share enough of them before it is aligned, with rare seeds too.
LONG_ITEM = 256


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# -- items ----------------------------------------------------------------------------------------------------------


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The benchmark in pieces of bounded size, by a hash of the text."""
    rows = items.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (5 * BLOCK_WORDS)))
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        block = [(r.item_id, w) for r in own if (w := words(r.text))]
        if block:
            yield block


def grams(w: list[str], width: int = WIDTH) -> list[tuple[str, ...]]:
    width = min(width, len(w))
    return [tuple(w[k:k + width]) for k in range(len(w) - width + 1)]


class Lookup:
    """Where the items' n-grams occur in a text. Words that no item has break a text into stretches, which are looked at alone."""

    def __init__(self, wanted: dict[tuple[str, ...], object]):
        self.vocabulary = {x for g in wanted for x in g}
        self.by_width: dict[int, dict] = defaultdict(dict)
        for g, v in wanted.items():
            self.by_width[len(g)][g] = v

    def hits(self, w: list[str]) -> Iterator[tuple[int, object]]:
        known = np.fromiter(map(self.vocabulary.__contains__, w), bool, len(w))
        for width, table in self.by_width.items():
            if len(w) < width:
                continue
            ok = known[:len(w) - width + 1].copy()
            for k in range(1, width):
                ok &= known[k:len(w) - width + 1 + k]
            for i in np.flatnonzero(ok).tolist():
                v = table.get(tuple(w[i:i + width]))
                if v is not None:
                    yield i, v


def seed_counts(docs: DataFrame, block: list) -> dict[tuple[str, ...], int]:
    """Occurrences of the block's n-grams in the corpus, counted over all documents."""
    spark = docs.sparkSession
    every = sorted({g for _, w in block for g in grams(w)})
    sent = spark.sparkContext.broadcast({g: k for k, g in enumerate(every)})

    def run(batches):
        lookup = Lookup(sent.value)
        for b in batches:
            n = Counter(k for t in b.column(0).to_pylist() for k in {k for _, k in lookup.hits(words(t))})
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = {r.gram: r.n for r in rows}
    return {g: found.get(k, 0) for k, g in enumerate(every)}


def seeds(block: list, counts: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[tuple[int, int, bool]]]:
    """n-gram to (item number, position, whether it is rare for the item): all that occur in the corpus."""
    out: dict[tuple[str, ...], list[tuple[int, int, bool]]] = defaultdict(list)
    for k, (_, w) in enumerate(block):
        own = grams(w)
        order = sorted({g for g in own if counts[g]}, key=lambda g: (counts[g], g))
        if not order:
            continue
        limit = max(RARE, counts[order[len(order) // 2]], counts[order[:LEAST_SEEDS][-1]])
        for pos, g in enumerate(own):
            if counts[g]:
                out[g].append((k, pos, counts[g] <= limit))
    return dict(out)


# -- alignment ------------------------------------------------------------------------------------------------------


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman for many (item, window) pairs at once: best score, and the window positions it starts and ends at."""
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a = np.full((len(pairs), n), -1, np.int64)
    b = np.full((len(pairs), m), -2, np.int64)
    for k, (x, y) in enumerate(pairs):
        a[k, :len(x)], b[k, :len(y)] = x, y
    rows = np.arange(len(pairs))
    h = np.zeros((len(pairs), m + 1), np.int64)
    start = np.tile(np.arange(m + 1), (len(pairs), 1))
    best, first, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    ramp = np.arange(m + 1) * GAP
    for i in range(n):
        s = np.where(b == a[:, i:i + 1], MATCH, MISMATCH)
        diag, up = h[:, :-1] + s, h[:, 1:] + GAP
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(diag, up), 0)
        origin = np.tile(np.arange(m + 1), (len(pairs), 1))
        origin[:, 1:] = np.where(new[:, 1:] == 0, origin[:, 1:], np.where(diag >= up, start[:, :-1], start[:, 1:]))
        # gaps in the item: the best cell to the left, less its distance
        flat = new - ramp
        left = np.maximum.accumulate(flat, 1)
        came = np.maximum.accumulate(np.where(flat == left, np.arange(m + 1), 0), 1)
        h = left + ramp
        start = origin[rows[:, None], came]
        top = h.argmax(1)
        better = h[rows, top] > best
        best = np.where(better, h[rows, top], best)
        first, end = np.where(better, start[rows, top], first), np.where(better, top, end)
    return list(zip(best.tolist(), first.tolist(), end.tolist()))


def together(todo: list[tuple], lengths: list[int]) -> Iterator[list[tuple]]:
    """Windows (text, item, first word, seeds, words) of like size, in groups that are aligned at once."""
    group, widest = [], 0
    for x in sorted(todo, key=lambda x: (lengths[x[1]], len(x[4]))):
        wide = max(widest, len(x[4]))
        if group and (len(group) == _TOGETHER or (len(group) + 1) * wide > _CELLS):
            yield group
            group, wide = [], len(x[4])
        group.append(x)
        widest = wide
    if group:
        yield group


def _windows(found: list[tuple[int, tuple[int, int, bool]]], lengths: list[int], n_words: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """item, first word, last word, seeds, whether one is rare: seeds of an item on near diagonals share a window."""
    by: dict[int, list[tuple[int, bool]]] = defaultdict(list)
    for at, (k, pos, rare) in found:
        by[k].append((at - pos, rare))
    for k, diagonals in by.items():
        slack = max(4, lengths[k] // 4)
        diagonals.sort()
        first = last = diagonals[0][0]
        n, some = 0, False
        for d, rare in [*diagonals, (None, False)]:
            if d is None or d > last + slack or d > first + 4 * slack:
                yield k, max(0, first - slack), min(n_words, last + lengths[k] + slack), n, some
                if d is None:
                    break
                first, n, some = d, 0, False
            last = d
            n, some = n + 1, some or rare


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, n_seeds, first_word, last_word: the best alignment of each row with each item it holds."""
    out = None
    for block in blocks(items):
        part = _matches(docs, block, least)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long")
    return out


def _finder(block: list, table: dict):
    """A function from texts to rows (number of the text, item_id, score, seeds, first, last)."""
    lookup, lengths = Lookup(table), [len(w) for _, w in block]
    number = {x: k for k, x in enumerate({x for _, w in block for x in w})}
    items = [np.array([number[x] for x in w]) for _, w in block]
    held = [Counter(w) for _, w in block]

    def shared(k: int, w: list[str]) -> int:
        """Words that the item and the window can match at most."""
        return (held[k] & Counter(w)).total()

    def find(texts: list[str | None], least: float) -> list[tuple]:
        best: dict[tuple, tuple] = {}
        todo: list[tuple] = []

        def flush():
            for some in together(todo, lengths):
                for (i, k, first, n, y), (s, a, z) in zip(some, align([(items[k], y) for _, k, _, _, y in some])):
                    score = s / (MATCH * lengths[k])
                    key = (i, block[k][0])
                    row = (score, n, -(first + a), first + z)
                    if score >= least and row > best.get(key, (0.0,)):
                        best[key] = row
            todo.clear()

        held_words = 0
        for i, t in enumerate(texts):
            w = words(t)
            hits = [(at, x) for at, own in lookup.hits(w) for x in own]
            for k, a, z, n, rare in _windows(hits, lengths, len(w)) if hits else ():
                if (not rare or lengths[k] > LONG_ITEM) and shared(k, w[a:z]) < least * lengths[k]:
                    continue
                todo.append((i, k, a, n, np.array([number.get(x, -3) for x in w[a:z]])))
                held_words += z - a
                if len(todo) >= 8 * _TOGETHER or held_words > 8 * _CELLS:
                    flush()
                    held_words = 0
        flush()
        return [(i, item, s, n, -a, z) for (i, item), (s, n, a, z) in best.items()]

    return find


def _matches(docs: DataFrame, block: list, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((block, seeds(block, seed_counts(docs, block))))

    def run(batches):
        find = _finder(*sent.value)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), find(b.column(1).to_pylist(), least)
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                ["doc_id", "item_id", "score", "n_seeds", "first_word", "last_word"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs without a match, with the columns of docs; decided row by row."""
    names, out = docs.columns, by_place(docs)
    at, schema = names.index("text"), StructType(out.schema.fields)
    for block in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast((block, seeds(block, seed_counts(docs, block))))

        def run(batches, sent=sent):
            find = _finder(*sent.value)
            for b in batches:
                bad = {r[0] for r in find(b.column(at).to_pylist(), least)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.toDF(*names)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items)


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark passage."""
    return clean(docs, read(spark, sf_dir, "benchmark"))
