"""Repeated substrings over a logarithmic family of sampled suffix arrays.

Goal: remove every byte that lies in a string of `LENGTH` bytes which also starts earlier (a smaller doc_id, or the same document
further left). Such strings are equal exactly if the first `LENGTH` bytes of two suffixes are.

*Sampling.* Of the `KEY`-byte strings inside a window of `LENGTH` bytes the one with the smallest hash is its anchor. Equal windows have equal
anchors at equal places, so the suffixes that share an anchor stand for all windows between them: a **run** is the longest stretch of
consecutive windows with one anchor, about one in 40 positions. A run is identified by its anchor and its whole content.

*Suffix arrays.* A batch of documents gives, for each part of the key space, an array of runs sorted by (anchor, content) digests with the
place of the first occurrence. Equality is all that is asked, so the order is that of the digests. Repeats inside an Arrow batch are found before the
shuffle, so a passage that a third of all documents share sends one run per Arrow batch.

*Levels.* A level is a table of such arrays. A new batch is merge-scanned with every level, part by part: a run that is there already is a
repeat. Levels of the size of the new one are merged with it in the same scan, so level k holds 2^k batches.

*Partial matches.* Runs with equal anchors and different contents may still share windows (at the ends of a repeat, around an
edit). Only for those the texts are read again and their windows compared, one anchor at a time, in document order. Anchors that very many
runs share (found in a sample of documents, which decides on the way only, not on results) are split by window instead.

Digests have 96 bits or more; no pair of different strings is expected to collide. Documents of a batch must have larger ids than those
before it.

Defined results: a null or empty text has no bytes; a text under `LENGTH` bytes loses nothing; where ids repeat or are null,
rows are numbered by doc_id (null first) and text, so of equal rows the second is a repeat of the first; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, packed, parts, slices, stored, utf8
from yushi.session import work_dir

LENGTH, KEY = 100, 32
BATCHES = 4
#: Documents looked at for anchors that very many runs share, and the share of all their runs that makes one such.
SAMPLED, HOT_SHARE, HOT_LEAST = 16, 1 / 20_000, 40
#: Bytes hashed at a time, and bytes of an Arrow batch whose runs are sorted together.
_PIECE, _SLICE = 1 << 18, 16 << 20
_AT = 128
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- runs -----------------------------------------------------------------------------------------------------------


def _key_hashes(b: np.ndarray, key: int) -> np.ndarray:
    """A mixed hash of each string of `key` bytes (a power of two)."""
    h, width, m = _TABLE[b], 1, 0x9E3779B97F4A7C15
    while width < key:
        h = h[:-width] * np.uint64(m) + h[width:]
        m, width = m * m % 2**64, 2 * width
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    n, done = len(v) - width + 1, 1
    while 2 * done <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[:n], v[width - done:width - done + n])


def runs_of(data: bytes, bounds: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, document number, start in data and number of windows of each run; bounds are the documents' starts and the end."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty
    h = _key_hashes(np.frombuffer(data, np.uint8), key)
    place = np.arange(len(h), dtype=np.uint64)
    low = _least((h & ~np.uint64(0xFFFFFF)) | place, length - key + 1) & np.uint64(0xFFFFFF)
    low = low.astype(np.int64)
    at = np.arange(len(low))
    doc = np.searchsorted(bounds, at, "right") - 1
    whole = at + length <= bounds[doc + 1]
    at, low, doc = at[whole], low[whole], doc[whole]
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return h[low[first]], doc[first], at[first], np.diff(np.append(first, len(at)))


def batches_of_runs(texts: list[bytes], length: int = LENGTH, key: int = KEY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """anchor, content digest, number of the text, at (start * 128 + windows) for pieces of about `_PIECE` bytes."""

    def done(numbers: list[int], offsets: list[int], chunks: list[bytes]):
        data = b"".join(chunks)
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        anchor, doc, at, n = runs_of(data, bounds, length, key)
        content = np.array([xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(at.tolist(), (at + n + length - 1).tolist())], np.uint64) & np.uint64(0xFFFFFFFFFFFF)
        start = at - bounds[doc] + np.array(offsets, np.int64)[doc] if len(doc) else at
        return anchor, content, np.array(numbers, np.int64)[doc] if len(doc) else doc, start * _AT + n

    numbers, offsets, chunks, size = [], [], [], 0
    for k, t in enumerate(texts):
        for first in range(0, max(1, len(t) - length + 1), _PIECE):
            piece = t[first:first + _PIECE + length - 1]
            if len(piece) < length:
                continue
            numbers.append(k)
            offsets.append(first)
            chunks.append(piece)
            size += len(piece)
            if size >= _PIECE:
                yield done(numbers, offsets, chunks)
                numbers, offsets, chunks, size = [], [], [], 0
    if chunks:
        yield done(numbers, offsets, chunks)


# -- sorted arrays --------------------------------------------------------------------------------------------------


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first one ascending: differences, byte planes, zstandard."""
    first = np.diff(columns[0].view(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n_columns, 8, -1)
    out = [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _first(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and place, and which rows are the first of their keys."""
    order = np.lexsort((at, doc, *keys[::-1]))
    differs = np.zeros(len(order) - 1 if len(order) else 0, bool)
    for k in keys:
        differs |= k[order[1:]] != k[order[:-1]]
    return order, np.concatenate([[True], differs]) if len(order) else np.zeros(0, bool)


ARRAYS = "part int, fresh boolean, doc0 long, blob binary"


def _arrays(doc: np.ndarray, anchor, content, at, part: np.ndarray, fresh: bool) -> pa.RecordBatch:
    """One sorted array per part; rows come sorted by anchor and content."""
    by = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(part[by]) != 0, [True]])) if len(by) else np.zeros(1, np.int64)
    out: list[list] = [[], [], [], []]
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        own = by[a:z]
        low = int(doc[own].min())
        out[0].append(int(part[own[0]]))
        out[1].append(fresh)
        out[2].append(low)
        out[3].append(_pack([anchor[own], content[own], (doc[own] - low).view(np.uint64), at[own].view(np.uint64)]))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["part", "fresh", "doc0", "blob"])


def _parts_of(anchor: np.ndarray, content: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Part of the key space; runs of a hot anchor are spread by content."""
    spread = np.isin(anchor, hot)
    x = np.where(spread, content * np.uint64(0x9E3779B97F4A7C15), anchor)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _stretches(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single windows that follow one another in a document as one entry of up to _AT - 1 windows; longer runs stay as they are."""
    order = np.lexsort((at, doc))
    doc, pos, n = doc[order], at[order] // _AT, at[order] % _AT
    follows = np.zeros(len(doc), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (n[1:] == 1) & (n[:-1] == 1)
    first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(doc)))) if len(doc) else np.zeros(0, np.int64)
    start = np.flatnonzero((np.arange(len(doc)) - first) % (_AT - 1) == 0)
    size = np.diff(np.append(start, len(doc)))
    return doc[start], pos[start] * _AT + np.where(n[start] == 1, size, n[start])


KINDS = "kind string, doc long, at long, anchor long, part int, fresh boolean, doc0 long, blob binary"


def _rows(kind: str, doc=None, at=None, anchor=None, arrays: pa.RecordBatch | None = None) -> pa.RecordBatch:
    n = arrays.num_rows if arrays is not None else len(doc)
    null = lambda t: pa.nulls(n, t)
    long = lambda x: null(pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
    tail = list(arrays.columns) if arrays is not None else [null(pa.int32()), null(pa.bool_()), null(pa.int64()), null(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), long(doc), long(at), long(anchor), *tail], ["kind", "doc", "at", "anchor", "part", "fresh", "doc0", "blob"])


def batch_arrays(texts: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[tuple]], hot: np.ndarray, n_parts: int) -> DataFrame:
    """KINDS rows of a batch: arrays to be scanned, and repeats already seen within an Arrow batch.

    entries gives anchor, content, doc, at of an Arrow batch in pieces."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, _SLICE)):
            found = list(entries(b))
            if not found:
                continue
            anchor, content, doc, at = (np.concatenate([f[k] for f in found]) for k in range(4))
            order, first = _first([anchor, content], doc, at)
            again = order[~first]
            if len(again):
                yield _rows("repeat", **dict(zip(("doc", "at"), _stretches(doc[again], at[again]))))
            own = order[first]
            if len(own):
                anchor, content, doc, at = anchor[own], content[own], doc[own], at[own]
                yield _rows("array", arrays=_arrays(doc, anchor, content, at, _parts_of(anchor, content, hot, n_parts), True))

    return texts.mapInArrow(run, KINDS)


def scan(rows: DataFrame, hot: np.ndarray, n_parts: int, keep: bool) -> DataFrame:
    """Merge-scan of arrays part by part: repeats, runs whose anchor has other contents too, and (if kept) the merged arrays.

    Repeats that are known already pass on their way through the same exchange, dealt by document."""
    key = F.when(F.col("kind") == "array", F.col("part")).otherwise(F.pmod(F.xxhash64("doc"), F.lit(n_parts)).cast("int"))
    dealt = rows.withColumn("to", key).repartition(parts(rows, n_parts), "to").sortWithinPartitions("kind", "part").drop("to")

    def merged(arrays: list[tuple]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], []]
        for part, fresh, doc0, blob in arrays:
            anchor, content, doc, at = _unpack(blob, 4)
            for c, v in zip(cols, (anchor, content, doc.view(np.int64) + doc0, at.view(np.int64), np.full(len(anchor), fresh))):
                c.append(v)
        anchor, content, doc, at, fresh = map(np.concatenate, cols)
        order, first = _first([anchor, content], doc, at)
        again = order[~first & fresh[order]]
        if len(again):
            yield _rows("repeat", **dict(zip(("doc", "at"), _stretches(doc[again], at[again]))))
        own = order[first]
        anchor, content, doc, at, fresh = anchor[own], content[own], doc[own], at[own], fresh[own]
        group = np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]).astype(np.int64)])) if len(own) else own
        several = (np.bincount(group) > 1) & (np.bincount(group, weights=fresh) > 0) if len(own) else own.astype(bool)
        unsure = several[group] | (np.isin(anchor, hot) & fresh) if len(own) else own.astype(bool)
        if unsure.any():
            yield _rows("unsure", doc=doc[unsure], at=at[unsure], anchor=anchor[unsure])
        if keep and len(own):
            yield _rows("array", arrays=_arrays(doc, anchor, content, at, np.full(len(own), arrays[0][0]), False))

    def run(batches):
        at, own = None, []
        for b in batches:
            known = b.filter(pa.array([k == "repeat" for k in b.column(0).to_pylist()], pa.bool_()))
            if known.num_rows:
                yield known
            for kind, part, fresh, doc0, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "fresh", "doc0", "blob"))):
                if kind != "array":
                    continue
                if part != at and own:
                    yield from merged(own)
                    own = []
                at = part
                own.append((part, fresh, doc0, blob))
        if own:
            yield from merged(own)

    return dealt.mapInArrow(run, KINDS)


# -- the family -----------------------------------------------------------------------------------------------------


class Family:
    """Levels of merged arrays: a level of size 2^k holds 2^k batches, and no two have the same size."""

    def __init__(self, n_parts: int, hot: np.ndarray, length: int = LENGTH, key: int = KEY):
        self.n_parts, self.hot, self.length, self.key = n_parts, hot, length, key
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """KINDS rows (repeat, unsure) of a batch (doc, text); the family grows by it unless it is the last."""
        length, key = self.length, self.key

        def entries(b):
            docs = b.column(0).to_numpy()
            for anchor, content, number, at in batches_of_runs([t or b"" for t in utf8(b.column(1))], length, key):
                yield anchor, content, docs[number], at

        rows = batch_arrays(texts, entries, self.hot, self.n_parts)
        size, gone = 1, []
        while any(s == size for s, _ in self.levels):  # equal sizes merge, and what they make may merge again
            gone.append(size)
            size *= 2
        for s, level in self.levels:
            rows = rows.unionByName(level)
        done = scan(rows, self.hot, self.n_parts, keep=not last) if set(gone) == {s for s, _ in self.levels} else None
        if done is None:  # some levels are only looked at: the merged arrays take in the others alone
            merging = batch_arrays(texts, entries, self.hot, self.n_parts)
            for s, level in self.levels:
                if s in gone:
                    merging = merging.unionByName(level)
            done = scan(rows, self.hot, self.n_parts, keep=False)
            if not last:
                done = done.unionByName(scan(merging, self.hot, self.n_parts, keep=True).filter("kind = 'array'"))
        path = work_dir(texts.sparkSession, "suffixes")
        done.write.partitionBy("kind").parquet(path)
        found = texts.sparkSession.read.schema(KINDS).parquet(path)
        if not last:
            self.levels = sorted([(s, x) for s, x in self.levels if s not in gone] + [(size, found.filter("kind = 'array'"))], key=lambda x: x[0])
        return found.filter("kind <> 'array'")


def hot_anchors(texts: DataFrame, length: int = LENGTH, key: int = KEY) -> np.ndarray:
    """Anchors with a large share of the runs in a sample of documents; at most 1 / HOT_SHARE of them."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, _SLICE)):
            for anchor, _, _, _ in batches_of_runs([t or b"" for t in utf8(b.column(1))], length, key):
                a, n = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])

    some = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0)
    counts = some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= max(HOT_LEAST, total * HOT_SHARE)).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64).view(np.uint64))


# -- partial matches ------------------------------------------------------------------------------------------------


def _window_runs(doc: int, pos: int, again: list[bool], length: int) -> Iterator[tuple[int, int, int]]:
    i, n = 0, len(again)
    while i < n:
        if again[i]:
            j = i
            while j + 1 < n and again[j + 1]:
                j += 1
            yield doc, pos + i, pos + j + length
            i = j
        i += 1


def partial(texts: DataFrame, unsure: DataFrame, hot: np.ndarray, n_parts: int, length: int = LENGTH) -> DataFrame:
    """doc, a, z: stretches of first occurrences whose windows occur earlier in runs of another content."""
    spark = texts.sparkSession
    wanted = unsure.select("doc", "at", "anchor").distinct()
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at")).alias("runs"))
    joined = packed(texts, "doc").join(by_doc, "doc").select("doc", "body", F.col("runs.anchor").alias("anchors"), F.col("runs.at").alias("ats"))
    kept = spark.sparkContext.broadcast(hot)

    def contents(b):
        z = zstandard.ZstdDecompressor()
        rows: list[list] = [[], [], [], []]
        for doc, body, anchors, ats in zip(*(c.to_pylist() for c in b.columns)):
            text = z.decompress(body)
            cold = ~np.isin(np.array(anchors, np.int64).view(np.uint64), kept.value)
            for anchor, at, use in zip(anchors, ats, cold.tolist()):
                if use:
                    pos, n = divmod(at, _AT)
                    for c, v in zip(rows, (anchor, doc, pos, text[pos:pos + n + length - 1])):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())], ["anchor", "doc", "pos", "content"])

    cold = arrow_map(joined, contents, "anchor long, doc long, pos long, content binary")
    dealt = cold.repartition(parts(texts), "anchor").sortWithinPartitions("anchor", "doc", "pos")

    def compared(batches):
        at, seen = None, set()
        for b in batches:
            out = []
            for anchor, doc, pos, content in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != at:
                    at, seen = anchor, set()
                own = [xxhash.xxh3_128_digest(content[i:i + length]) for i in range(len(content) - length + 1)]
                again = [x in seen for x in own]
                if any(again):
                    out += _window_runs(doc, pos, again, length)
                seen.update(own)
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "a", "z"])

    spans = dealt.mapInArrow(compared, "doc long, a long, z long")
    if not len(hot):
        return spans

    def windows(b):  # of hot anchors: each window is an entry of its own
        z = zstandard.ZstdDecompressor()
        for doc, body, anchors, ats in zip(*(b.column(c).to_pylist() for c in ("doc", "body", "anchors", "ats"))):
            use = np.isin(np.array(anchors, np.int64).view(np.uint64), kept.value)
            if not use.any():
                continue
            text = z.decompress(body)
            starts = np.array([p for at, u in zip(ats, use.tolist()) if u for p in range(at // _AT, at // _AT + at % _AT)], np.int64)
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[p:p + length]) for p in starts.tolist()), np.uint64).reshape(-1, 2)
            yield np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), np.full(len(starts), doc, np.int64), starts * _AT + 1

    none = np.zeros(0, np.uint64)
    found = scan(batch_arrays(joined, windows, none, n_parts), none, n_parts, keep=False).filter("kind = 'repeat'")
    return spans.unionByName(found.select(*_span(length)))


def _span(length: int):
    pos, n = F.floor(F.col("at") / _AT), F.pmod("at", F.lit(_AT))
    return "doc", pos.cast("long").alias("a"), (pos + n + length - 1).cast("long").alias("z")


def repeats(texts: DataFrame, batches: int = BATCHES, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """doc, a, z: stretches of bytes to remove (they may overlap). texts has doc (unique) and text."""
    n_parts = parts(texts)
    hot = hot_anchors(texts, length, key)
    cuts = texts.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()[0] or [] if batches > 1 else []
    family, found = Family(n_parts, hot, length, key), None
    edges = [None, *sorted(set(cuts)), None]
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        own = texts
        if low is not None:
            own = own.filter(F.col("doc") > low)
        if high is not None:
            own = own.filter(F.col("doc") <= high)
        rows = family.add(own, last=k == len(edges) - 2)
        found = rows if found is None else found.unionByName(rows)
    whole = found.filter("kind = 'repeat'").select(*_span(length))
    return whole.unionByName(partial(texts, found.filter("kind = 'unsure'"), hot, n_parts, length))


# -- documents ------------------------------------------------------------------------------------------------------


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text: doc is doc_id where ids are unique and not null; else a number in the order of doc_id and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return texts.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    placed = texts.repartitionByRange(parts(docs), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stored(placed.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")


def dedup(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: what is left of each document's bytes, and counts."""
    texts = numbered(docs)
    spans = repeats(texts.select("doc", "text"), batches, length, key).groupBy("doc").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    joined = packed(texts, "doc", "doc_id").join(spans, "doc", "left").select("doc_id", "body", F.col("spans.a").alias("a"), F.col("spans.z").alias("z"))

    def run(b):
        z = zstandard.ZstdDecompressor()
        cols: list[list] = [[], [], [], []]
        for body, a, e in zip(*(b.column(c).to_pylist() for c in ("body", "a", "z"))):
            text = b"" if body is None else z.decompress(body)
            keep, at, removed, n = [], 0, 0, 0
            merged: list[list[int]] = []
            for x, y in sorted(zip(a or (), e or ())):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(y, merged[-1][1])
                else:
                    merged.append([x, y])
            for x, y in merged:
                keep.append(text[at:x])
                at, removed, n = y, removed + y - x, n + 1
            keep.append(text[at:])
            for c, v in zip(cols, (len(text), removed, n, b"".join(keep))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of dedup."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

