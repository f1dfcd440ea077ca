"""Alignment of two tokenizers over the bytes of a text, and how well each link agrees with the corpus.

Both tokenizers cut the same bytes. The cumulative ends of their tokens are kept as dictionaries from end to index; ends in both
dictionaries, in order, slice both id lists into groups, and within a group every pair of tokens whose byte ranges overlap is a link.

*Segments.* A single space or newline between two other characters starts a new token in both tokenizers (no token of either vocabulary
goes on over it), so it is a common end. Texts are cut there, and a segment's groups and links are remembered (bounded). A text
that does not come together again from its segments is aligned in one piece.

*Counts.* The aligned texts are written once with their distinct links (sorted, as compressed differences). Pair counts are sums over that
table. They return to the documents as broadcast blocks of at most about `BLOCK` pairs, one pass over the written table for each
block, so memory does not grow with the number of pairs; passes give partial sums by document.

Defined results: a text that is null or empty, or whose token bytes are not space + text in either tokenizer, has zeros and '' as hash; a null doc_id stays a
row; repeated rows are documents of their own, in the counts too; no other column is read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, stored

#: Pairs of one broadcast block: 24 bytes each.
BLOCK = 2_000_000
#: Remembered segments of a Python worker, twice this many at most, each of at most so many characters.
REMEMBERED, LONGEST = 150_000, 40
#: New segments that are aligned as one text.
TOGETHER = 4096
#: Distinct links that are summed together before they leave a task.
CHUNK = 1 << 21

_SEGMENT = re.compile(r"\s+\S*(?:(?:\s\s+|[^\S \n]|\s\Z)\S*)*")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


# -- tokenizers -----------------------------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """Ids of space + text by a byte-level BPE file of the tokenizers library.

    `ranks`, the same vocabulary as a rank file, lets the faster library do it; a text that it refuses goes to the first one."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        byte, vocabulary = _byte_of(), self.tok.get_vocab(with_added_tokens=False)
        self.size = self.tok.get_vocab_size()
        self.bytes = [b""] * self.size
        for t, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            if all(self.bytes[i] == t for t, i in table.items()):
                self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and len(text) < 100_000:
            return self.fast.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a text by a sentencepiece model that puts a space before it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = pieces.index("▁") if "▁" in pieces else -1
        #: Segments may be encoded alone if no piece goes on over a space or a newline.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for i, p in enumerate(pieces) if not self.sp.is_byte(i))

    def ids(self, text: str) -> list[int]:
        return self.sp.encode(text)


# -- alignment ------------------------------------------------------------------------------------------------------


#: Written groups, link keys, number of tokens of each tokenizer.
Aligned = tuple[str, bytes, int, int]


def ends(ids: list[int], lengths: np.ndarray) -> dict[int, int]:
    """End of each token in bytes -> number of tokens up to it; of tokens without bytes the last one."""
    return dict(zip(np.cumsum(lengths[ids]).tolist(), range(1, len(ids) + 1))) if ids else {}


def groups(a: list[int], b: list[int], length_a: np.ndarray, length_b: np.ndarray) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """Both id lists cut where a token of each ends: that byte, the numbers of tokens up to it, and the ids since the last cut."""
    ends_a, ends_b = ends(a, length_a), ends(b, length_b)
    i = j = 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        p, q = ends_a[end], ends_b[end]
        yield end, p, q, a[i:p], b[j:q]
        i, j = p, q


def links(a: list[int], b: list[int], length_a: np.ndarray, length_b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of tokens of a group whose byte ranges overlap."""
    if len(a) == 1 or len(b) == 1:
        return [(x, y) for x in a if length_a[x] for y in b if length_b[y]]
    out, i, j, end_a, end_b = [], 0, 0, length_a[a[0]], length_b[b[0]]
    while True:
        if length_a[a[i]] and length_b[b[j]]:
            out.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
            if i == len(a):
                return out
            end_a += length_a[a[i]]
        if step_b:
            j += 1
            if j == len(b):
                return out
            end_b += length_b[b[j]]


class Aligner:
    """Groups, links and token numbers of whole texts."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        self.young: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def _cut(self, raw: bytes, a: list[int], b: list[int], at: list[int]) -> list[Aligned] | None:
        """Both ids of one text, aligned, in parts that end at the byte offsets `at`; None if either tokenizer has other bytes than the text."""
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        out, stops = [], iter(at)
        stop, first, written, keys, size = next(stops), (0, 0), [], [], self.b.size
        for end, i, j, x, y in groups(a, b, self.len_a, self.len_b):
            if len(x) == 1 == len(y):
                written.append(f"{x[0]}|{y[0]}")
                keys.append(x[0] * size + y[0])
            else:
                written.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                keys += [p * size + q for p, q in links(x, y, self.len_a, self.len_b)]
            if end == stop:
                out.append((";".join(written), struct.pack(f"<{len(keys)}q", *keys), i - first[0], j - first[1]))
                stop, first, written, keys = next(stops, None), (i, j), [], []
        return out if len(out) == len(at) else None

    def _ids_b(self, text: str) -> list[int]:
        """Ids of a text that starts with a space, which the tokenizer adds itself, or with a newline, before which its space is taken off."""
        if text[0] == " ":
            return self.b.ids(text[1:])
        ids = self.b.ids(text)
        return ids[1:] if ids and ids[0] == self.b.space else []

    def _learn(self, segments: list[str]) -> list[Aligned | None]:
        """Many segments as one text; where some segment has other bytes, in halves."""
        text = "".join(segments)
        raw = text.encode()
        at = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in segments]).tolist()
        found = self._cut(raw, self.a.ids(text), self._ids_b(text), at)
        if found or len(segments) == 1:
            return found or [None]
        half = len(segments) // 2
        return self._learn(segments[:half]) + self._learn(segments[half:])

    def _known(self, segments: list[str]) -> dict[str, Aligned | None]:
        """What is known of all segments, learned where it is new."""
        wanted = dict.fromkeys(segments)
        new = [s for s in wanted if s not in self.young]
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young, new = self.young, {}, list(wanted)
        fresh = []
        for s in new:
            if s in self.old:
                self.young[s] = self.old[s]
            elif s[0] in " \n" and len(s) > 1 and not s[1].isspace() and not s[-1].isspace():
                fresh.append(s)
            else:
                self.young[s] = self._learn([s])[0]
        for first in range(0, len(fresh), TOGETHER):
            some = fresh[first:first + TOGETHER]
            self.young.update(zip(some, self._learn(some)))
        return self.young

    def whole(self, text: str) -> Aligned | None:
        raw = (" " + text).encode()
        return (self._cut(raw, self.a.ids(" " + text), self.b.ids(text), [len(raw)]) or [None])[0]

    def texts(self, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes] | None]:
        """n_a, n_b, n_groups, n_links, hash of the groups, link keys of each text."""
        cut = [_SEGMENT.findall(" " + t) if self.b.cuts else [] for t in texts]
        known = self._known([s for parts in cut for s in parts])
        out = []
        for t, parts in zip(texts, cut):
            if not parts or sum(map(len, parts)) != len(t) + 1:
                some = [self.whole(t)]
            else:
                some = [known[s] for s in parts]
            if None in some:
                out.append(None)
                continue
            written, keys, n_a, n_b = zip(*some)
            text, key = ";".join(written), b"".join(keys)
            out.append((sum(n_a), sum(n_b), text.count("|"), len(key) // 8, hashlib.sha256(text.encode()).hexdigest(), key))
        for s in [s for s in dict.fromkeys(s for parts in cut for s in parts) if len(s) > LONGEST]:
            del known[s]
        return out


@functools.cache
def aligner(path_a: str, ranks: str | None, path_b: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(ByteLevel(path_a, ranks), Pieces(path_b))


# -- links of a document as bytes -----------------------------------------------------------------------------------


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences, and their numbers, byte plane by byte plane."""
    both = np.concatenate([np.diff(keys, prepend=0), n]).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.T).tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view("<i8").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _unpacked(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Batches in pieces with their links, about CHUNK links at a time."""
    for b in batches:
        raws, first, size, some = b.column(of).to_pylist(), 0, 0, []
        for k, raw in enumerate(raws):
            some.append(unpack(raw) if raw else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            size += len(some[-1][0])
            if size >= CHUNK or k == len(raws) - 1:
                yield b.slice(first, k + 1 - first), some
                first, size, some = k + 1, 0, []


# -- Spark ----------------------------------------------------------------------------------------------------------


def aligned(docs: DataFrame, path_a: str, ranks: str | None, path_b: str) -> DataFrame:
    """ALIGNED for each document."""

    def run(b):
        own = aligner(path_a, ranks, path_b)
        for first in range(0, b.num_rows, 256):
            part = b.slice(first, 256)
            texts = part.column(1).to_pylist()
            found = iter(own.texts([t for t in texts if t]))
            rows = [next(found) if t else None for t in texts]
            packed = []
            for r in rows:
                if r and r[3]:
                    keys, n = np.unique(np.frombuffer(r[5], np.int64), return_counts=True)
                    packed.append(pack(keys, n))
                else:
                    packed.append(None)
            rows = [r or (0, 0, 0, 0, "") for r in rows]
            columns = [pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(packed, pa.binary())], [c.split()[0] for c in ALIGNED.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ALIGNED)


def pair_counts(written: DataFrame, size_b: int) -> DataFrame:
    """key, n (documents that hold the pair linked), best (n is the highest of the pair's first id)."""

    def run(batches):
        for _, some in _unpacked(batches, 0):
            keys, n = np.unique(np.concatenate([k for k, _ in some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    pairs = written.filter("links IS NOT NULL").select("links").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("a", F.expr(f"key div {size_b}")), "pairs")
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    return pairs.join(top, "a").select("key", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def agreement(written: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, n_best, count_sum: the links of each document against the pair counts, a block of pairs at a time."""
    spark, n_blocks = written.sparkSession, max(1, -(-pairs.count() // block))
    pairs = stored(pairs.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))), "pair-blocks")
    passes = None
    for k in range(n_blocks):
        table = pairs.filter(F.col("block") == k).select("key", "n", "best").toArrow()
        columns = [table.column(c).to_numpy() for c in ("key", "n", "best")]
        order = np.argsort(columns[0])
        sent = spark.sparkContext.broadcast([c[order] for c in columns])

        def run(batches, sent=sent):
            known, counts, best = sent.value
            for b, some in _unpacked(batches, 1):
                keys, n = np.concatenate([k for k, _ in some]), np.concatenate([n for _, n in some])
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                n = np.where(known[at] == keys, n, 0) if len(known) else np.zeros(len(keys), np.int64)
                at = at if len(known) else np.zeros(0, np.int64)
                edge = np.concatenate([[0], np.cumsum([len(k) for k, _ in some])])
                sums = []
                for values in (best, counts):
                    total = np.concatenate([[0], np.cumsum(values[at] * n if len(known) else n)])
                    sums.append(pa.array(total[edge[1:]] - total[edge[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), *sums], ["row", "n_best", "count_sum"])

        found = written.filter("links IS NOT NULL").select("row", "links").mapInArrow(run, "row long, n_best long, count_sum long")
        passes = found if passes is None else passes.unionAll(found)
    return passes.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def report(docs: DataFrame, path_a: str | None = None, ranks: str | None = None, path_b: str | None = None, block: int = BLOCK) -> DataFrame:
    """Numbers, hash of the groups and agreement of every document."""
    if path_a is None:
        import public_tokenizers

        path_a, ranks, path_b = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    rows = aligned(docs, path_a, ranks, path_b).select(F.monotonically_increasing_id().alias("row"), "*")
    written = stored(rows, "aligned")
    sums = agreement(written, pair_counts(written, Pieces(path_b).size), block)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return written.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", count("n_best"), count("count_sum"), "groups_sha256")
