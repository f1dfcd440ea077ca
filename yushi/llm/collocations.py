"""Collocations: phrases of two or three words that are frequent and stick together, per language.

*Candidates.* Level by level, as Apriori does it: a pair can be frequent only if both words are, a triple only if both its pairs are. What is
frequent so far goes out as a bitmap (at most `BITS` bits, whatever the corpus), so a position whose parts are surely rare sends nothing. What
remains is summed by the digests of its words; those that reach the least count form the next bitmap and, turned into words again, the candidates. Collisions
only let more through: no frequent phrase is missing.

*Counting.* Candidates are dealt by digest to shards of at most about `SHARD`, and each shard becomes a double-array trie over its own words: state s goes on by word w
to base[s] + w if check says so. The texts are read once: each piece looks its phrases up in a bitmap of the candidates and sends those that pass, with their words and once
per piece, to the task of their shard, which builds the trie. There numpy moves the states of all phrases that came one word on, level by level, and counts the accepting
ones with bincount. So a phrase meets one trie, however many there are.

*Texts.* All texts of an Arrow batch and language are split together, a few megabytes at a time, and written once as numbers of the piece's distinct words; a long
text goes on over pieces with its last two words.

Defined results: a null or empty text has no words; a null lang is `und`; repeated rows count each; doc_id and other columns are not read; an empty table gives no
rows. Texts without a phrase of ten occurrences give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yushi.llm.tables import parts, stored, utf8

LEAST, LONGEST, SHARE, FIRST = 10, 3, 50, 2000
#: Bits of a broadcast bitmap, at most; candidates of a trie; tries of a task, one after the other; bytes of text in one piece.
BITS, SHARD, TOGETHER, PIECE = 1 << 27, 1 << 17, 6, 3 << 20
#: Pieces' worth of phrases in one bucket of sums.
BUCKET = 8
RADIX = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_CUT = b"."


# -- texts ----------------------------------------------------------------------------------------------------------


class Piece(NamedTuple):
    """Words of one language: the distinct ones, the place of each in them (-1 is a cut), and how many at the front were counted already."""

    lang: str
    words: list[bytes]
    at: np.ndarray
    seen: int


def _piece(lang: str, text: bytes, seen: int) -> Piece:
    """Words and dots between single or more blanks; Arrow numbers the different ones."""
    tokens = pc.split_pattern(pa.array([text], pa.large_binary()), b" ").flatten().dictionary_encode()
    known, at = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
    number = np.full(len(known), -1, np.int64)
    some = [k for k, w in enumerate(known) if w not in (b"", _CUT)]
    number[some] = np.arange(len(some))
    there = np.array([w != b"" for w in known])
    return Piece(lang, [known[k] for k in some], number[at[there[at]]], seen)


def _split(lang: str, text: bytes, size: int) -> Iterator[Piece]:
    """Words of a text that is lower-cased and has dots for all cuts."""
    at, n, last = 0, len(text), []
    while at < n:
        end = min(n, at + size)
        while end < n and text[end] not in b" .":
            end += 1
        p = _piece(lang, b" ".join([*last, text[at:end].replace(_CUT, b" . ")]), len(last))
        yield p
        last, at = [p.words[k] if k >= 0 else _CUT for k in p.at[-(LONGEST - 1):].tolist()], end


def pieces(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[Piece]:
    """All texts (lang, text) by language, about `size` bytes at a time."""
    for b in batches:
        texts, langs = utf8(b.column(1)), b.column(0).to_pylist()
        by_lang: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, t in zip(langs, texts):
            if t:
                by_lang.setdefault(lang, []).append(t)
                sizes[lang] = sizes.get(lang, 0) + len(t)
                if sizes[lang] >= size:
                    yield from _split(lang, b"\n".join(by_lang.pop(lang)).translate(_LOWER), size)
                    del sizes[lang]
        for lang, some in by_lang.items():
            yield from _split(lang, b"\n".join(some).translate(_LOWER), size)


PIECES = "lang string, seen int, words binary, at binary"


def written_pieces(docs: DataFrame) -> DataFrame:
    """The texts as pieces, split once and written: every later pass reads numbers."""
    rows, size = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"), PIECE

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for p in pieces(batches, size):
            row = [[p.lang], [p.seen], [z.compress(b" ".join(p.words))], [z.compress(p.at.astype(np.int32).tobytes())]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["lang", "seen", "words", "at"])

    return stored(rows.mapInArrow(run, PIECES), "pieces")


def over_pieces(written: DataFrame, fn: Callable[[Iterator[Piece]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def found(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(b.num_rows):
                lang, seen, words, at = (b.column(i)[k].as_py() for i in range(4))
                words = z.decompress(words)
                yield Piece(lang, words.split(b" ") if words else [], np.frombuffer(z.decompress(at), np.int32).astype(np.int64), seen)

    return written.mapInArrow(lambda batches: fn(found(batches)), schema)


def _counted(p: Piece) -> np.ndarray:
    """Occurrences of each distinct word, without those of the piece before."""
    at = p.at[p.seen:]
    return np.bincount(at[at >= 0], minlength=len(p.words))


def _digests(p: Piece) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(p.lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in p.words), np.uint64, len(p.words))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digest of a phrase from those of its front and its next word."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# -- candidates -----------------------------------------------------------------------------------------------------


class Bitmap(NamedTuple):
    """Digests that may be frequent, three bits for each. Full or not, it never leaves one out."""

    words: np.ndarray

    @staticmethod
    def places(digests: np.ndarray, size: int) -> list[np.ndarray]:
        return [(digests * np.uint64(k) >> np.uint64(34)) & np.uint64(size - 1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def has(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for at in self.places(digests, 64 * len(self.words)):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bitmap(frequent: DataFrame, bits: int = BITS) -> Bitmap:
    """Bitmap of phrases given by the digests of their words (d1, d2, …): as many rows reach the driver as the bitmap has words, at most."""
    size, wanted, names = 64, 32 * frequent.count(), [c for c in frequent.columns if c.startswith("d")]
    while size < min(bits, wanted):
        size *= 2

    def run(batches):
        for b in batches:
            digest = b.column(0).to_numpy().view(np.uint64)
            for k in range(1, len(names)):
                digest = _joined(digest, b.column(k).to_numpy().view(np.uint64))
            at = np.unique(np.concatenate(Bitmap.places(digest, size)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bit = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bit.view(np.int64))], ["at", "bit"])

    rows = frequent.select(*names).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return Bitmap(words)


def word_counts(written: DataFrame) -> DataFrame:
    """lang, word, f of all words."""

    def run(found):
        for p in found:
            n = _counted(p)
            some = np.flatnonzero(n)
            words = pa.array(p.words, pa.binary()).take(pa.array(some)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([p.lang] * len(some), pa.string()), words, pa.array(n[some])], ["lang", "word", "f"])

    return over_pieces(written, run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def with_digest(words: DataFrame) -> DataFrame:
    """lang, word, f and the word's digest d1, as tasks compute it."""

    def run(batches):
        for b in batches:
            d = [xxhash.xxh64_intdigest(w, xxhash.xxh64_intdigest(lang)) for lang, w in zip(utf8(b.column(0)), utf8(b.column(1)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(d, np.uint64).view(np.int64))], ["lang", "word", "f", "d1"])

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word string, f long, d1 long")


def _steps(p: Piece, d: np.ndarray, maps: list[Bitmap]) -> np.ndarray:
    """Where phrases of len(maps) + 1 words start whose parts of k words all pass maps[k - 1]; d are the digests of the piece's words."""
    alive = np.flatnonzero(p.at >= 0)
    digest = d[p.at[alive]]
    for k, m in enumerate(maps, 1):
        may = m.has(digest)
        starts = np.zeros(len(p.at) + 1, bool)
        starts[alive[may]] = True
        on = may & starts[np.minimum(alive + 1, len(p.at))]
        alive, digest = alive[on], digest[on]
        digest = _joined(digest, d[p.at[alive + k]])
    return alive


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each is there."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _packed(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of x from edge to edge."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _of(key: np.ndarray, n: int) -> np.ndarray:
    """Which of n shards or buckets digests belong to."""
    return ((key >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _added_up(words: np.ndarray, f: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of words whose f come to `least`, and these sums."""
    key = words[0]
    for more in words[1:]:
        key = _joined(key, more)
    order = np.argsort(key, kind="stable")
    words, f, key = words[:, order], f[order], key[order]
    same = key[1:] == key[:-1]
    if (words[:, 1:] != words[:, :-1])[:, same].any():  # two phrases with one digest
        order = np.lexsort(words)
        words, f = words[:, order], f[order]
        same = (words[:, 1:] == words[:, :-1]).all(axis=0)
    first = np.flatnonzero(np.append(True, ~same)) if len(f) else np.zeros(0, np.int64)
    total = np.add.reduceat(f, first) if len(f) else f
    some = total >= least
    return words[:, first[some]], total[some]


def phrase_keys(written: DataFrame, maps: list[Bitmap], least: int = 1) -> DataFrame:
    """d1, d2, …, f: the digests of the words of all phrases of len(maps) + 1 words whose parts may be frequent, if f reaches `least`; f is never below a phrase's count.

    A piece sends the phrases of a bucket as one row of packed digests, and a bucket has what `BUCKET` pieces send: its sums are array arithmetic."""
    sent, n = written.sparkSession.sparkContext.broadcast([m.words for m in maps]), len(maps) + 1
    names, buckets = [f"d{k + 1}" for k in range(n)], max(parts(written), -(-written.count() // BUCKET))

    def run(found):
        use = [Bitmap(w) for w in sent.value]
        for p in found:
            d = _digests(p)
            alive = _steps(p, d, use) if len(d) else np.zeros(0, np.int64)
            alive = alive[alive + n > p.seen]
            if not len(alive):
                continue
            key, size = p.at[alive], len(p.words)  # a piece has under 2^21 distinct words
            for k in range(1, n):
                key = key * size + p.at[alive + k]
            key, f = _distinct(key)
            words = np.stack([d[key // size ** k % size] for k in range(n - 1, -1, -1)])
            digest = words[0]
            for more in words[1:]:
                digest = _joined(digest, more)
            bucket = _of(digest, buckets)
            order = np.argsort(bucket, kind="stable")
            own, count = np.unique(bucket, return_counts=True)
            edges = np.append(0, np.cumsum(count))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(_packed(x[order], edges) for x in words), _packed(f[order].astype(np.int32), edges)], ["bucket", *names, "f"])

    def added(batches):
        last, rows = -1, []

        def done():
            if rows:
                words = np.stack([np.frombuffer(b"".join(x for r in rows for x in r[k].to_pylist()), np.uint64) for k in range(n)])
                words, f = _added_up(words, np.frombuffer(b"".join(x for r in rows for x in r[n].to_pylist()), np.int32).astype(np.int64), least)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in words), pa.array(f)], [*names, "f"])

        for b in batches:
            bucket = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for first, end in zip([0, *edges], [*edges, b.num_rows]):
                if first < end:
                    if bucket[first] != last:
                        yield from done()
                        last, rows = bucket[first], []
                    rows.append(b.slice(first, end - first).columns[1:])
        yield from done()

    packed = over_pieces(written, run, "bucket int, " + ", ".join(f"{c} binary" for c in [*names, "f"]))
    return packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(added, ", ".join(f"{c} long" for c in [*names, "f"]))


def candidates(written: DataFrame, words: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, phrase: every phrase of two or three words that may be frequent, once.

    Digests turn into words again by joins with the frequent words; where two words of a language share a digest, both phrases are candidates."""
    known = stored(with_digest(words), "word-digests")
    maps, out = [bitmap(known, bits)], None
    for n in range(2, LONGEST + 1):
        keys = stored(phrase_keys(written, maps, least).drop("f"), "phrase-keys")
        if n < LONGEST:
            maps.append(bitmap(keys, bits))
        named = keys
        for k in range(1, n + 1):
            own = known.select(F.col("d1").alias(f"d{k}"), F.col("lang"), F.col("word").alias(f"w{k}"))
            named = named.join(own, [f"d{k}"] if k == 1 else [f"d{k}", "lang"])
        named = named.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(1, n + 1)]).alias("phrase"))
        out = named if out is None else out.unionAll(named)
    return out.distinct()


# -- tries ----------------------------------------------------------------------------------------------------------


class Trie(NamedTuple):
    """A double array: state s goes on by symbol c to base[s] + c if check of that place is s. State 0 is the root.

    A word is its number in `words` as digits of RADIX, the highest first, so a state has few children and they lie close together."""

    words: list
    base: np.ndarray
    check: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        to = self.base[state] + symbol
        to[(to < 0) | (to >= len(self.check))] = 0
        return np.where(self.check[to] == state, to, -1)

    def digits(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:, None] // RADIX ** np.arange(depth(len(self.words)) - 1, -1, -1) % RADIX

    def word(self, state: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """The states a whole word further."""
        at = np.arange(len(state))
        for symbol in digits.T:
            state = self.step(state, symbol[at])
            at, state = at[state >= 0], state[state >= 0]
        out = np.full(len(digits), -1)
        out[at] = state
        return out


def depth(n_words: int) -> int:
    """Digits of a word."""
    return max(1, int(np.ceil(np.log(max(n_words, 2)) / np.log(RADIX) - 1e-12)))


def _edges(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node of each row of symbols (-1 fills up), and the parent, symbol and node of every edge; node 0 is the root."""
    node, n = np.zeros(len(symbols), np.int64), 1
    edges = []
    for column in symbols.T:
        on = np.flatnonzero(column >= 0)
        key, place = np.unique(node[on] * RADIX + column[on], return_inverse=True)
        node[on] = n + place
        edges.append((key // RADIX, key % RADIX, n + np.arange(len(key))))
        n += len(key)
    return node, *(np.concatenate(x) for x in zip(*edges))


def build(phrases: list[list[str]]) -> tuple[Trie, np.ndarray]:
    """The trie of phrases, and the state of each. A phrase's first word is its language.

    Nodes with many children are placed first, where all their children find free places; single children fill what is left."""
    words = sorted({w for p in phrases for w in p})
    number, d = {w: k for k, w in enumerate(words)}, depth(len(words))
    empty = Trie(words, np.zeros(1, np.int32), np.full(1, -1, np.int32))
    rows = np.full((len(phrases), max(map(len, phrases))), -1, np.int64)
    for k, p in enumerate(phrases):
        rows[k, :len(p)] = [number[w] for w in p]
    symbols = np.where(rows[:, :, None] >= 0, empty.digits(np.maximum(rows, 0).ravel()).reshape(*rows.shape, d), -1)
    node, parent, symbol, child = _edges(symbols.reshape(len(phrases), -1))
    order = np.lexsort((symbol, parent))
    parent, symbol, child = parent[order], symbol[order], child[order]
    owner, first, n = np.unique(parent, return_index=True, return_counts=True)
    free = np.ones(2 * (len(parent) + RADIX), bool)
    free[0] = False
    to = np.zeros(len(parent), np.int64)
    low = 1
    for k in np.flatnonzero(n > 1)[np.argsort(-n[n > 1], kind="stable")].tolist():
        own = slice(first[k], first[k] + n[k])
        reach = symbol[own] - symbol[first[k]]
        while not free[low]:
            low += 1
        start, tries = low, 0
        while not free[start + reach].all():
            start, tries = start + 1, tries + 1
        free[start + reach] = False
        to[own] = start + reach
        if tries > 64:  # what lies before is crowded: left to the single children
            low = start
    single = first[n == 1]
    to[single] = np.flatnonzero(free)[:len(single)]
    size = int(to.max()) + 1
    place, base, check = np.zeros(len(parent) + 1, np.int64), np.zeros(size, np.int32), np.full(size, -1, np.int32)
    place[child] = to
    base[place[owner]] = to[first] - symbol[first]
    check[to] = place[parent]
    return Trie(words, base, check), place[node]


#: Rows on their way to a shard: a candidate (kind 0, its phrase in words) or phrases seen in a piece (kind 1: their words by lines, the numbers of the
#: first, second and third words in these, and how often each phrase was seen).
TO_SHARD, ROW, NONE = "shard int, kind int, lang string, words binary, a binary, b binary, c binary, f binary", 20_000, 65_535


def _language(lang: str) -> str:
    """A language as the first word of its phrases; no word of a text has a space."""
    return " " + lang.encode().hex()


def with_key(found: DataFrame) -> DataFrame:
    """lang, phrase and d1, the digest that a phrase has in the texts."""

    def run(batches):
        for b in batches:
            langs, phrases = utf8(b.column(0)), [p.split(b" ") for p in utf8(b.column(1))]
            seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in set(langs)}
            d = np.zeros((LONGEST, len(phrases)), np.uint64)
            for k in range(LONGEST):
                d[k] = [xxhash.xxh64_intdigest(p[k], seeds[lang]) if k < len(p) else 0 for lang, p in zip(langs, phrases)]
            n, key = np.array([len(p) for p in phrases], np.int64), d[0]
            for k in range(1, LONGEST):
                key = np.where(n > k, _joined(key, d[k]), key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], ["lang", "phrase", "d1"])

    return found.select("lang", "phrase").mapInArrow(run, "lang string, phrase string, d1 long")


def _seen(p: Piece, d: np.ndarray, may: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different phrases of a piece that may be candidates: their words (three rows, -1 fills up), how often they stand there, and their digests."""
    at, size = p.at, len(p.words)
    on = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    key = _joined(d[at[on]], d[at[on + 1]])
    some = may.has(key)
    on, key = on[some], key[some]
    starts = np.zeros(len(at), bool)
    starts[on] = True
    pairs, n = _distinct((at[on] * size + at[on + 1])[on + 2 > p.seen])
    longer = starts[on + 1]
    on, key = on[longer], key[longer]
    on = on[may.has(_joined(key, d[at[on + 2]])) & (on + 3 > p.seen)]
    triples, m = _distinct((at[on] * size + at[on + 1]) * size + at[on + 2])  # a piece has under 2^21 distinct words
    ends = np.concatenate([np.full(len(pairs), -1), triples % size])
    pairs = np.concatenate([pairs, triples // size])
    words = np.stack([pairs // size, pairs % size, ends])
    key = _joined(d[words[0]], d[words[1]])
    return words, np.concatenate([n, m]), np.where(ends < 0, key, _joined(key, d[ends]))


def _rows(p: Piece, words: np.ndarray, f: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Phrases of a piece as rows for their shards, at most `ROW` in one, so that their words have numbers of 16 bits."""
    order = np.argsort(shard, kind="stable")
    words, f, shard = words[:, order], f[order], shard[order]
    new = np.append(True, shard[1:] != shard[:-1])
    place = np.arange(len(shard)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(new | (place % ROW == 0))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(shard))))
    size, there = len(p.words), words >= 0
    own, number = np.unique((row * size + words)[there], return_inverse=True)
    start = np.searchsorted(own, np.arange(len(first) + 1) * size)
    numbers = np.full(words.shape, NONE, np.uint16)
    numbers[there] = number - start[np.broadcast_to(row, words.shape)[there]]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(p.words, pa.binary()).take(pa.array(own % size))), b"\n")
    edges = np.append(first, len(shard))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[first].astype(np.int32)), pa.array(np.ones(len(first), np.int32)), pa.array([p.lang] * len(first), pa.string()), texts, *(_packed(x, edges) for x in numbers), _packed(f.astype(np.int32), edges)],
        ["shard", "kind", "lang", "words", "a", "b", "c", "f"])


def sightings(written: DataFrame, may: Bitmap, shards: int) -> DataFrame:
    """What the texts have of the candidates, for the shards: each piece sends a phrase once."""
    sent = written.sparkSession.sparkContext.broadcast(may.words)

    def run(found):
        use = Bitmap(sent.value)
        for p in found:
            if p.words:
                words, f, key = _seen(p, _digests(p), use)
                if len(f):
                    yield _rows(p, words, f, _of(key, shards))

    return over_pieces(written, run, TO_SHARD)


def candidate_rows(keyed: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for b in batches:
            shard = _of(b.column(2).to_numpy().view(np.uint64), shards)
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), b.column(1).cast(pa.binary()), none, none, none, none],
                                             ["shard", "kind", "lang", "words", "a", "b", "c", "f"])

    return keyed.select("lang", "phrase", "d1").mapInArrow(run, TO_SHARD)


class Shard:
    """The candidates of one shard, their trie once all are there, and how often its states were reached."""

    def __init__(self):
        self.langs, self.phrases, self.trie = [], [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.langs += rows.column(2).to_pylist()
        self.phrases += rows.column(3).cast(pa.string()).to_pylist()

    def build(self) -> None:
        self.trie, self.states = build([[_language(lang), *p.split(" ")] for lang, p in zip(self.langs, self.phrases)])
        self.known = pa.array([w.encode() for w in self.trie.words], pa.binary())
        self.total = np.zeros(len(self.trie.check), np.int64)

    def count(self, rows: pa.RecordBatch) -> None:
        if not self.phrases:
            return
        if self.trie is None:
            self.build()
        langs = pc.index_in(pa.array([_language(x).encode() for x in rows.column(2).to_pylist()], pa.binary()), value_set=self.known)
        words = pc.split_pattern(rows.column(3), b"\n")
        ends = words.offsets.to_numpy()
        numbers = pc.index_in(words.flatten(), value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        phrases = [np.frombuffer(b"".join(rows.column(k).to_pylist()), np.uint16).astype(np.int64) for k in (4, 5, 6)]
        f = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.int32)
        at = np.repeat(ends[:-1].astype(np.int64), pc.binary_length(rows.column(4)).to_numpy() // 2)
        _count(self.trie, numbers, np.repeat(langs.fill_null(-1).to_numpy().astype(np.int64), np.diff(ends)), [np.where(x == NONE, -1, at + x) for x in phrases], f, self.total)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.trie is not None:
            a = self.total[self.states]
            some = pa.array(np.flatnonzero(a))
            yield pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(some), pa.array(self.phrases, pa.string()).take(some), pa.array(a).take(some)], ["lang", "phrase", "a"])


def _count(trie: Trie, known: np.ndarray, lang: np.ndarray, phrases: list[np.ndarray], f: np.ndarray, total: np.ndarray) -> None:
    """Adds f to the states of phrases: all of them take the steps of their words at once, the first word's once per word of a row.

    `known` numbers the words in the trie, `lang` the languages of these words; -1 stands for those it hasn't. Phrases are places in `known`, -1 fills up."""
    digits, first = trie.digits(np.maximum(known, 0)), np.full(len(known), -1)
    some = np.flatnonzero((known >= 0) & (lang >= 0))
    root = trie.word(np.zeros(len(some), np.int64), trie.digits(lang[some]))
    some, root = some[root >= 0], root[root >= 0]
    first[some] = trie.word(root, digits[some])
    at = np.arange(len(f))
    state = first[phrases[0]]
    for k in range(1, LONGEST):
        word = phrases[k][at]
        on = (state >= 0) & (word >= 0)
        on[on] = known[word[on]] >= 0
        at, state = at[on], state[on]
        state = trie.word(state, digits[word[on]])
        ends = state >= 0
        if k + 1 < LONGEST:
            ends &= phrases[k + 1][at] < 0
        total += np.bincount(state[ends], f[at[ends]], len(total)).astype(np.int64)


def counts(rows: DataFrame, tasks: int) -> DataFrame:
    """lang, phrase, a of all candidates that occur, from candidates and sightings. A task has one trie at a time; each row is read by the task of its shard only."""

    def run(batches):
        last, own = -1, Shard()
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(shard * 2 + kind)) + 1
            for first, end in zip([0, *edges], [*edges, b.num_rows]):
                if first < end and shard[first] != last:
                    yield from own.found()
                    last, own = shard[first], Shard()
                if first < end:
                    (own.count if kind[first] else own.add)(b.slice(first, end - first))
        yield from own.found()

    dealt = rows.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "lang string, phrase string, a long")


def phrase_counts(written: DataFrame, found: DataFrame, shard: int = SHARD, together: int = TOGETHER, bits: int = BITS) -> DataFrame:
    """lang, phrase, a of all candidates that occur."""
    keyed = stored(with_key(found), "candidate-keys")
    least = -(-keyed.count() // shard)
    tasks = max(parts(found), -(-least // together))
    shards = max(tasks, least)
    return counts(candidate_rows(keyed, shards).unionAll(sightings(written, bitmap(keyed.select("d1"), bits), shards)), tasks)


# -- scores ---------------------------------------------------------------------------------------------------------


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")


def ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, first: int = FIRST, share: int = SHARE) -> DataFrame:
    """The best phrases of each language from the counts of phrases (lang, phrase, a), words (lang, word, f) and languages (lang, n)."""
    w = F.split("phrase", " ", -1)
    n = F.size(w)
    pairs = phrases.filter(n == 2).select("lang", "phrase", "a", w[0].alias("w1"), w[1].alias("w2"))
    triples = phrases.filter(n == 3).select("lang", "phrase", "a", w[0].alias("w1"), w[2].alias("w3"), F.concat_ws(" ", w[0], w[1]).alias("p12"), F.concat_ws(" ", w[1], w[2]).alias("p23"))
    named = lambda df, key, f: df.select("lang", F.col(df.columns[1]).alias(key), F.col(df.columns[2]).alias(f))
    pair_f = phrases.filter(n == 2).select("lang", "phrase", "a")
    scored2 = pairs.join(named(words, "w1", "l"), ["lang", "w1"]).join(named(words, "w2", "r"), ["lang", "w2"]).select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
    cut3 = (
        triples.join(named(words, "w1", "l1"), ["lang", "w1"]).join(named(words, "w3", "r2"), ["lang", "w3"])
        .join(named(pair_f, "p23", "r1"), ["lang", "p23"]).join(named(pair_f, "p12", "l2"), ["lang", "p12"])
    )
    best = F.least(
        F.struct(_score("a", "l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")),
        F.struct(_score("a", "l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")),
    )
    scored3 = cut3.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # a pair goes if a triple around it has at least `share` percent of its count
    around = triples.select("lang", F.explode(F.array("p12", "p23")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept2 = scored2.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept2.unionByName(scored3).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame, least: int = LEAST, first: int = FIRST, bits: int = BITS, shard: int = SHARD, together: int = TOGETHER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best collocations of each language."""
    written = written_pieces(docs)
    words = stored(word_counts(written), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = stored(words.filter(F.col("f") >= least), "frequent-words")
    found = stored(candidates(written, frequent, least, bits).repartition(parts(docs)), "candidates")
    phrases = stored(phrase_counts(written, found, shard, together, bits).filter(F.col("a") >= least), "phrases")
    return ranked(phrases, frequent, totals, first)
