"""Token ids of whole texts in grammar-compressed shards.

Documents are sorted by doc_id over range partitions; each partition is written as rows of one shard each. A shard holds
about `SHARD_TOKENS` ids of consecutive documents (a longer document has a shard of its own) and its own Re-Pair grammar:
frequent pairs of ids become nonterminals again and again, never across the end of a document, until no pair occurs `LEAST_COUNT` times. A
round replaces the pairs at least half as frequent as the most frequent one. Symbols have 16 bits where a shard's fit, else 32. Stored are the rules, the
number of ids each nonterminal stands for, the symbols, and the first symbol of each document, so one document
decodes without the rest of its shard.

The container is Parquet written by Spark, so a lost task leaves nothing half done and any store will do.

Defined results: a null or empty text has the end id alone; null doc_ids come first; repeated rows are encoded one by one,
rows with the same doc_id in the order of their texts; no other column is read; an empty table gives no shards.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, parts, ready, slices, utf8
from yushi.session import work_dir

SHARD_TOKENS = 1 << 20
END_ID = 1
#: A rule takes two symbols and a length, so a pair saves space from four occurrences on.
LEAST_COUNT = 4
_CACHE, _CACHED_CHARS, _PIECE = 400_000, 40, 1 << 18
_RUNS = 1 << 20  # a power of two
_SPACES = b" \t\n\x0b\x0c\r"
_ASCII_SPACE = re.compile(r"[\t-\r ]+")

SHARD = "part int, seq int, first_doc long, last_doc long, n_docs long, n_tokens long, doc_ids binary, null_ids binary, doc_tokens binary, doc_symbols binary, rules binary, lengths binary, symbols binary"


# -- encoding -------------------------------------------------------------------------------------------------------


class Cache:
    """Ids of short strings: two generations of at most `_CACHE` entries, so what is frequent stays."""

    def __init__(self, learn):
        self.learn, self.young, self.old = learn, {}, {}

    def each(self, tokens: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        new = set(tokens).difference(young)
        if not new:
            return list(map(young.__getitem__, tokens))
        if len(young) + len(new) > _CACHE:
            self.old, old = young, young
            self.young = young = {}
            new = set(tokens)
        known = {w: old[w] for w in new if w in old}
        young.update(known)
        unknown = [w for w in new if w not in known]
        young.update(zip(unknown, self.learn(unknown)))
        out = list(map(young.__getitem__, tokens))
        for w in [w for w in unknown if len(w) > _CACHED_CHARS]:
            del young[w]
        return out

    def ids(self, tokens: list[str]) -> bytes:
        return b"".join(self.each(tokens))


class Runs:
    """Ids of runs of at most 16 bytes, all runs of some texts at a time.

    A run is looked up by its own bytes, padded with NULs to two numbers, so equal numbers are equal runs. At most about `_RUNS` are
    remembered; then those stay that were met again."""

    def __init__(self, learn):
        self.learn, self.used = learn, 0
        self._keep(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), _RUNS)

    def _keep(self, key: np.ndarray, n: np.ndarray, flat: np.ndarray, room: int) -> None:
        self.slot, self.used, self.flat_used = np.full(4 * room, -1, np.int32), 0, 0
        self.low, self.high, self.met = np.zeros(2 * room, np.uint64), np.zeros(2 * room, np.uint64), np.zeros(2 * room, bool)
        self.n, self.first, self.flat = np.zeros(2 * room, np.int64), np.zeros(2 * room, np.int64), np.zeros(4 * room, np.uint32)
        self._add(key, n, flat)

    def _places(self, key: np.ndarray) -> np.ndarray:
        mixed = (key[:, 0] ^ (key[:, 1] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(len(self.slot) - 1)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each run, -1 where it is not known."""
        out, at, todo = np.full(len(key), -1, np.int32), self._places(key), None
        while True:
            found = self.slot[at]
            own = key if todo is None else key[todo]
            same = (found >= 0) & (self.low[found] == own[:, 0]) & (self.high[found] == own[:, 1])
            if todo is None:
                np.copyto(out, found, where=same)
            else:
                out[todo[same]] = found[same]
            more = np.flatnonzero((found >= 0) & ~same)
            if not len(more):
                break
            todo = more if todo is None else todo[more]
            at = (at[more] + 1) & (len(self.slot) - 1)
        return out

    def behind(self, ids: np.ndarray) -> int:
        """Ids put behind those of the runs, until others are put there."""
        end = self.flat_used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.flat_used], np.zeros(max(len(ids), self.flat_used), np.uint32)])
        self.flat[self.flat_used:end] = ids
        return self.flat_used

    def _add(self, key: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        """Runs that are not known, each once."""
        end, flat_end = self.used + len(key), self.flat_used + len(flat)
        self.behind(flat)
        self.low[self.used:end], self.high[self.used:end], self.n[self.used:end] = key[:, 0], key[:, 1], n
        self.first[self.used:end] = self.flat_used + np.cumsum(n) - n
        number, at = np.arange(self.used, end, dtype=np.int32), self._places(key)
        self.used, self.flat_used = end, flat_end
        while len(number):
            free = self.slot[at] < 0
            self.slot[at[free]] = number[free]
            left = self.slot[at] != number
            number, at = number[left], (at[left] + 1) & (len(self.slot) - 1)

    def _make_room(self, new: int) -> None:
        """For so many runs: those met again stay, the latest half of what is remembered at most."""
        stay = np.flatnonzero(self.met[:self.used])[-(_RUNS // 2):]
        key, n = np.stack([self.low[stay], self.high[stay]], 1), self.n[stay]
        self._keep(key, n, spread(self.flat, self.first[stay], n), max(_RUNS, 1 << (len(stay) + new).bit_length()))

    def ids(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each run begin in `flat`, and how many there are."""
        found = self._find(key)
        new = np.flatnonzero(found < 0)
        if self.used + len(new) > _RUNS and len(new):
            self._make_room(len(key))
            found = self._find(key)
            new = np.flatnonzero(found < 0)
        self.met[found[found >= 0]] = True
        if len(new):
            order = new[np.lexsort((key[new, 0], key[new, 1]))]
            own = key[order]
            other = np.concatenate([[True], (own[1:] != own[:-1]).any(1)])
            had, unknown = self.used, own[other]
            flat, n = self.learn(unknown.view("S16").ravel().tolist())
            self._add(unknown, n, flat)
            found[order] = had + np.cumsum(other) - 1
        return self.first[found], self.n[found]


def spread(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of `flat`, given by start and length, one after the other."""
    ends = np.cumsum(n)
    return flat[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)]


class Encoder:
    """Ids of a whole text by the tokenizers library.

    This vocabulary splits a text into runs of letters, single digits and runs of other signs before anything else, and no token spans two of
    them; so the ids of a text are those of its runs, and ids of runs are remembered. The split is done here only for texts of
    ASCII and Latin-1 letters, where lower case and normal form are plain; in other texts the ids of whole words are remembered.
    Texts with a special token's string are encoded in one piece."""

    #: Latin-1 in lower case, and the bytes that a simple text has not
    LOWER, ODD = bytes(range(256)).decode("latin-1").lower().encode("latin-1"), bytes([0, *range(0x80, 0xC0)])
    #: 0 spaces, 1 letters, 2 digits, 3 other signs
    KINDS = np.array([0 if k in _SPACES else 1 if 97 <= k < 123 or 0xDF <= k != 0xF7 else 2 if 48 <= k < 58 else 3 for k in range(256)], np.uint8)
    BYTES = np.array([256**k - 1 for k in range(9)], np.uint64)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.runs, self.long, self.words = Runs(self._runs), Cache(self._long), Cache(self._words)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _runs(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many runs, and how many each has: its last id is one that ends a run."""
        texts = [b" ".join(new[k:k + 128]).decode("latin-1") for k in range(0, len(new), 128)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _long(self, new: list[bytes]) -> list[bytes]:
        ids, n = self._runs(new)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]

    def _words(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]

    def _simple(self, raw: bytes) -> bytes | None:
        """Latin-1 in lower case, if the text has none but ASCII and Latin-1 letters, and no NUL."""
        try:
            text = raw if raw.isascii() else raw.decode().encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.translate(self.LOWER, self.ODD)
        return low if len(low) == len(text) else None

    def _of_runs(self, texts: list[bytes]) -> list[bytes]:
        """Ids of simple texts."""
        text = np.frombuffer(b" ".join([*texts, b" " * 16]), np.uint8)
        kind = self.KINDS[text]
        begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 2)
        # 's 't 're 've 'm 'll 'd are runs where no other sign stands before them
        mark = np.flatnonzero((text == ord("'")) & begins)
        if len(mark):
            one, two = text[mark + 1], text[mark + 2]
            short = np.isin(one, list(b"stmd"))
            some = short | (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            begins[mark[some] + 1] = False
            begins[mark[some] + np.where(short[some], 2, 3)] = True
        edge = np.flatnonzero(begins)
        run = kind[edge[:-1]] != 0
        at, size = edge[:-1][run], np.diff(edge)[run]
        eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
        key = np.zeros((len(at), 2), np.uint64)
        key[:, 0] = eight[at] & self.BYTES[np.minimum(size, 8)]
        more = np.flatnonzero(size > 8)
        key[more, 1] = eight[at[more] + 8] & self.BYTES[np.minimum(size[more] - 8, 8)]
        long = np.flatnonzero(size > 16)
        key[long] = key[0] if len(key) else 0
        first, n = self.runs.ids(key)
        if len(long):
            own = self.long.each([text[a:a + k].tobytes() for a, k in zip(at[long].tolist(), size[long].tolist())])
            n[long] = [len(x) // 4 for x in own]
            first[long] = self.runs.behind(np.frombuffer(b"".join(own), np.uint32)) + np.cumsum(n[long]) - n[long]
        ids = spread(self.runs.flat, first, n)
        before = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in texts)]))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(before, before[1:])]

    def _ids(self, raw: bytes) -> bytes:
        text = raw.decode()
        if any(s in text for s in self.special):
            return self._encode(text).tobytes()
        low = self._simple(raw)
        return self._of_runs([low])[0] if low is not None else self.words.ids(_ASCII_SPACE.split(text))

    def ids(self, raw: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        out, at, n = [], 0, len(raw or b"")
        while at < n:
            end = min(n, at + _PIECE)
            while end < n and raw[end] not in _SPACES:
                end += 1
            out.append(self._ids(raw[at:end]))
            at = end
        return b"".join(out)

    def many(self, raws: list[bytes]) -> list[bytes]:
        """ids of each text; short simple texts go together."""
        out: list[bytes] = [b""] * len(raws)
        some: dict[int, bytes] = {}
        size = 0
        for k, r in enumerate(raws):
            low = None if len(r) > _PIECE or b"<|" in r else self._simple(r)
            if low is None:
                out[k] = self.ids(r)
                continue
            some[k] = low
            size += len(low) + 1
            if size > 4 * _PIECE or k == len(raws) - 1:
                for i, own in zip(some, self._of_runs(list(some.values()))):
                    out[i] = own
                some, size = {}, 0
        for i, own in zip(some, self._of_runs(list(some.values())) if some else []):
            out[i] = own
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker: what it remembers is good for the next task."""
    return Encoder(path)


# -- grammar --------------------------------------------------------------------------------------------------------


def _choose(often: np.ndarray, n: np.ndarray) -> list[int]:
    """Which of the frequent pairs (keys, counts) a round replaces; a symbol is on one side only, so occurrences never overlap."""
    side: dict[int, int] = {}
    out = []
    order = np.lexsort((often, -n))
    for k, key in zip(order.tolist(), often[order].tolist()):
        a, b = key >> 32, key & 0xFFFFFFFF
        if a == b:
            if a not in side:
                side[a] = 3
                out.append(k)
        elif side.setdefault(a, 1) == 1 and side.setdefault(b, 2) == 2:
            out.append(k)
    return out


class Pairs:
    """Pairs that occur `LEAST_COUNT` times or more, with their counts and places.

    Replacements change the pairs beside them only. What they make holds a new symbol, so no pair ever becomes more frequent,
    and one that is rare when it comes up is never looked at again. `pair` names the pair at a place, -1 one that is rare or gone."""

    def __init__(self, n: int):
        self.pair = np.full(n, -1, np.int32)
        self.key, self.n, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places, self.used = np.zeros(0, np.int32 if n < 1 << 31 else np.int64), 0

    def add(self, at: np.ndarray, key: np.ndarray, symbols: int) -> None:
        """The pairs that now stand at some places, each of two of so many symbols."""
        if len(self.pair) <= 1 << 24 and symbols <= 1 << 20:  # pair and place fit one number
            both = np.sort(((key >> np.uint64(32)) << np.uint64(44)) | ((key & np.uint64(0xFFFFFFFF)) << np.uint64(24)) | at.astype(np.uint64))
            key, at = ((both >> np.uint64(44)) << np.uint64(32)) | ((both >> np.uint64(24)) & np.uint64(0xFFFFF)), (both & np.uint64(0xFFFFFF)).astype(np.int32)
        else:
            order = np.argsort(key)
            key, at = key[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(edge, len(key)))
        often = n >= LEAST_COUNT
        stay = np.repeat(often, n)
        n, at, edge = n[often], at[stay], edge[often]
        self.pair[at] = np.repeat(np.arange(len(self.n), len(self.n) + len(n), dtype=np.int32), n)
        self.key, self.first = np.append(self.key, key[edge]), np.append(self.first, self.used + np.cumsum(n) - n)
        self.n = np.append(self.n, n)
        if self.used + len(at) > len(self.places):
            self.places = np.concatenate([self.places[:self.used], np.zeros(max(len(at), self.used), self.places.dtype)])
        self.places[self.used:self.used + len(at)] = at
        self.used += len(at)
        self.size = np.diff(np.append(self.first, self.used))

    def drop(self, at: np.ndarray) -> None:
        """Places, each once, whose pairs are no more."""
        old = self.pair[at]
        old = old[old >= 0]
        self.n -= np.bincount(old, minlength=len(self.n))
        self.pair[at] = -1

    def frequent(self) -> np.ndarray:
        return np.flatnonzero(self.n >= max(LEAST_COUNT, self.n.max(initial=0) // 2))

    def where(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of some pairs, and the pair's index in `pairs`."""
        n = self.size[pairs]
        k = np.repeat(np.arange(len(pairs)), n)
        at = self.places[np.repeat(self.first[pairs] - (np.cumsum(n) - n), n) + np.arange(len(k))]
        here = self.pair[at] == pairs[k]
        return at[here], k[here]


def repair(seq: np.ndarray, last: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs), symbols, and which symbol ends a document. Rule k is symbol terminals + k."""
    seq, last, n = seq.astype(np.uint32), last.copy(), len(seq)
    index = np.int32 if n < 1 << 31 else np.int64
    after, before = np.arange(1, n + 1, dtype=index), np.arange(-1, n - 1, dtype=index)
    alive, pairs, rules = np.ones(n, bool), Pairs(n), [np.zeros(0, np.uint64)]
    made = terminals

    def key(at):
        return (seq[at].astype(np.uint64) << np.uint64(32)) | seq[after[at]]

    inside = np.flatnonzero(~last[:-1]).astype(index)
    pairs.add(inside, key(inside), made)
    while True:
        often = pairs.frequent()
        chosen = often[_choose(pairs.key[often], pairs.n[often])]
        if not len(chosen):
            break
        at, k = pairs.where(chosen)
        order = np.argsort(at)
        at, k = at[order], k[order]
        gone = after[at]
        same = np.flatnonzero(seq[at] == seq[gone])
        if len(same):  # in a run of one symbol every second pair counts
            pos = at[same]
            new = np.concatenate([[True], (pos[1:] != gone[same[:-1]]) | (seq[pos[1:]] != seq[pos[:-1]])])
            rank = np.arange(len(pos))
            odd = (rank - np.maximum.accumulate(np.where(new, rank, 0))) % 2 == 1
            stay = np.ones(len(at), bool)
            stay[same[odd]] = False
            at, k, gone = at[stay], k[stay], gone[stay]
        left = before[at]
        # places in ascending order: what stands left of one is another's only if that is the one before
        other = left >= 0
        other[1:] &= left[1:] != gone[:-1]
        pairs.drop(np.concatenate([at, gone, left[other]]))
        seq[at], last[at], alive[gone] = made + k, last[gone], False
        follow = after[gone]
        after[at] = follow
        inner = follow < n
        before[follow[inner]] = at[inner]
        left = left[other]
        new = np.concatenate([at[~last[at]], left[~last[left]]])
        rules.append(pairs.key[chosen])
        made += len(chosen)
        pairs.add(new, key(new), made)
    keys = np.concatenate(rules)
    return np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), seq[alive], last[alive]


def width(terminals: int, n_rules: int) -> type:
    """The type of a shard's stored symbols."""
    return np.uint16 if terminals + n_rules <= 1 << 16 else np.uint32


class Grammar:
    """All expansions of a shard's symbols, one after the other."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        self.n = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
        self.at = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.flat = np.zeros(int(self.n.sum()), np.uint32)
        self.flat[:terminals] = np.arange(terminals, dtype=np.uint32)
        for first, stop in blocks(rules, terminals):
            at, n, sides = self.at[terminals + first], int(self.n[terminals + first:terminals + stop].sum()), rules[first:stop].ravel()
            self.flat[at:at + n] = spread(self.flat, self.at[sides], self.n[sides])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return spread(self.flat, self.at[symbols], self.n[symbols])


def blocks(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """First and end of stretches of rules that hold no symbol of their own stretch."""
    most, first = np.maximum.accumulate(rules.max(1, initial=0)), 0
    while first < len(rules):
        stop = int(np.searchsorted(most, terminals + first))
        yield first, stop
        first = stop


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    n = np.ones(terminals + len(rules), np.int64)
    for first, stop in blocks(rules, terminals):
        n[terminals + first:terminals + stop] = n[rules[first:stop]].sum(1)
    return n[terminals:].astype(np.uint32)


# -- shards ---------------------------------------------------------------------------------------------------------


def _shard(part: int, seq: int, ids: list[int | None], texts: list[bytes], terminals: int) -> dict:
    n = np.array([len(t) // 4 for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint32)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(n) - 1] = True
    rules, symbols, last = repair(flat, last, terminals)
    known, kind = [d for d in ids if d is not None], width(terminals, len(rules))
    return {
        "part": part, "seq": seq, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "n_docs": len(ids), "n_tokens": len(flat),
        "doc_ids": np.array([d or 0 for d in ids], np.int64).tobytes(), "null_ids": np.packbits([d is None for d in ids]).tobytes(),
        "doc_tokens": n.astype(np.uint32).tobytes(), "doc_symbols": np.diff(np.flatnonzero(last), prepend=-1).astype(np.uint32).tobytes(),
        "rules": rules.astype(kind).tobytes(), "lengths": rule_lengths(rules, terminals).tobytes(), "symbols": symbols.astype(kind).tobytes(),
    }


def shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per shard, in ascending (part, seq) and so in ascending doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = rows.repartitionByRange(parts(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        end = np.array([END_ID], np.uint32).tobytes()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for some in slices(b, 4 * _PIECE):
                for d, own in zip(some.column(0).to_pylist(), enc.many([t or b"" for t in utf8(some.column(1))])):
                    if ids and size + len(own) >= 4 * SHARD_TOKENS:
                        yield pa.RecordBatch.from_pylist([_shard(part, seq, ids, texts, enc.size)], schema=_arrow())
                        ids, texts, size, seq = [], [], 0, seq + 1
                    ids.append(d)
                    texts.append(own + end)
                    size += len(own) + 4
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, ids, texts, enc.size)], schema=_arrow())

    return placed.mapInArrow(run, SHARD)


@functools.cache
def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SHARD.split(", "))])


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    shards(docs, tokenizer).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def _decoded(row: dict, terminals: int, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Ids before the document in its shard, doc_id, ids. Symbols of documents that are not wanted are never expanded."""
    get = lambda k, t: np.frombuffer(row[k], t)
    lengths = get("lengths", np.uint32)
    kind = width(terminals, len(lengths))
    g = Grammar(get("rules", kind).reshape(-1, 2), lengths, terminals)
    symbols, n_sym, n_tok = get("symbols", kind), get("doc_symbols", np.uint32).astype(np.int64), get("doc_tokens", np.uint32).astype(np.int64)
    null = np.unpackbits(get("null_ids", np.uint8))[: row["n_docs"]].astype(bool)
    ends, before = np.cumsum(n_sym), np.cumsum(n_tok) - n_tok
    for i, d in enumerate(get("doc_ids", np.int64).tolist()):
        if wanted is None or (not null[i] and d in wanted):
            yield int(before[i]), None if null[i] else d, g.expand(symbols[ends[i] - n_sym[i]:ends[i]])


def _terminals(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def decode(stored: DataFrame, tokenizer: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids of all documents, or of some: only the shards whose range holds one are read."""
    rows = stored
    if doc_ids is not None:
        at = F.array(*[F.lit(d).cast("long") for d in doc_ids])
        rows = rows.filter(F.col("last_doc") >= min(doc_ids)).filter(F.col("first_doc") <= max(doc_ids)).filter(F.exists(at, lambda d: d.between(F.col("first_doc"), F.col("last_doc"))))
    terminals, wanted = _terminals(tokenizer), None if doc_ids is None else set(doc_ids)

    def run(b):
        for row in b.to_pylist():
            found = [(d, x) for _, d, x in _decoded(row, terminals, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(rows, run, "doc_id long, ids array<int>")


def starts(stored: DataFrame) -> DataFrame:
    """part, seq, start: ids before each shard. Sums by part meet in one task, one row a part; the rest stays within its part."""
    rows = stored.select("part", "seq", "n_tokens")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(by_part, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("start"))


def report(stored: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    terminals = _terminals(tokenizer)

    def run(b):
        for row in b.to_pylist():
            found = [(d, before, len(x), zlib.crc32(x.tobytes())) for before, d, x in _decoded(row, terminals)]
            cols = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(found), pa.int32()), pa.array([row["seq"]] * len(found), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)],
                ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"],
            )

    rows = arrow_map(stored, run, "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(starts(stored), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards to the shared folder, read them back, and report every document."""
    tokenizer = tokenizer or default_tokenizer()
    path = work_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return report(read(docs.sparkSession, path), tokenizer)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token shards of what is left, reported by document."""
    ready(spark)
    return encode_report(docs)
