"""Reversible line deduplication: exact reference counts, with sharded cuckoo filters in front of them.

`counts` holds, for each line key, how many documents have it and the largest doc_id that does. Batches of documents are
added and removed by merging counts; a key whose count reaches 0 leaves the table, and its fingerprint leaves the filter.
The filters hold the keys to act on. A line that no filter knows is never shuffled; a line that a filter knows is joined
with the exact table, so false positives of the filters change nothing.

Filters are sent to the tasks only as far as `FILTER_BYTES` goes: the shards are probed in rounds of at most that size.

Defined results: a null or empty text is one empty line; a key under 20 code points is never dropped; each row of the input is a
document, so rows with the same doc_id count apart and all of them keep a line whose largest holder is that doc_id;
a null doc_id counts as a holder but is below every other id; documents with a null id keep a line only if no other id has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, packed, stored, utf8

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS, FILTER_BYTES = 1 << 16, 64 << 20
SLOTS, KICKS = 4, 500


# -- keys -----------------------------------------------------------------------------------------------------------


def keys_of(text: bytes | None) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        long = len(key) >= LEAST_CHARS and (len(key) >= 4 * LEAST_CHARS or len(key.decode()) >= LEAST_CHARS)
        out.append(key if long else None)
    return out


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(a[:, 1])


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2: each distinct key of each document (row), as 128 bits."""

    def run(b):
        ids, keys = [], []
        for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            own = {_digest(k) for k in keys_of(t) if k is not None}
            keys += own
            ids += [d] * len(own)
        k1, k2 = _longs(keys)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k1), pa.array(k2)], ["doc_id", "k1", "k2"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, k1 long, k2 long")


# -- exact counts ---------------------------------------------------------------------------------------------------


def count_lines(docs: DataFrame) -> DataFrame:
    """k1, k2, n_docs, max_doc. Counts are combined before the shuffle, so a line that is in every document is no hot key."""
    return line_keys(docs).groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def holders(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n: the exact reference table that deletions need (which documents hold a line)."""
    return line_keys(docs).groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n"))


def add(table: DataFrame, more: DataFrame) -> DataFrame:
    """The reference table with another batch."""
    return table.unionByName(more).groupBy("k1", "k2", "doc_id").agg(F.sum("n").alias("n"))


def remove(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The reference table without the documents of a batch; what reaches 0 leaves."""
    rows = table.unionByName(gone.withColumn("n", -F.col("n")))
    return rows.groupBy("k1", "k2", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0")


def counts_of(table: DataFrame) -> DataFrame:
    return table.groupBy("k1", "k2").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("max_doc"))


# -- cuckoo filters -------------------------------------------------------------------------------------------------


class Cuckoo:
    """Buckets of four 16-bit fingerprints; partial-key hashing, so an entry can be moved and deleted without its key."""

    def __init__(self, n_buckets: int, cells: np.ndarray | None = None):
        self.n = n_buckets
        self.cells = np.zeros((n_buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def holding(cls, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        """A filter with all keys; it grows until they fit."""
        n = 1
        while n * SLOTS * 0.9 < max(1, len(k1)):
            n *= 2
        while True:
            f = cls(n)
            if all(f.insert(a, b) for a, b in zip(k1.tolist(), k2.tolist())):
                return f
            n *= 2

    @staticmethod
    def prints(k2: np.ndarray) -> np.ndarray:
        p = (k2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        return np.where(p == 0, np.uint16(1), p)

    def _other(self, i, p):
        return (i ^ (p * 0x5BD1)) & (self.n - 1)

    def _places(self, k1: int, k2: int) -> tuple[int, int, int]:
        p = (k2 & 0xFFFF) or 1
        i = k1 & (self.n - 1)
        return p, i, self._other(i, p)

    def insert(self, k1: int, k2: int) -> bool:
        p, i, j = self._places(k1, k2)
        for x in (i, j):
            free = np.flatnonzero(self.cells[x] == 0)
            if len(free):
                self.cells[x, free[0]] = p
                return True
        for kick in range(KICKS):
            slot = (p + kick) % SLOTS
            p, self.cells[i, slot] = int(self.cells[i, slot]), p
            i = self._other(i, p)
            free = np.flatnonzero(self.cells[i] == 0)
            if len(free):
                self.cells[i, free[0]] = p
                return True
        return False

    def delete(self, k1: int, k2: int) -> bool:
        p, i, j = self._places(k1, k2)
        for x in (i, j):
            at = np.flatnonzero(self.cells[x] == p)
            if len(at):
                self.cells[x, at[0]] = 0
                return True
        return False

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        p = self.prints(k2)
        i = (k1.view(np.uint64) & np.uint64(self.n - 1)).astype(np.int64)
        j = self._other(i, p.astype(np.int64))
        return (self.cells[i] == p[:, None]).any(1) | (self.cells[j] == p[:, None]).any(1)


def _shard(n_shards: int):
    return F.pmod(F.shiftright("k1", 20), F.lit(n_shards)).cast("int")


def filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """shard, n_buckets, cells: one cuckoo filter per shard, built in one task per group of shards."""

    def build(key, rows):
        f = Cuckoo.holding(rows["k1"].to_numpy(), rows["k2"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_buckets": pa.array([f.n], pa.int64()), "cells": [f.cells.tobytes()]})

    return keys.select(_shard(n_shards).alias("shard"), "k1", "k2").groupBy("shard").applyInArrow(build, "shard int, n_buckets long, cells binary")


def update(family: DataFrame, keys: DataFrame, new: DataFrame, gone: DataFrame, n_shards: int) -> DataFrame:
    """The filters after some keys came and others went (each key once). A shard that runs over is built anew from `keys`,
    the exact keys after the change: an insertion that finds no place has moved other entries out already."""
    s = _shard(n_shards).alias("shard")
    changes = new.select(s, "k1", "k2", F.lit(True).alias("come")).unionByName(gone.select(s, "k1", "k2", F.lit(False).alias("come")))

    def change(key, old, rows):
        shard = (old if old.num_rows else rows)["shard"][0].as_py()
        come = rows["come"].to_numpy(zero_copy_only=False).astype(bool)
        k1, k2 = rows["k1"].to_numpy(), rows["k2"].to_numpy()
        if old.num_rows:
            cells = np.frombuffer(old["cells"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy()
            f = Cuckoo(old["n_buckets"][0].as_py(), cells)
            for a, b in zip(k1[~come].tolist(), k2[~come].tolist()):
                f.delete(a, b)
            full = not all(f.insert(a, b) for a, b in zip(k1[come].tolist(), k2[come].tolist()))
        else:
            f, full = Cuckoo.holding(k1[come], k2[come]), False
        return pa.table({"shard": pa.array([shard], pa.int32()), "n_buckets": pa.array([f.n], pa.int64()), "cells": [f.cells.tobytes()], "rebuild": [full]})

    changed = family.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, "shard int, n_buckets long, cells binary, rebuild boolean")
    changed = stored(changed, "filters")
    over = keys.withColumn("shard", s).join(changed.filter("rebuild").select("shard"), "shard", "left_semi")
    return changed.filter("NOT rebuild").drop("rebuild").unionByName(filters(over, n_shards))


def hot_keys(table: DataFrame) -> DataFrame:
    """k1, k2, n_docs, max_doc of the lines to act on."""
    return counts_of(table).filter(F.col("n_docs") >= LEAST_DOCS)


def apply_batch(table: DataFrame, family: DataFrame, batch: DataFrame, n_shards: int, delete: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reference table and the filters after a batch of documents came or, with `delete`, went, and doc_id of all documents whose lines must
    be decided again: those of an inserted batch, and every holder of a line that became or ceased to be one to act on, or has another
    largest holder. Only keys of the batch are compared. Deleted documents must be in the table, with the texts they came with.

    A null doc_id is a holder as any other; an empty batch changes nothing; no other column than doc_id and text is read."""
    more = stored(holders(batch), "batch-lines")
    after = stored((remove if delete else add)(table, more), "lines")
    touched = more.select("k1", "k2").distinct()
    old = hot_keys(table.join(touched, ["k1", "k2"], "left_semi")).select("k1", "k2", F.lit(True).alias("was"), F.col("max_doc").alias("old_max"))
    new = hot_keys(after.join(touched, ["k1", "k2"], "left_semi")).select("k1", "k2", F.lit(True).alias("is"), F.col("max_doc").alias("new_max"))
    moved = stored(old.join(new, ["k1", "k2"], "full").filter("was IS NULL OR is IS NULL OR NOT old_max <=> new_max"), "line-moves")
    filtered = update(family, hot_keys(after).select("k1", "k2"), moved.filter("was IS NULL"), moved.filter("is IS NULL"), n_shards)
    again = after.join(moved.select("k1", "k2"), ["k1", "k2"], "left_semi").select("doc_id")
    if not delete:
        again = again.unionByName(batch.select(F.col("doc_id").cast("long").alias("doc_id")))
    return after, stored(filtered, "filters"), again.distinct()


def shards_for(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def candidates(docs: DataFrame, family: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, k1, k2 of the lines that a filter knows. Filters go out in rounds of at most FILTER_BYTES."""
    spark = docs.sparkSession
    per_round = max(1, FILTER_BYTES // (SHARD_KEYS * 4 * 2))
    found = None
    for first in range(0, n_shards, per_round):
        rows = family.filter(F.col("shard").between(first, first + per_round - 1)).collect()
        sent = spark.sparkContext.broadcast({r.shard: (r.n_buckets, bytes(r.cells)) for r in rows})

        def probe(b, sent=sent):
            k1, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            shard = (k1 >> 20) % n_shards
            known = np.zeros(len(k1), bool)
            for s in np.unique(shard).tolist():
                if s in sent.value:
                    n, cells = sent.value[s]
                    m = shard == s
                    known[m] = Cuckoo(n, np.frombuffer(cells, np.uint16).reshape(-1, SLOTS)).holds(k1[m], k2[m])
            yield b.filter(pa.array(known))

        part = arrow_map(line_keys(docs), probe, "doc_id long, k1 long, k2 long")
        found = part if found is None else found.unionByName(part)
    return found


# -- documents ------------------------------------------------------------------------------------------------------


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: each document without the lines that a later document keeps.

    Exact: the filters only decide which lines take part in the join with the counts."""
    hot = stored(count_lines(docs).filter(F.col("n_docs") >= LEAST_DOCS), "line-counts")
    n_shards = shards_for(hot.count())
    family = filters(hot, n_shards)
    marks = candidates(docs, family, n_shards).join(hot.select("k1", "k2", "max_doc"), ["k1", "k2"])
    marks = marks.filter(~F.col("doc_id").eqNullSafe(F.col("max_doc"))).dropDuplicates(["doc_id", "k1", "k2"])
    drops = marks.groupBy(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id")).agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))
    texts = packed(docs).withColumns({"d": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
    joined = texts.join(drops, ["d", "no_id"], "left").select("doc_id", "body", F.col("keys.k1").alias("k1"), F.col("keys.k2").alias("k2"))

    def run(b):
        z = zstandard.ZstdDecompressor()
        lines, dropped, out = [], [], []
        for body, k1, k2 in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            text = b"" if body is None else z.decompress(body)
            own = text.split(b"\n")
            if k1:
                gone = set(zip(k1, k2))
                digests = [None if k is None else _digest(k) for k in keys_of(text)]
                stay = [x for x, g in zip(own, digests) if g is None or (int.from_bytes(g[:8], "little", signed=True), int.from_bytes(g[8:], "little", signed=True)) not in gone]
            else:
                stay = own
            lines.append(len(own))
            dropped.append(len(own) - len(stay))
            out.append(b"\n".join(stay))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines), pa.array(dropped), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return arrow_map(joined, run, "doc_id long, n_lines long, n_dropped long, text string")


def line_report(docs: DataFrame) -> DataFrame:
    """Digest columns of dedup_lines."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

