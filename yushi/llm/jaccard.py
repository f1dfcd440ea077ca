"""Near-duplicate join on word shingles by chosen paths.

Equal word sequences are one text. In each run a text with n shingles chooses those whose hash is below `RATE / n`; the same shingle is chosen by
texts of like size, so similar texts choose mostly the same. A chosen shingle is a path of length one and names a bucket. Of its buckets a text
stays in the rarest ones only, so many that two texts with `SHARED` of their choices in common meet; the number of runs follows from the target
recall of that. A bucket of more than `LIMIT` texts is split: its texts extend their paths by shingles of a sample, again the rarest in
the bucket and as many as that. Splitting ends where buckets are small, where one does not shrink, or where its texts are alike on
average; such large buckets are compared in pairs of blocks. Blocks are cut by their texts' number and by their shingles, and a bucket of few
but very long texts is cut like a large one, so what a task holds at once does not grow with the group or its texts.

In a bucket all pairs are compared exactly, by counting common shingles, and none leaves the task: what leaves are, for each text,
its links and one edge to the root of its local group. A pair that meets in several buckets counts in the smallest
of their ids. Groups are joined by alternating large and small stars.

Defined results: words are what ASCII white space separates; a text with fewer words than a shingle is one shingle; texts without words
(null and empty ones too) have no links and a class of their own; repeated rows are copies and count as links; a null doc_id takes
part, and a class has its smallest doc_id that is not null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, by_place, parts, ready, signed, slices, stored, utf8

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9998
#: Expected number of shingles a text chooses in one run.
RATE = 2.0
#: Similar texts share at least this part of what each chooses, and of its sample, but for one in 1 / (1 - RECALL) pairs.
SHARED = 0.4
LIMIT, BLOCK, DEPTH = 200, 1024, 4
#: Shingles of a block, all its texts together (eight bytes each): a bucket with more is cut.
SHINGLES = 1 << 22
#: Expected size of the sample that paths are extended from.
SAMPLE = 24
ALIKE, SHRUNK = 0.5, 0.7
_COLUMNS, _AT_ONCE = 1 << 13, 1 << 20


def _poisson(mean: float) -> np.ndarray:
    return np.array([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(int(mean + 12 * math.sqrt(mean) + 30))])


def missed(chosen: float, threshold: float) -> float:
    """Share of pairs right at the threshold that have less than `SHARED` of `chosen` expected shingles in common."""
    common, apart = _poisson(chosen * threshold), _poisson(chosen * (1 - threshold))
    return sum(p * common[:max(1, math.ceil(SHARED * k / (1 - SHARED)))].sum() for k, p in enumerate(apart))


def runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs until the target recall."""
    return next(r for r in range(1, 1000) if missed(r * RATE, threshold) <= 1 - recall)


# -- shingles -------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    m = len(h) - width + 1
    g = h[:m].copy()
    for k in range(1, width):
        g = _mixed(g) + h[k:k + m]
    return np.unique(_mixed(g))


def text_key(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _below(h: np.ndarray, rate: float, n: int) -> np.ndarray:
    return h if rate >= n else h[h < np.uint64(int(rate / n * 2**64))]


def chosen(sh: np.ndarray, n_runs: int) -> np.ndarray:
    """Buckets of a text: one for each chosen shingle of each run."""
    out = []
    for r in range(n_runs):
        h = _mixed(sh + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out.append(_below(h, RATE, len(sh)) ^ np.uint64(r * 0xD1B54A32D192ED03 % 2**64))
    return np.concatenate(out)


def sketches(docs: DataFrame, n_runs: int, width: int = WIDTH) -> DataFrame:
    """doc_id, t (digest of the words), n, buckets, sample."""

    def run(b):
        t, n, buckets, sample = [], [], [], []
        for text in utf8(b.column(1)):
            words = (text or b"").split()
            t.append(text_key(words))
            if not words:
                n.append(0)
                buckets.append([])
                sample.append([])
                continue
            sh = shingles(words, width)
            n.append(len(sh))
            buckets.append(signed(chosen(sh, n_runs)))
            sample.append(signed(_below(_mixed(sh ^ np.uint64(0x2545F4914F6CDD1D)), SAMPLE, len(sh))))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.binary()), pa.array(n, pa.int64()), pa.array(buckets, longs), pa.array(sample, longs)], ["doc_id", "t", "n", "buckets", "sample"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, t binary, n long, buckets array<long>, sample array<long>")


# -- buckets --------------------------------------------------------------------------------------------------------


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two texts or more, with the number of texts as g and of their shingles as s."""
    return rows.join(rows.groupBy("b").agg(F.count("*").alias("g"), F.sum("n").alias("s")).filter("g >= 2"), "b")


def _enough(n: str):
    """Of n tokens, the rarest that similar texts can't all miss each other in."""
    return F.col(n) - F.ceil(SHARED * F.col(n)) + 1


def rarest(rows: DataFrame) -> DataFrame:
    """Of each text's buckets (b, t, m of them, g texts each) the smaller ones, as many as similar texts need to meet.

    Buckets with one text are no rows here, but come first in the order."""
    w = W.partitionBy("t")
    place = F.col("m") - F.count("*").over(w) + F.row_number().over(w.orderBy("g", "b"))
    return rows.withColumn("place", place).filter(F.col("place") <= _enough("m"))


def _split(big: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large buckets (b, t, n, g, s): those to compare as they are, and the rows of their children (b, t, n, parent's g)."""
    tokens = lambda rows: rows.join(sample, "t").select("b", "t", "n", "g", F.size("sample").alias("k"), F.explode("sample").alias("token"))
    counts = stored(tokens(big).groupBy("b", "token").agg(F.count("*").alias("c"), F.first("g").alias("g")), "token-counts")
    alike = counts.groupBy("b").agg((F.sum(F.col("c") * F.col("c")) / (F.first("g") * F.sum("c"))).alias("share"))
    judged = stored(big.join(alike, "b"), "judged")
    dense = judged.filter(F.col("share") >= ALIKE).select("b", "t", "g", "s")
    rank = F.row_number().over(W.partitionBy("b", "t").orderBy("c", "token"))
    child = (
        tokens(judged.filter(F.col("share") < ALIKE)).join(counts.select("b", "token", "c"), ["b", "token"])
        .withColumn("place", rank).filter(F.col("place") <= _enough("k")).filter("c >= 2")
        .select(F.xxhash64("b", "token").alias("b"), "t", "n", F.col("g").alias("parent"))
    )
    return dense, child


def leaves(texts: DataFrame, limit: int = LIMIT, shingles_most: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Rows (b, t) of the small buckets, and (b, t, g, s) of those to compare in blocks: large ones, and few texts with very many shingles."""
    every = texts.select(F.explode("buckets").alias("b"), "t", F.size("buckets").alias("m"), "n")
    rows = stored(_sized(rarest(_sized(every)).select("b", "t", "n")), "buckets")
    few, light = F.col("g") <= limit, F.col("s") <= shingles_most
    small, dense = [rows.filter(few & light).select("b", "t")], [rows.filter(few & ~light).select("b", "t", "g", "s")]
    sample = texts.select("t", "sample")
    rows = rows.filter(~few)
    for depth in range(DEPTH):
        if rows.isEmpty():
            break
        alike, child = _split(rows, sample)
        dense.append(alike)
        sizes = child.groupBy("b").agg(F.count("*").alias("g"), F.sum("n").alias("s"), F.first("parent").alias("parent")).filter("g >= 2")
        rows = stored(child.select("b", "t", "n").join(sizes, "b"), "children")
        small.append(rows.filter(few & light).select("b", "t"))
        stuck = (F.col("g") > SHRUNK * F.col("parent")) if depth < DEPTH - 1 else F.lit(True)
        dense.append(rows.filter((few & ~light) | (~few & stuck)).select("b", "t", "g", "s"))
        rows = rows.filter(~few & ~stuck).select("b", "t", "n", "g", "s")
    union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
    return union(small), union(dense)


def work(small: DataFrame, dense: DataFrame, block: int = BLOCK, shingles_most: int = SHINGLES) -> DataFrame:
    """w, t, side, leaves: which texts meet where. Small buckets with the same texts meet once, with all their ids."""
    sets = small.groupBy("b").agg(F.sort_array(F.collect_list("t")).alias("ts")).groupBy("ts").agg(F.sort_array(F.collect_list("b")).alias("leaves"))
    few = sets.select(F.element_at("leaves", 1).alias("w"), F.explode("ts").alias("t"), F.lit(0).alias("side"), "leaves")
    n = F.ceil(F.greatest(F.col("g") / block, F.col("s") / shingles_most)).cast("int")
    own = dense.withColumn("n", n).withColumn("i", F.pmod(F.xxhash64("t"), F.col("n")).cast("int"))
    pairs = own.select("b", "t", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    many = pairs.select(F.xxhash64("b", lo, hi).alias("w"), "t", side.alias("side"), F.array("b").alias("leaves"))
    return few.unionByName(many)


# -- comparing ------------------------------------------------------------------------------------------------------


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sorted sets of hashes; many elements are taken range by range of their values."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    ranges = max(1, -(-sum(map(len, sets)) // _AT_ONCE))
    edges = np.array([k * 2**64 // ranges for k in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    out = np.zeros((n, n), np.int64)
    for k in range(ranges):
        out += _common([s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)])
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    n = len(sets)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    col = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    shared = np.bincount(col)[col] > 1
    row, col = row[shared], col[shared]
    col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)])) if len(col) else col
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
        a, b = np.searchsorted(col, [first, first + _COLUMNS])
        x = np.zeros((n, int(col[b - 1]) - first + 1), np.float32)
        x[row[a:b], col[a:b] - first] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def _canonical(leaf_sets: list[list[int]], own: set[int]) -> np.ndarray:
    """Pairs whose smallest common leaf is one of own."""
    n = len(leaf_sets)
    if n == 2:
        both = set(leaf_sets[0]) & set(leaf_sets[1])
        x = bool(both) and min(both) in own
        return np.array([[False, x], [x, False]])
    at: dict[int, list[int]] = {}
    for i, ls in enumerate(leaf_sets):
        for leaf in ls:
            at.setdefault(leaf, []).append(i)
    done, mine = np.zeros((n, n), bool), np.zeros((n, n), bool)
    last = max(own)
    for leaf in sorted(x for x, who in at.items() if len(who) > 1 and x <= last):
        ix = np.ix_(at[leaf], at[leaf])
        if leaf in own:
            mine[ix] |= ~done[ix]
        done[ix] = True
    return mine


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each one's group."""
    root = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, root[None, :], len(linked)).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(members: list[tuple], threshold: float) -> Iterator[tuple[bytes, bytes | None, int]]:
    """members: (t, side, leaves of the bucket, copies, all leaves of the text, shingles). Yields t, root, links."""
    sets = [m[5] for m in members]
    inter = common(sets)
    n = np.array([len(s) for s in sets])
    linked = inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9
    np.fill_diagonal(linked, False)
    side = np.array([m[1] for m in members])
    if side.any():
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return
    counted = linked & _canonical([m[4] for m in members], set(members[0][2]))
    links = counted @ np.array([m[3] for m in members], np.int64)
    root = _roots(linked)
    for i in np.flatnonzero(linked.any(1)).tolist():
        yield members[i][0], members[root[i]][0] if root[i] != i else None, int(links[i])


def meet(docs: DataFrame, texts: DataFrame, places: DataFrame, threshold: float, width: int) -> DataFrame:
    """t, root, links from all buckets. Texts travel compressed, once to each place they take part in."""
    own = places.groupBy("t").agg(F.collect_list(F.struct("w", "side", "leaves")).alias("places"), F.array_distinct(F.flatten(F.collect_list("leaves"))).alias("all_leaves"))
    needed = texts.select("t", F.col("rep").alias("doc_id"), "copies").join(own, "t")

    def bodies(b):
        z = zstandard.ZstdCompressor(level=1)
        ts, body = [], []
        for text in utf8(b.column(1)):
            words = (text or b"").split()
            ts.append(text_key(words))
            body.append(z.compress(b" ".join(words)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.binary()), pa.array(body, pa.binary())], ["doc_id", "t", "body"])

    whole = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), bodies, "doc_id long, t binary, body binary")
    both = whole.alias("a").join(needed.alias("b"), F.col("a.t").eqNullSafe(F.col("b.t")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")))
    rows = both.select(F.col("a.t").alias("t"), "copies", "all_leaves", "body", F.inline("places"))
    dealt = rows.select("w", "t", "side", "leaves", "copies", "all_leaves", "body").repartition(parts(docs), "w").sortWithinPartitions("w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()

        def found(members: dict) -> pa.RecordBatch:
            rows = list(compare(list(members.values()), threshold)) if len(members) > 1 else []
            cols = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["t", "root", "links"])

        at, members = None, {}
        for b in (part for whole in batches for part in slices(whole)):
            cols = [c.to_pylist() for c in b.columns]
            for w, t, *rest, body in zip(*cols):
                if w != at:
                    if members:
                        yield found(members)
                    at, members = w, {}
                # a text is words for a moment only; what stays are its shingles
                members[(t, rest[0])] = (t, *rest, shingles(z.decompress(body).split(), width))
        if members:
            yield found(members)

    return dealt.mapInArrow(run, "t binary, root binary, links long")


# -- groups ---------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, label for edges (a, b): alternating large and small stars, one written table each round."""

    def put(e):
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = stored(put(edges), "edges")
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = put(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        e = stored(put(small), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def labelled(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, limit: int = LIMIT, block: int = BLOCK,
             shingles_most: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and t, rep, label, n_links of each text with words: rep is its smallest doc_id, label names its group."""
    sk = stored(sketches(docs, runs(threshold, recall), width), "sketches")
    words = sk.filter(F.col("t").isNotNull())
    texts = stored(words.groupBy("t").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("buckets").alias("buckets"), F.first("sample").alias("sample"), F.first("n").alias("n")), "texts")
    places = work(*leaves(texts, limit, shingles_most), block, shingles_most)
    met = stored(meet(docs, texts, places, threshold, width), "met")
    label = components(met.filter(F.col("root").isNotNull()).select(F.col("t").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("t").agg(F.sum("links").alias("links"))
    return sk, (
        texts.select("t", "rep", "copies").join(links, "t", "left").join(label.withColumnRenamed("node", "t"), "t", "left")
        .select("t", "rep", F.coalesce("label", "t").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, t, class_id, n_links: one row for each row of docs. `how` goes to `labelled`."""
    sk, known = labelled(docs, **how)
    words = sk.filter(F.col("t").isNotNull())
    names = known.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = known.join(names, "label").select("t", "class_id", "n_links")
    found = words.select("doc_id", "t").join(named, "t", "left").select("doc_id", "t", "class_id", "n_links")
    return found.unionByName(sk.filter(F.col("t").isNull()).select("doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with the digest of the words behind its columns."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = docs.columns.index("text")

    def run(b):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_key((t or b"").split()) for t in utf8(b.column(at))], pa.binary())], [*b.schema.names, name])

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until docs has no such column in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with one row of each group: of the text with the smallest doc_id (null last, then the smaller digest), and one of repeated rows.

    Groups go by their texts, so null and equal ids don't matter. Rows without words all stay. Any column may have any name but doc_id and text."""
    names, docs = docs.columns, by_place(docs)
    key, own, keep_t, keep_id, place = fresh(docs, "t", "own", "keep_t", "keep_id", "place")
    _, known = labelled(docs)
    first = known.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "t")).alias("first"))
    first = first.select(F.col("first.t").alias(keep_t), F.col("first.rep").alias(keep_id))
    wordless = F.col(key).isNull()
    rows = with_key(docs, key).withColumn(own, F.when(wordless, F.monotonically_increasing_id()))
    joined = rows.join(first, (F.col(key) == F.col(keep_t)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)), "left")
    kept = joined.filter(wordless | F.col(keep_t).isNotNull())
    kept = kept.withColumn(place, F.row_number().over(W.partitionBy(key, own).orderBy("doc_id"))).filter(F.col(place) == 1)
    return kept.select(*docs.columns).toDF(*names)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies, see `one_of_each`; an empty table stays empty."""
    ready(spark)
    return one_of_each(docs)
