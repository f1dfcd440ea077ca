"""Quality scores, collocations and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import LONG, corpus, documents, edge_docs, edge_rows, empty_docs, tuples

from yushi.llm import alignment, collocations, kernel

SF = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]


# -- alignment ------------------------------------------------------------------------------------------------------


def byte_links(a, b):
    """Groups and links from the owner of every byte."""
    own_a, own_b = ([k for k, t in enumerate(x) for _ in t] for x in (a, b))
    cut = [0, *[p for p in range(1, len(own_a)) if own_a[p] != own_a[p - 1] and own_b[p] != own_b[p - 1]], len(own_a)]
    found = [(sorted(set(own_a[p:q])), sorted(set(own_b[p:q]))) for p, q in zip(cut, cut[1:])]
    return found, sorted(set(zip(own_a, own_b)))


class Plain:
    """The contract, text by text, with the plain libraries."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[2])
        self.a.encode_special_tokens = True
        self.byte = alignment._byte_of()

    def one(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ta = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        pb = [self.b.id_to_piece(i) for i in b]
        tb = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pb]
        if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            return None
        found, links = byte_links(ta, tb)
        written = ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in found)
        return len(a), len(b), len(found), [(a[x], b[y]) for x, y in links], hashlib.sha256(written.encode()).hexdigest()

    def table(self, rows):
        got = [(d, self.one(t)) for d, t in rows]
        n = Counter(p for _, g in got if g for p in set(g[3]))
        top = {}
        for (a, _), c in n.items():
            top[a] = max(top.get(a, 0), c)
        return sorted(((d, 0, 0, 0, 0, 0, 0, "") if g is None else (d, g[0], g[1], g[2], len(g[3]), sum(n[p] == top[p[0]] for p in g[3]), sum(n[p] for p in g[3]), g[4]) for d, g in got), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_alignment_against_plain_libraries(spark, plain, block):
    rows = corpus(60) + [(900 + k, t) for k, t in enumerate(["<|endoftext|> x", "a▁b", "<0x41> <unk> <s>", "tab\tand  two\n\n lines ", "\r\n", "漢字 🙂 é", " ", "don't it's"])]
    got = alignment.report(documents(spark, rows), *PATHS, block=block)
    assert got.columns == COLUMNS and tuples(got, *COLUMNS) == plain.table(rows)


def test_alignment_of_odd_rows(spark, plain):
    rows = [r[:2] for r in edge_rows()]
    assert tuples(alignment.report(edge_docs(spark)), *COLUMNS) == plain.table(rows)
    assert alignment.report(empty_docs(spark)).count() == 0


def test_segments_equal_whole_texts():
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "word", "don't", "'s", "abc123", "漢字", "🙂", "é", "▁", "<0x41>", "<s>", "<|endoftext|>", "\0", "...", "!!", "B", "​", "1,000.5"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    own = alignment.Aligner(alignment.ByteLevel(*PATHS[:2]), alignment.Pieces(PATHS[2]))
    for t, got in zip(texts, own.texts(texts)):
        w = own.whole(t)
        assert (got is None) == (w is None) and (w is None or (w[2], w[3], hashlib.sha256(w[0].encode()).hexdigest(), w[1]) == (got[0], got[1], got[4], got[5])), t
        ids = own.a.tok.encode(" " + t, add_special_tokens=False).ids
        assert own.a.ids(" " + t) == ids


def test_links_of_tokens_without_bytes():
    length = np.array([0, 1, 2, 3])
    assert [(x, y) for _, _, _, x, y in alignment.groups([2, 0, 1], [1, 1, 1], length, length)] == [([2, 0], [1, 1]), ([1], [1])]
    assert alignment.links([2, 0], [1, 1], length, length) == [(2, 1), (2, 1)] and alignment.links([1, 2], [2, 1], length, length) == [(1, 2), (2, 2), (2, 1)]


def test_links_survive_packing():
    keys, n = np.array([3, 9, 50_256 * 32_000 + 31_999]), np.array([1, 700, 2])
    back = alignment.unpack(alignment.pack(keys, n))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == n.tolist()


# -- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, first=2000):
    """rows: (lang, text)"""
    f = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, t in rows:
        own = f.setdefault(lang or "und" if lang != "" else "", Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (t or "").translate(lower)):
            ws = re.findall(r"[^ \t]+", piece)
            own.update(tuple(ws[i:i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        some = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        gone = {p for g, a in some.items() if len(g) == 3 for p in (g[:2], g[1:]) if 100 * a >= 50 * own[p]}
        best = [(g, a, *min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))) for g, a in some.items() if g not in gone]
        best.sort(key=lambda x: (-x[2], -x[1], " ".join(x[0]).encode()))
        n = sum(a for g, a in own.items() if len(g) == 1)
        out += [(lang, k, " ".join(g), a, left, right, n, score) for k, (g, a, score, _, left, right) in enumerate(best[:first], 1)]
    return sorted(out, key=str)


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lang_docs(spark, rows):
    return spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)


def spoken(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Ä", "ä", "naïve", "x\x1cy", "q\0"]
    return [(rng.choice(["en", "de", None, "und", "x y"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randint(0, 60))).upper() if rng.random() < .1 else " ".join(words[int(rng.paretovariate(.7)) % 45] for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("bits, shard, together, piece", [(1 << 27, 1 << 17, 8, 3 << 20), (64, 50, 3, 200), (1 << 12, 400, 1, 31)])
def test_collocations_against_plain_counts(spark, monkeypatch, bits, shard, together, piece):
    monkeypatch.setattr(collocations, "PIECE", piece)
    rows = spoken()
    got = collocations.report(lang_docs(spark, rows), bits=bits, shard=shard, together=together)
    assert got.columns == PHRASE and got.count() > 150 and tuples(got, *PHRASE) == plain_collocations(rows, 10)


def test_texts_are_read_as_often_with_many_tries_as_with_one(spark, monkeypatch):
    reads, over = [], collocations.over_pieces
    monkeypatch.setattr(collocations, "over_pieces", lambda *a: reads.append(a[-1]) or over(*a))
    rows = spoken()
    few = tuples(collocations.report(lang_docs(spark, rows)), *PHRASE)
    n = len(reads)
    assert tuples(collocations.report(lang_docs(spark, rows), shard=10, together=2), *PHRASE) == few == plain_collocations(rows, 10)
    assert n == 4 and len(reads) == 2 * n  # words, pairs, triples, counts


def test_a_piece_sends_its_phrases_by_shard_in_rows_of_bounded_size(monkeypatch):
    monkeypatch.setattr(collocations, "ROW", 3)
    text = b"a b c d e f g a b c. a b a b"
    piece = next(collocations._split("en", text, 1 << 20))
    may = collocations.Bitmap(np.full(1, ~np.uint64(0)))  # lets all through
    words, f, key = collocations._seen(piece, collocations._digests(piece), may)
    rows = collocations._rows(piece, words, f, collocations._of(key, 2))
    got = Counter()
    for r in rows.to_pylist():
        own = r["words"].split(b"\n")
        a, b, c = (np.frombuffer(r[x], np.uint16) for x in "abc")
        assert 0 < len(a) <= 3 and len(own) == len(set(own)) and r["shard"] in (0, 1) and r["kind"] == 1
        for x, y, z, n in zip(a, b, c, np.frombuffer(r["f"], np.int32)):
            got[tuple(own[k] for k in (x, y, z) if k != collocations.NONE)] += int(n)
    want = Counter(tuple(p[i:i + k]) for p in ([x.encode() for x in s.split()] for s in text.decode().split(".")) for k in (2, 3) for i in range(len(p) - k + 1))
    assert got == want and len(rows) > 4


def test_sums_of_phrases_keep_those_of_one_digest_apart(monkeypatch):
    words = np.array([[1, 2, 1, 3, 2, 1], [5, 6, 5, 7, 6, 6]], np.uint64)
    for joined in (collocations._joined, lambda a, b: np.zeros(len(a), np.uint64)):
        monkeypatch.setattr(collocations, "_joined", joined)
        got, f = collocations._added_up(words, np.array([2, 1, 3, 4, 1, 9]), 3)
        assert sorted(zip(*got.tolist(), f.tolist())) == [(1, 5, 5), (1, 6, 9), (3, 7, 4)]
    assert collocations._added_up(words[:, :0], np.zeros(0, np.int64), 1)[0].shape == (2, 0)


def test_collocations_keep_the_first_of_each_language(spark):
    rows = spoken(150, 8)
    assert tuples(collocations.report(lang_docs(spark, rows), least=2, first=7), *PHRASE) == plain_collocations(rows, 2, 7)


def test_collocations_of_odd_rows(spark):
    rows = [(r[2], r[1]) for r in edge_rows()]
    assert tuples(collocations.report(edge_docs(spark)), *PHRASE) == plain_collocations(rows, 10)
    assert collocations.report(empty_docs(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 3_000_000_000), ("en", "b c", 10)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", 3_000_000_001), ("en", "b", 4_000_000_000), ("en", "c", 10)], "lang string, word string, f long")
    totals = spark.createDataFrame([("en", 9_000_000_000)], "lang string, n long")
    got = {r.phrase: r.score for r in collocations.ranked(phrases, words, totals).collect()}
    assert got == {"a b": 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 4_000_000_000), "b c": 1_000_000 * 100 // (4_000_000_000 * 10)}


def test_trie_accepts_its_phrases_only():
    rng = random.Random(2)
    phrases = [list(p) for p in {tuple([" en", *(f"w{rng.randint(0, 300)}" for _ in range(rng.choice((2, 3))))]) for _ in range(3000)}]
    trie, states = collocations.build(phrases)
    number = {w: k for k, w in enumerate(trie.words)}
    assert len(set(states.tolist())) == len(phrases)
    known = {tuple(p): s for p, s in zip(phrases, states.tolist())}

    def walk(p):
        s = np.zeros(1, np.int64)
        for w in p:
            s = trie.word(s, trie.digits(np.array([number[w]]))) if s[0] >= 0 else s
        return int(s[0])

    for _ in range(3000):
        p = [" en", *(f"w{rng.randint(0, 300)}" for _ in range(3))]
        if all(w in number for w in p):
            assert walk(p) == known.get(tuple(p), -1)
    assert all(walk(p) == s for p, s in known.items())


# -- quality scores -------------------------------------------------------------------------------------------------


def test_statistics_of_a_text():
    s = dict(zip(kernel.STATISTICS, kernel.statistics(b"One two.\nOne 22\n\nOne 22\n")))
    assert s["distinct_words"] == 3 / 6 and s["distinct_lines"] == 2 / 3 and s["ended_lines"] == 1 / 3 and s["digits"] == 4 / 17 and s["short_words"] == 2 / 6
    assert kernel.statistics(None) == kernel.statistics(b"") == [0.0] * len(kernel.STATISTICS)
    assert len(kernel.statistics(LONG.encode())) == len(kernel.statistics(b" \n")) == len(kernel.STATISTICS)


def blobs(n, seed=4):
    rng = np.random.default_rng(seed)
    x = np.rint(rng.standard_normal((n, len(kernel.STATISTICS))) * kernel.ONE).astype(np.int64)
    y = (np.abs(x[:, 0]) + np.abs(x[:, 1]) < kernel.ONE).astype(int)  # no plane parts these
    return x, y, rng.integers(0, kernel.FOLDS, n)


def test_fit_against_dense_algebra(spark):
    x, y, fold = blobs(600)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold)], "x array<long>, y int, fold int")
    model, again = kernel.fit(rows.repartition(7)), kernel.fit(rows.repartition(2))
    assert all(np.array_equal(a, b) for a, b in zip(model[:3], again[:3])) and all(np.array_equal(a, b) for a, b in zip(model.corners, again.corners))
    assert np.allclose(model.mean, (x / kernel.ONE).mean(axis=0)) and np.allclose(model.deviation, (x / kernel.ONE).std(axis=0))
    z = kernel.features(x / kernel.ONE, model.mean, model.deviation) / kernel.ONE

    def weights(some, ridge):
        hold = ridge * some.sum() * np.eye(z.shape[1])
        hold[0, 0] = 1e-9
        return np.linalg.solve(z[some].T @ z[some] + hold, z[some].T @ y[some])

    errors = {r: sum(((z[fold == f] @ weights(fold != f, r) - y[fold == f]) ** 2).sum() for f in range(kernel.FOLDS)) for r in kernel.RIDGES}
    ridge = min(errors, key=errors.get)
    for f in range(kernel.FOLDS):
        assert np.allclose(model.weights[f], weights(fold != f, ridge), atol=1e-6)
    assert np.allclose(model.weights[-1], weights(fold >= 0, ridge), atol=1e-6)
    raw = np.array([z[i] @ weights(fold != fold[i], ridge) for i in range(len(y))])
    step = np.rint(np.clip(raw, kernel.LOW, kernel.HIGH) * kernel.STEPS)
    for s, v in zip(*model.corners):  # the share in a pool is the greatest of least means: the definition of isotonic regression
        left = sorted({t for t in step if t <= s} or {step.min()})
        right = sorted({t for t in step if t >= s} or {step.max()})
        assert abs(max(min(y[(step >= a) & (step <= b)].mean() for b in right) for a in left) - v) < 1e-9


def test_features_approach_the_gaussian_kernel():
    x = np.random.default_rng(1).standard_normal((30, len(kernel.STATISTICS)))
    z = kernel.features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, 1:] / kernel.ONE
    near = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * kernel.WIDTH**2))
    assert np.abs(2 * z @ z.T / kernel.FEATURES - near).mean() < 0.06


def test_pools_never_fall():
    share = kernel.pooled(np.arange(5), np.array([2, 1, 1, 4, 2]), np.array([1, 0, 1, 1, 2]))[1]
    assert share.tolist() == [1 / 3, 2 / 5, 1.0]


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.97), ("sf0.1", 0.99)])
def test_scores_tell_held_out_documents_apart(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in kernel.report(docs, labels).join(labels, "doc_id").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and r.quality == q] for q in (1, 0))
    area = np.mean([(x > y) + 0.5 * (x == y) for x in good for y in bad])
    assert area > least and np.mean([x >= 0.3 for x in good]) > 0.98


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(kernel.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert tuples(kernel.report(docs, labels), "doc_id", "score") == tuples(kernel.report(docs, turned), "doc_id", "score")


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (7, None), (3, 1), (8, 5), (10, 1), (11, 1), (12, 0)], "doc_id long, quality int")
    got = kernel.report(edge_docs(spark), labels).collect()
    assert len(got) == len(edge_rows()) and all(r.score is not None and 0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    none = kernel.report(edge_docs(spark), labels.filter("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    ones = kernel.report(edge_docs(spark), spark.createDataFrame([(d, 1) for d in range(12)], "doc_id long, quality int")).collect()
    assert {r.score for r in ones} == {1.0}
    assert kernel.report(empty_docs(spark), labels).count() == 0
    sure = {tuple(r.x) for r in kernel.labelled(kernel.measured(edge_docs(spark)), labels).collect()}
    x = {r.doc_id: tuple(r.x) for r in kernel.measured(edge_docs(spark)).collect()}
    assert sure == {x[d] for d in (6, 3, 10, 11, 12) if zlib.crc32(str(d).encode()) % 5}
