"""Source mix, token output, pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import corpus, documents, edge_docs, edge_rows, empty_docs, tuples
from yushi.llm import decontaminate, jaccard, mixing, quality, tokens

# -- mix ------------------------------------------------------------------------------------------------------------


def brute_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(totals.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * totals[s]}
        for s in full or free:
            out[s] = 2.0 * totals[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(2.0 * totals[s] for s in full)
        free -= full
    return out


def mix_docs(seed=1):
    rng = random.Random(seed)
    return [(k, "w " * int(rng.lognormvariate(4, 1)), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5])}" if rng.random() < 0.95 else None) for k in range(900)]


def test_mix(spark):
    rows = mix_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.report(df).collect()
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len(t.split())
    want = brute_targets(totals)
    taken = Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(1.5 * sum(totals.values()))
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.002 * want[s] + 5
    again = mixing.report(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_dual_is_solved(spark):
    """Rates are min(2, exp(lambda x)) with the constraint met: no other lambda does."""
    rows = mix_docs(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = mixing.keyed(df, F.lit(1))
    hist = mixing.histogram(keyed).cache()
    sources = hist.groupBy("src", "no_src").agg(F.sum(F.col("n") * F.col("size")).alias("total"))
    for r in mixing.balance(hist, mixing.targets(sources)).collect():
        own = np.array([h.size for h in hist.filter((F.col("src") == r.src) & (F.col("no_src") == r.no_src)).collect() for _ in range(h.n)], float)
        if r.fixed is None:
            assert (own * np.minimum(2, np.exp(r.lam * own / own.mean()))).sum() == pytest.approx(r.target, rel=1e-6)
        else:
            assert r.fixed == 2 and r.target == pytest.approx(2 * own.sum())


def test_mix_of_odd_rows(spark):
    got = mixing.report(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows()) and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.report(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.report(blank).collect())
    twice = mixing.repeat(edge_docs(spark))
    assert twice.columns == edge_docs(spark).columns
    n = Counter(r.doc_id for r in twice.collect())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert n == +want
    assert mixing.repeat(empty_docs(spark)).count() == 0


def test_same_size_for_a_third_of_the_rows(spark):
    rows = [(k, "w " * (50 if k % 3 else k % 90 + 1), "a" if k % 4 else "b") for k in range(3000)]
    got = mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 60 for r in got)


# -- tokens ---------------------------------------------------------------------------------------------------------


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in edge_rows()], corpus(100, seed=3)], ids=["odd", "corpus"])
def test_tokens(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert tuples(tokens.encode_report(df), "doc_id", "start", "n_tokens", "ids_crc32") == brute_tokens(rows)


def test_small_shards_and_random_access(spark, monkeypatch, tmp_path):
    rows = corpus(100, seed=3)
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 500)
    df = documents(spark, rows)
    tokens.write(df, str(tmp_path / "t"), tokens.default_tokenizer())
    stored = tokens.read(spark, str(tmp_path / "t"))
    assert stored.count() > 10
    assert tuples(tokens.report(stored, tokens.default_tokenizer()), "doc_id", "start", "n_tokens", "ids_crc32") == brute_tokens(rows)
    got = {r.doc_id: r.ids for r in tokens.decode(stored, tokens.default_tokenizer(), [5, 71, 1000]).collect()}
    enc = tokens.Encoder(tokens.default_tokenizer())
    assert set(got) == {5, 71}
    assert all(got[d] == [*np.frombuffer(enc.ids(rows[d][1].encode()), np.uint32).tolist(), 1] for d in got)


def test_encoder_is_the_library():
    enc, rng = tokens.Encoder(tokens.default_tokenizer()), random.Random(5)
    signs = "abcXYZ éÉñß'sStT09!.,|-\n\t \x0b\x1c\x85\xa0\0«µ²ªΣσςİıǅ́ㅎ한漢字🙂ﬁ½ⅷ٣"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["it's we'll 's 'S !'s", "<|endoftext|> x", "a<|startoftext|>b", "x" * 500]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.ids(t.encode()), np.uint32).tolist() for t in texts] == want
    assert [np.frombuffer(x, np.uint32).tolist() for x in enc.many([t.encode() for t in texts])] == want


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE", 20)
    enc = tokens.Encoder(tokens.default_tokenizer())
    for _, t in corpus(40, seed=9):
        assert np.frombuffer(enc.ids(t.encode()), np.uint32).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("room", [16, 1024])
def test_runs_of_many_texts_are_looked_up_together(monkeypatch, room):
    """The library is asked once for the new runs of all texts, not for known ones, and a table that is full changes nothing."""
    monkeypatch.setattr(tokens, "_RUNS", room)
    enc = tokens.Encoder(tokens.default_tokenizer())
    asked, learn = [], enc.runs.learn
    monkeypatch.setattr(enc.runs, "learn", lambda new: asked.append(new) or learn(new))
    texts = ["one two, three's 12", "", "x" * 16 + " " + "x" * 17 + "é" * 40, "it'll \"'s !'s ''s 'd's 'say", "One TWO"]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, np.uint32).tolist() for x in enc.many([t.encode() for t in texts])] == want
    if room == 1024:
        assert len(asked) == 1 and len(set(asked[0])) == len(asked[0])
    for _, t in corpus(40, seed=9) + [(0, "".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}7" for k in range(700)))]:
        assert np.frombuffer(enc.many([t.encode()])[0], np.uint32).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 4000))
    seq = rng.integers(0, int(rng.choice([1, 2, 5, 300])), n).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(0, n, int(rng.integers(0, 20))), n - 1))
    last = np.zeros(n, bool)
    last[ends] = True
    rules, symbols, still = tokens.repair(seq, last, 300)
    g = tokens.Grammar(rules, tokens.rule_lengths(rules, 300), 300)
    assert (g.expand(symbols) == seq).all()
    assert (np.cumsum(g.n[symbols])[still] - 1 == ends).all()
    assert len(symbols) <= n and (n < 3000 or len(symbols) < n)


@pytest.mark.parametrize("terminals", [300, 65_000])
def test_grammar_is_complete(terminals):
    rng = np.random.default_rng(4)
    # common pairs of common pairs, and rare ones that occur a few times
    phrases = [rng.integers(0, 290, int(rng.integers(2, 12))) for _ in range(1500)]
    seq = np.concatenate([phrases[int(k)] for k in rng.zipf(1.3, 20_000) % 1500]).astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[199::200] = last[-1] = True
    rules, symbols, still = tokens.repair(seq, last, terminals)
    g = tokens.Grammar(rules, tokens.rule_lengths(rules, terminals), terminals)
    assert (g.expand(symbols) == seq).all() and (np.cumsum(g.n[symbols])[still] - 1 == np.flatnonzero(last)).all()
    pairs = Counter((a, b) for a, b, end in zip(symbols.tolist(), symbols[1:].tolist(), still.tolist()) if not end)
    assert max(pairs.values()) < 4
    if terminals == 65_000:
        assert len(rules) > 536 and tokens.width(terminals, len(rules)) is np.uint32
        row = tokens._shard(0, 0, [7, None], [seq[:5000].tobytes(), seq[5000:].tobytes()], terminals)
        assert [x.tolist() for _, _, x in tokens._decoded(row, terminals)] == [seq[:5000].tolist(), seq[5000:].tolist()]


@pytest.mark.parametrize("seed", range(40))
def test_grammar_is_that_of_recounting(seed):
    """Every round counts all pairs anew, here."""
    rng = np.random.default_rng(seed)
    n, terminals = int(rng.integers(1, 600)), int(rng.integers(1, 12))
    seq, last = rng.integers(0, terminals, n).astype(np.uint32), rng.random(n) < 0.05
    last[-1] = True
    docs = [x.tolist() for x in np.split(seq, np.flatnonzero(last) + 1)[:-1]]
    want = []
    while True:
        counts = Counter(p for d in docs for p in zip(d, d[1:]))
        floor = max(tokens.LEAST_COUNT, max(counts.values(), default=0) // 2)
        side, new = {}, {}
        for (a, b), _ in sorted(((p, c) for p, c in counts.items() if c >= floor), key=lambda x: (-x[1], x[0])):
            if a == b:
                if a not in side:
                    side[a] = 3
                    new[(a, b)] = terminals + len(want) + len(new)
            elif side.setdefault(a, 1) == 1 and side.setdefault(b, 2) == 2:
                new[(a, b)] = terminals + len(want) + len(new)
        if not new:
            break
        want += new
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                pair = tuple(d[i:i + 2])
                out.append(new.get(pair, d[i]))
                i += 2 if pair in new else 1
            docs[k] = out
    rules, symbols, still = tokens.repair(seq, last, terminals)
    assert [tuple(r) for r in rules.tolist()] == want
    assert symbols.tolist() == [x for d in docs for x in d] and np.diff(np.flatnonzero(still), prepend=-1).tolist() == [len(d) for d in docs]


def test_tokens_of_an_empty_table(spark):
    assert tokens.encode_report(empty_docs(spark)).count() == 0


# -- pipeline -------------------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    assert ids(kept) == sorted(r.doc_id for r in quality.judged(docs).filter("kept").collect())
    one = corpus_pipeline.STAGES[1][1](spark, kept, SF).cache()
    assert ids(one) == sorted({r.class_id for r in jaccard.report(kept).collect()})
    clean = corpus_pipeline.STAGES[2][1](spark, one, SF).cache()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(clean) == sorted(set(ids(one)) - {r.doc_id for r in decontaminate.matches(one, items).collect()})
    passages = [decontaminate.words(r.text) for r in items.collect()]
    texts = [" ".join(decontaminate.words(r.text)) for r in clean.collect()]
    assert not any(" ".join(p) in t for p in passages for t in texts)
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.report(clean).collect()}
    assert Counter(ids(mixed)) == +Counter(copies)
    for df in (kept, one, clean, mixed):
        assert df.columns == docs.columns
    by = defaultdict(int)
    for d, _, n, _ in brute_tokens([(r.doc_id, r.text) for r in mixed.collect()]):
        by[d] += n
    got = defaultdict(int)
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == by and sorted(r.start for r in rows)[0] == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_tables(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, edge_docs(spark), SF).columns == edge_docs(spark).columns
    assert stage(spark, empty_docs(spark), SF).count() == 0
