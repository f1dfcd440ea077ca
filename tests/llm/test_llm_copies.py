"""Decontamination, repeated substrings, Jaccard join."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import corpus, documents, edge_docs, edge_rows, empty_docs, tuples
from yushi.llm import decontaminate as D
from yushi.llm import jaccard as J
from yushi.llm import suffixes as S


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))) for _ in range(150)]
    assert [x[0] for x in D.align(pairs)] == [smith_waterman(a, b) for a, b in pairs]


def leaks(seed=3):
    rng = random.Random(seed)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(12, 40)))) for k in range(12)]
    docs = []
    for d in range(80):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 200))]
        if d % 4 == 0:  # whole or edited passages, one item far more often than the others
            own = items[0 if d % 8 else rng.randrange(12)][1].split()
            for _ in range(rng.randint(0, len(own) // 8)):
                k = rng.randrange(len(own))
                own[k:k + 1] = rng.choice([[], ["new"], [own[k], "more"]])
            at = rng.randrange(len(words))
            words[at:at] = own
        docs.append((d, " ".join(words)))
    return docs, items


def test_decontamination_is_brute_force(spark):
    docs, items = leaks()
    got = tuples(D.matches(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "score")
    want = []
    for d, t in docs:
        for k, x in items:
            s = smith_waterman(D.words(x), D.words(t)) / (D.MATCH * len(D.words(x)))
            if s >= D.LEAST_SCORE:
                want.append((d, k, s))
    assert len(want) >= 20 and got == sorted(want, key=str)


@pytest.mark.parametrize("same", [True, False], ids=["equal", "each_its_own"])
@pytest.mark.parametrize("share", [0.2, 0.25, 0.3])
def test_many_edited_copies_are_brute_force(share, same):
    rng = random.Random(11)
    sentence = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    items = [(k, sentence(rng.randint(20, 40))) for k in range(6)]
    changed = lambda w: {int(k / share) for k in range(int(len(w) * share))} if same else set(rng.sample(range(len(w)), int(len(w) * share)))
    texts = []
    for _, w in items[:4]:
        edited = None
        for _ in range(400 if same else 60):
            if edited is None or not same:
                own = changed(w)
                edited = ["new" if k in own else x for k, x in enumerate(w)]
            texts.append(" ".join([*sentence(8), *edited, *sentence(8)]) if len(texts) % 20 == 0 else " ".join(["before", *edited, "behind"]))
    # n-grams of the items in texts that hold nothing else of them: they are rarer than those of the copies
    for _, w in items:
        texts += [" ".join([*sentence(5), *w[k:k + 3], *sentence(5)]) for k in range(0, len(w) - 3) for _ in range(2)]
    every = {g for _, w in items for g in D.grams(w)}
    n = Counter(g for t in texts for g in {g for g in D.grams(D.words(t)) if g in every})
    find = D._finder(items, D.seeds(items, {g: n[g] for g in every}))
    got = {(i, k): s for i, k, s, *_ in find(texts, D.LEAST_SCORE)}
    seen, want = {}, {}
    for i, t in enumerate(texts):
        for k, w in items:
            if (t, k) not in seen:
                own = D.words(t)
                number = {x: j for j, x in enumerate({*own, *w})}
                seen[t, k] = D.align([(np.array([number[x] for x in w]), np.array([number[x] for x in own]))])[0][0] / (D.MATCH * len(w))
            if seen[t, k] >= D.LEAST_SCORE and any(g in every for g in D.grams(D.words(t))):
                want[i, k] = seen[t, k]
    assert len(want) >= (4 * 400 if same else 200) * (share < 0.3) and got == {x: s for x, s in want.items() if x in got}
    lost = [x for x in want if x not in got]
    assert all(not set(D.grams(items[k][1])) & set(D.grams(D.words(texts[i]))) for i, k in lost)


def test_long_items_are_brute_force(monkeypatch):
    """Items longer than the bound for their windows: edited copies are found with the same scores, in groups of few cells."""
    rng = random.Random(4)
    sentence = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, sentence(D.LONG_ITEM + 60 * k + 30)) for k in range(2)]
    texts = []
    for _, w in items:
        for share in (0.0, 0.1, 0.3):
            texts.append([*sentence(40), *[f"new{rng.random()}" if rng.random() < share else x for x in w], *sentence(40)])
        texts += [w[:len(w) // 3] + sentence(400), sentence(300), [x for x in w if rng.random() < 0.8]]
    n = Counter(g for t in texts for g in set(D.grams(t)))
    counts = {g: n[g] for _, w in items for g in D.grams(w)}
    joined = [" ".join(t) for t in texts]
    want = {}
    for i, t in enumerate(map(D.words, joined)):
        for k, w in items:
            number = {x: j for j, x in enumerate({*t, *w})}
            s = D.align([(np.array([number[x] for x in w]), np.array([number[x] for x in t]))])[0][0] / (D.MATCH * len(w))
            if s >= D.LEAST_SCORE:
                want[i, k] = s
    assert len(want) >= 6
    for cells in (1 << 18, 2000):
        monkeypatch.setattr(D, "_CELLS", cells)
        got = {(i, k): s for i, k, s, *_ in D._finder(items, D.seeds(items, counts))(joined, D.LEAST_SCORE)}
        assert got == want


def test_groups_of_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(D, "_CELLS", 1000)
    rng = random.Random(1)
    todo = [(k, 0, 0, 1, np.zeros(rng.choice([10, 90, 300, 5000]), int)) for k in range(200)]
    groups = list(D.together(todo, [20]))
    assert sorted(x[0] for g in groups for x in g) == list(range(200))
    assert all(len(g) == 1 or len(g) * max(len(x[4]) for x in g) <= 1000 for g in groups) and len(groups) < 170
    assert list(D.together([], [])) == []


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, items = leaks(5)
    d, i = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = tuples(D.matches(d, i), "doc_id", "item_id", "score")
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert len(list(D.blocks(i))) > 2
    assert tuples(D.matches(d, i), "doc_id", "item_id", "score") == want
    left = {r.doc_id for r in D.clean(d, i).collect()}
    assert left == {x for x, _ in docs} - {w[0] for w in want}


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "tie tie tie tie", 1), (3, "one two", 1), (3, "one two", 1), (4, "!!!", 1)], "item_id long, text string, doc_id int")
    got = tuples(D.matches(edge_docs(spark), items), "doc_id", "item_id", "score")
    assert got == sorted([(3, 3, 1.0), (3, 3, 1.0), (10, None, 1.0), (11, None, 1.0)], key=str)
    clean = D.clean(edge_docs(spark), items)
    assert clean.columns == edge_docs(spark).columns and clean.count() == len(edge_rows()) - 4
    assert D.matches(empty_docs(spark), items).count() == 0 and D.matches(edge_docs(spark), items.limit(0)).count() == 0


def brute_repeats(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if w in seen:
                edge[p] += 1
                edge[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((rows[i][0], len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in edge_rows()], corpus(90, seed=7)], ids=["odd", "corpus"])
def test_repeated_substrings(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert tuples(S.report(df), *COLUMNS) == brute_repeats(rows)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_levels_give_the_same(spark, batches):
    rows = corpus(70, seed=8)
    got = tuples(S.dedup(documents(spark, rows), batches=batches, length=24, key=8), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got == [r[:4] for r in brute_repeats(rows, 24)]


def test_hot_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 2)
    monkeypatch.setattr(S, "SAMPLED", 2)
    rows = corpus(90, seed=9)
    assert len(S.hot_anchors(S.numbered(documents(spark, rows)).select("doc", "text"))) > 0
    assert tuples(S.report(documents(spark, rows)), *COLUMNS) == brute_repeats(rows)


def test_family_sizes(spark):
    rows = corpus(60, seed=10)
    family = S.Family(4, np.zeros(0, np.uint64), 24, 8)
    for k in range(6):
        part = documents(spark, rows[10 * k:10 * k + 10]).selectExpr("doc_id AS doc", "text")
        family.add(part)
    assert [s for s, _ in family.levels] == [2, 4]


def test_repeats_of_odd_tables(spark):
    assert S.report(empty_docs(spark)).count() == 0
    assert S.report(edge_docs(spark)).count() == len(edge_rows())


def brute_classes(rows, threshold=0.8):
    sets, inv = {}, defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[k]:
            inv[x].append(k)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in {y for x in sets[a] for y in inv[x] if y > a}:
            k = len(sets[a] & sets[b])
            if k >= threshold * (len(sets[a]) + len(sets[b]) - k):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    name = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            name[find(k)].append(d)
    return sorted([(d, min(name[find(k)], default=None), links[k]) for k, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in edge_rows()], corpus(160, seed=11)], ids=["odd", "corpus"])
def test_classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert tuples(J.report(df), "doc_id", "class_id", "n_links") == brute_classes(rows)


def near_copies(n, seed=5):
    """One text of which nearly all are copies with a few words changed, and texts that share a passage with it."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        if k % 3 == 2:
            words = base[:30] + [f"v{rng.randrange(10_000)}" for _ in range(rng.randint(20, 120))]
        else:
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize("limit, block", [(100, 1024), (8, 16)])
def test_large_groups(spark, limit, block):
    rows = near_copies(120)
    got = tuples(J.classes(documents(spark, rows), limit=limit, block=block), "doc_id", "class_id", "n_links")
    assert got == brute_classes(rows)


@pytest.mark.parametrize("most", [700, 4000])
def test_texts_with_many_shingles_are_cut(spark, most):
    """Few but long texts, and large groups, are compared in blocks of bounded shingles with the same links."""
    rng = random.Random(9)
    long = [f"l{rng.randrange(10**6)}" for _ in range(1500)]
    rows = near_copies(60)
    for k in range(8):
        own = list(long)
        for _ in range(k):
            own[rng.randrange(1500)] = f"y{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(own)))
    got = tuples(J.classes(documents(spark, rows), limit=20, block=16, shingles_most=most), "doc_id", "class_id", "n_links")
    assert got == brute_classes(rows)


def test_common_by_ranges(monkeypatch):
    rng = np.random.default_rng(3)
    pool = J._mixed(np.arange(5000, dtype=np.uint64))
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 40, 3000, 700, 2500, 0, 900)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for at_once in (1 << 20, 1000, 37):
        monkeypatch.setattr(J, "_AT_ONCE", at_once)
        got = J.common(sets)
        assert (got == want)[~np.eye(len(sets), dtype=bool)].all()  # a set with itself is no pair


def test_recall(spark):
    """Single pairs right at the threshold: what one run misses, the others find."""
    rng = random.Random(2)
    rows = []
    for k in range(0, 600, 2):
        words = [f"a{rng.randrange(10**9)}" for _ in range(104)]
        other = list(words)
        other[50], other[99] = "b", "c"
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    want = brute_classes(rows)
    assert sum(w[2] for w in want) == 600
    got = tuples(J.report(documents(spark, rows)), "doc_id", "class_id", "n_links")
    assert sum(a == b for a, b in zip(got, want)) >= 598


def test_one_of_each(spark):
    df = edge_docs(spark)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got == sorted(map(str, [0, 1, 2, 3, None, None, 4, 6, 7, 8, 10, 12, -1]))
    rows = corpus(100, seed=12)
    classes = brute_classes(rows)
    assert {r.doc_id for r in J.one_of_each(documents(spark, rows)).collect()} == {c[1] for c in classes}
    assert J.one_of_each(empty_docs(spark)).count() == 0 and J.report(empty_docs(spark)).count() == 0


def test_one_of_each_without_ids_and_with_other_columns(spark):
    """Near copies whose ids are null, or equal, are one group; columns of any name come through."""
    base = [f"w{k}" for k in range(150)]
    rows = [(None, " ".join([*base[:20 * k], f"x{k}", *base[20 * k + 1:]])) for k in range(5)]  # any two share 136 or more of 156 shingles
    other = [" ".join(f"{w}{k}" for k in range(120)) for w in ("a", "b")]
    rows += [(7, other[0]), (7, other[0] + " end"), (7, other[1]), (7, other[1]), (8, other[1]), (None, other[1] + " end"), (None, None), (None, " "), (None, " ")]
    names = ["stays", "stay_t", "T", "t_", "place", "place_", "own", "keep_id", "Keep_T", "label", "rep", "first", "a.b", "column_0"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    for n in (1, 3):
        df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema).repartition(n)
        kept = J.one_of_each(df)
        assert kept.columns == df.columns
        got = kept.collect()
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got)
        assert sorted(str(r.doc_id) for r in got) == ["7", "7", "None", "None", "None", "None"]
        assert sum(not (r.text or "").split() for r in got) == 3
        assert {r.text.split()[0][0] for r in got if r.doc_id == 7} == {"a", "b"}


def test_windows_in_a_row_are_one_entry():
    at = lambda pos, n: pos * S._AT + n
    rows = [(1, at(5 + k, 1)) for k in range(300)] + [(2, at(305, 1)), (2, at(307, 1)), (3, at(9, 60)), (3, at(69, 1)), (3, at(70, 1)), (3, at(71, 4))]
    random.Random(1).shuffle(rows)
    doc, where = S._stretches(np.array([d for d, _ in rows]), np.array([a for _, a in rows]))
    assert list(zip(doc.tolist(), where.tolist())) == [(1, at(5, 127)), (1, at(132, 127)), (1, at(259, 46)), (2, at(305, 1)), (2, at(307, 1)), (3, at(9, 60)), (3, at(69, 2)), (3, at(71, 4))]
    empty = np.zeros(0, np.int64)
    assert [len(x) for x in S._stretches(empty, empty)] == [0, 0]
