"""Quality ledger, line dedup, license scan, URL filter, language ID."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cases import corpus, documents, edge_docs, edge_rows, empty_docs, tuples
from yushi.llm import language, licenses, lines, quality, urls

SPACE = " \t\n\r\x0b\x0c"


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    said = [x for x in t.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(said) - len(set(said)), len(inside)


@pytest.mark.parametrize("rows", [edge_rows(), [(d, t) for d, t in corpus(80)]], ids=["odd", "corpus"])
def test_measures(spark, rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = tuples(quality.judged(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in rows:
        m = brute_quality(r[1])
        want.append((r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want, key=str)


def test_ledger_policies_and_ablation(spark):
    led = quality.ledger(edge_docs(spark).unionByName(edge_docs(spark))).cache()
    rows = led.collect()
    for policy, rules in quality.POLICIES.items():
        mask = sum(quality.BIT[r] for r in rules)
        assert led.filter(quality.passes(policy)).count() == sum(not r.fail_bits & mask for r in rows)
    got = {(r.policy, r.rule): r for r in quality.ablation(led).collect()}
    for policy, rules in quality.POLICIES.items():
        mask = sum(quality.BIT[r] for r in rules)
        for rule in rules:
            bit, r = quality.BIT[rule], got[policy, rule]
            assert r.only_this == sum(x.fail_bits & mask == bit for x in rows)
            assert r.kept_without == sum(not x.fail_bits & mask & ~bit for x in rows)
            assert r.words_back == sum(x.n_words for x in rows if x.fail_bits & mask == bit)
    assert quality.ablation(quality.ledger(empty_docs(spark))).count() == 0


def test_keep_is_row_by_row(spark):
    df = edge_docs(spark)
    kept = quality.keep(df)
    assert kept.columns == df.columns
    want = [r for r in quality.judged(df).collect() if r.kept]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in want)
    assert quality.keep(empty_docs(spark)).count() == 0


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    n, last = Counter(), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] += 1
            last[k] = d if k not in last or last[k] is None or (d is not None and d > last[k]) else last[k]
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (len(key(x)) >= 20 and n[key(x)] >= 3 and last[key(x)] != d)]
        out.append((d, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in edge_rows()], corpus(150, seed=4)], ids=["odd", "corpus"])
def test_line_dedup(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(lines.line_report(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)


def test_line_dedup_empty_and_wide(spark):
    assert lines.line_report(empty_docs(spark)).count() == 0
    assert lines.line_report(edge_docs(spark)).count() == len(edge_rows())


def test_filter_rounds_give_the_same(spark, monkeypatch):
    df = documents(spark, corpus(150, seed=4))
    want = tuples(lines.line_report(df), "doc_id", "kept_sha256")
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    monkeypatch.setattr(lines, "FILTER_BYTES", 64)
    assert tuples(lines.line_report(df), "doc_id", "kept_sha256") == want


def test_counts_are_reversible(spark):
    rows = corpus(60, seed=2)
    a, b = documents(spark, rows[:40]), documents(spark, rows[40:])
    ab = lines.add(lines.holders(a), lines.holders(b))
    back = lines.remove(ab, lines.holders(b))
    assert tuples(back, "k1", "k2", "doc_id", "n") == tuples(lines.holders(a), "k1", "k2", "doc_id", "n")
    assert tuples(lines.counts_of(ab), "k1", "k2", "n_docs", "max_doc") == tuples(lines.count_lines(documents(spark, rows)), "k1", "k2", "n_docs", "max_doc")


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    k1, k2 = rng.integers(-2**62, 2**62, 3000), rng.integers(-2**62, 2**62, 3000)
    f = lines.Cuckoo.holding(k1, k2)
    assert f.holds(k1, k2).all()
    other = rng.integers(-2**62, 2**62, 20_000)
    assert f.holds(other, other[::-1].copy()).mean() < 0.01
    for a, b in zip(k1[:1500].tolist(), k2[:1500].tolist()):
        assert f.delete(a, b)
    assert f.holds(k1[1500:], k2[1500:]).all() and f.holds(k1[:1500], k2[:1500]).mean() < 0.02


def test_filters_follow_changes(spark):
    keys = lines.count_lines(documents(spark, corpus(80, seed=6))).select("k1", "k2").cache()
    half = keys.filter("k1 % 2 = 0")
    family = lines.update(lines.filters(keys, 3), keys.filter("k1 % 2 <> 0"), half.limit(0), half, 3)
    by = {r.shard: lines.Cuckoo(r.n_buckets, np.frombuffer(r.cells, np.uint16).reshape(-1, 4)) for r in family.collect()}
    stay = keys.filter("k1 % 2 <> 0").toPandas()
    assert all(by[(a >> 20) % 3].holds(np.array([a]), np.array([b]))[0] for a, b in zip(stay.k1, stay.k2))


def known(family, keys, n_shards):
    by = {r.shard: lines.Cuckoo(r.n_buckets, np.frombuffer(r.cells, np.uint16).reshape(-1, 4)) for r in family.collect()}
    return [(a >> 20) % n_shards in by and bool(by[(a >> 20) % n_shards].holds(np.array([a]), np.array([b]))[0]) for a, b in keys]


def test_filters_grow_when_they_run_over(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b)) for a, b in rng.integers(-2**62, 2**62, (2900, 2))]
    keys = spark.createDataFrame(rows, "k1 long, k2 long")
    first, more = spark.createDataFrame(rows[:900], keys.schema), spark.createDataFrame(rows[900:], keys.schema)
    assert all(known(lines.update(lines.filters(first, 1), keys, more, more.limit(0), 1), rows, 1))
    assert all(known(lines.update(lines.filters(first, 7).filter("shard = 0"), keys.filter(lines._shard(7) == 0), more.filter(lines._shard(7) == 0), more.limit(0), 7), [r for r in rows if (r[0] >> 20) % 7 == 0], 7))


def test_batches_come_and_go(spark):
    """After each batch the table is that of the documents then there, the filters know every line to act on, and a document that is not named keeps its text."""
    rows = corpus(90, seed=13) + [(None, "a line that many documents have, with or without an id")] + [(k, "a line that many documents have, with or without an id") for k in (200, 201)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    table, family, there = lines.holders(make([])), lines.filters(lines.count_lines(make([])).select("k1", "k2"), 2), []
    texts = {}
    for batch, delete in ((rows[:50], False), (rows[50:], False), (rows[20:60] + rows[-1:], True), ([], True)):
        table, family, again = lines.apply_batch(table, family, make(batch), 2, delete)
        there = [r for r in there if r not in batch] if delete else there + batch
        assert tuples(table, "k1", "k2", "doc_id", "n") == tuples(lines.holders(make(there)), "k1", "k2", "doc_id", "n")
        assert all(known(family, [(r.k1, r.k2) for r in lines.hot_keys(table).collect()], 2))
        named, before = {r.doc_id for r in again.collect()}, texts
        texts = {d: x for d, *x in brute_lines(there)}
        assert {d for d in texts if texts[d] != before.get(d)} <= named <= set(texts)
        assert not batch or any(d in before and texts[d] != before[d] for d in texts) or not before


def test_licenses(spark):
    text = "some code\n// Licensed under the Apache License, Version 2.0.\n" + "more code of this file\n" * 9
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "a/b/c/x.py", "print()"),
        (3, "a/b/c/y.py", text), (4, "a/b/NOTES", "This work is licensed under the GNU General Public License, version 3."), (5, "z/q.py", "nothing here"), (6, None, "Released under the MIT License."),
        (7, "a/n.txt", None), (8, "a/n.txt", ""), (8, "a/n.txt", ""), (9, "top.txt", "licensed"),
    ]
    df = spark.createDataFrame([(*r, "mine", 1.0) for r in rows], "doc_id long, path string, text string, license string, score double")
    got = {(r.doc_id): (r.license, r.inherited_from, r.final_license) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", None, "MIT") and got[3] == ("Apache-2.0", None, "Apache-2.0") and got[6] == ("MIT", None, "MIT")
    assert got[2] == (None, "a/b", "GPL-3.0")
    assert got[7] == (None, "a", "MIT") and got[8] == (None, "a", "MIT") and got[5] == (None, None, None) and got[9][2] is None
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
    assert licenses.report(edge_docs(spark)).count() == len(edge_rows())


def test_wrapped_notices_and_licence_files(spark):
    import textwrap

    from yushi.llm.notices import HEADERS, SHORT_TEXTS, TEXTS, block_templates

    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 50))
    code = "\n".join(f"value_{k} = compute({k}, other) + rows[{k}]  # the next step of the plan" for k in range(60))
    rows, want = [], {}

    def add(path, text, name):
        want[len(rows)] = name
        rows.append((len(rows), path, text))

    for k, (name, t) in enumerate(HEADERS[:2] + HEADERS[3:]):
        for mark in ("# ", " * ", "// "):
            add(f"src/{k}.py", f"#!/usr/bin/env python\n{mark}Copyright (C) 2019 Some Body\n{wrap(t, mark)}\n\n{code}", name)
    whole = {n: t for n, t, w in block_templates() if w and n in TEXTS and len(t) > 2000}
    for name in TEXTS:
        add(f"{name}/a.txt", whole[name], name)
        add(f"head_{name}/LICENSE", "\n".join(whole[name].split("\n")[:15]), name)
        add(f"{name}/deep/x.py", code, None)
    for name, t in SHORT_TEXTS:
        add(f"{name}/t.txt", "Copyright 2011 A. Holder\n\n" + wrap(t, ""), name)
    for line, name in (("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
                       ("# SPDX-License-Identifier: LGPL-2.1-or-later OR MIT", "LGPL-2.1 OR MIT")):
        add("spdx/x.c", f"{line}\n{code}", name)
    add("short/x.py", wrap(HEADERS[1][1], "# ") + "\nimport os", "Apache-2.0")
    add("none/x.py", code + "\nwe have the rights and the permission to redistribute this copyright story about a license\n" + code, None)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: r.license for k, r in got.items()} == want
    for k, path, _ in rows:
        assert got[k].is_license_file == path.endswith((".txt", "/LICENSE")), path
        if "/deep/" in path:
            assert got[k].final_license == path.split("/")[0]


def test_whole_licences_behind_any_number_of_lines():
    """A licence of thousands of words is found word for word at every line it can begin at."""
    standard = licenses.block_templates()
    name, text, _ = max(standard, key=lambda x: len(x[1]))
    assert len(licenses.words(text)) > 2000
    blocks = licenses.Blocks(standard, 10, {})
    for before in (1, 3, 50, 77):
        lines = [*(f"first words {k}" for k in range(before)), *text.split("\n"), "words behind"]
        score, found, whole, first, last = max(blocks.find(lines))
        assert score > 0.999999 and found == name and whole and first >= before and last < len(lines) - 1


def test_template_finds_itself():
    s = licenses.Scanner()
    for name, t in licenses.TEMPLATES:
        score, found = s.cosine(re.findall(r"[a-z0-9]+", t.lower()))
        assert score > 0.999 and found == name


URLS = [
    None, "", "no scheme/en/", "http://example.com/en/1", "HTTP://WWW.EXAMPLE.COM/en/1", "http://www.example.com", "http://a.b.net/es/?q=//x", "http://net/fr/", "http://xnet/fr/",
    "http://notexample.com/en/", "x://m.example.com:80/en/", "http:///en/", "http://a.net/ES/1", "http://b.org/casino/1", "http://com/", "http://casinos.org/x", "a://b://c.com/d#casino",
    "http://b.com/casino/1", "http://q.org/wp-login.php", "http://q.org/?SESSIONID=1", "http://example.com/english",
]


def test_urls(spark):
    df = spark.createDataFrame([(k % 15, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rows = urls.judged(df).collect()
    assert len(rows) == len(URLS)
    index = urls.Index(urls.RULES, {})
    for u in URLS:
        host, path = urls.split(u)
        fits = [(len(r), v, r) for v, r in urls.SITES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        want = max(fits, default=None)
        got = index.judge(u)
        assert got[:2] == (host, path) and got[2] == (want[2] if want else None), u
        if want:
            assert got[3] == want[1]
    assert index.judge("http://b.org/casino/1")[3] == "block" and index.judge("http://casinos.org/x")[3] == "allow" and index.judge("http://q.org/wp-login.php")[4] == "wp-login"
    assert index.judge("http://b.com/casino/1")[3] == "allow" and index.judge("http://q.org/?SESSIONID=1")[3] == "block"
    assert urls.judged(df.limit(0)).count() == 0


def test_rare_tokens_find_what_all_rules_find():
    counts = {"com": 10**6, "en": 10**5, "net": 10**6}
    index, every = urls.Index(urls.RULES, counts), urls.Index([urls.Rule(r.name, r.pattern, r.verdict, (), r.on) for r in urls.RULES], {})
    assert index.by_token["example"] and "com" in index.by_token and not index.always
    for u in URLS:
        assert index.judge(u) == every.judge(u)


def many_rules(rng):
    """Thousands of site rules on hosts below one another, words, and expressions without any literal."""
    part = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    hosts = [".".join(part() for _ in range(rng.randint(1, 3))) + ".com" for _ in range(3000)]
    rules = [urls.site(rng.choice(["allow", "block"]), f"{h}/{rng.choice(['', part() + '/', part()])}") for h in hosts]
    rules += [urls.word("block", f"word{k}") for k in range(500)] + [urls.Rule("digits", r"[0-9]{6}", "block", (), "url"), urls.Rule("let", "a", "allow", (), "url")]
    rng.shuffle(rules)
    made = [f"http://{rng.choice(hosts) if rng.random() < 0.6 else part() + '.org'}/{part()}/{rng.choice(['', f'word{rng.randrange(900)}', str(rng.randrange(10**7))])}" for _ in range(300)]
    return rules, made + URLS


def brute_verdict(rules, url):
    host, path = urls.split(url)
    if url is None:
        return "", "", None, "allow", None
    best = None
    for r in rules:
        at, _, start = r.name.partition("/")
        if r.on == "site" and host and (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            if best is None or (len(r.name), len(at)) > (len(best.name), len(best.name.partition("/")[0])):
                best = r
    if best:
        return host, path, best.name, best.verdict, None
    low = url.translate(urls._UPPER)
    worst = next((r.name for r in rules if r.on == "url" and r.verdict == "block" and re.search(r.pattern, low)), None)
    return host, path, None, "block" if worst else "allow", worst


@pytest.mark.parametrize("most", [urls.BLOCK_CHARS, 60_000])
def test_thousands_of_rules_are_brute_force(spark, most):
    rules, made = many_rules(random.Random(6))
    assert (len(list(urls.blocks(rules, most))) > 2) == (most < urls.BLOCK_CHARS)
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in urls.judged(df, rules, most).collect()}
    want = {k: brute_verdict(rules, u) for k, u in enumerate(made)}
    assert got == want and {v[3] for v in want.values()} == {"allow", "block"} and sum(v[4] is not None for v in want.values()) > 10


def test_rules_of_any_number(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    assert tuples(urls.judged(df, []), "page_id", "rule", "verdict") == [(1, None, "allow"), (2, None, "allow")]
    index = urls.Index([urls.word("block", f"w{k}") for k in range(9)], {})
    assert not index.compiled and index.judge("http://a.com/w3")[4] == "w3" and list(index.compiled) == [3]


def brute_languages(rows, most):
    """Dictionaries and sizes in plain Python: doc_id, language, margin."""
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    place = lambda d: int.from_bytes(xxhash.xxh64(struct.pack("<q", d), seed=42).digest(), "big", signed=True)
    packers = {}
    for lang in sorted({lang for d, t, lang in rows if t and lang and fold(d) != 2}):
        content, size = [], 0
        for d, t in sorted(((d, t) for d, t, x in rows if t and x == lang and fold(d) != 2), key=lambda x: (place(x[0]), x[0]))[:language.SAMPLE_ROWS]:
            if size >= most:
                break
            size += len(t.encode())
            content.append(language.plain(t.encode()[:most].decode(errors="ignore")))
        d = zstandard.ZstdCompressionDict(b"\n".join(content)[:most], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for d, t, _ in rows:
        sizes = []
        if t and any(c.isalpha() for c in t):
            b = language.plain(t)
            sizes = sorted((sum(len(z.compress(b[i:i + language.PIECE])) for i in range(0, len(b), language.PIECE)), lang) for lang, z in packers.items())
        out.append((d, sizes[0][1], round((sizes[1][0] - sizes[0][0]) / sizes[1][0], 9)) if len(sizes) > 1 else (d, "und", 0.0))
    return sorted(out)


@pytest.mark.parametrize("all_dicts", [language.ALL_DICTS, 20_000])
def test_language_is_brute_force(spark, monkeypatch, all_dicts):
    monkeypatch.setattr(language, "ALL_DICTS", all_dicts)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in df.collect()]
    n = len({x for d, t, x in rows if t and x and zlib.crc32(str(d).encode()) % 4 != 2})
    most = min(language.DICT_BYTES, all_dicts // n)
    content = language.fit(df.filter(language.fold() != 2))
    assert len(content) == n and max(map(len, content.values())) <= most and (all_dicts > 10**6 or sum(map(len, content.values())) > all_dicts // 2)
    got = sorted((r.doc_id, r.lang_pred, round(r.margin, 9)) for r in language.report(df).collect())
    assert got == brute_languages(rows, most)


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.report(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    got = language.report(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    assert {r.lang_pred for r in got} <= {"und", "en", "es", "fr", "de"}
    assert language.report(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.report(unlabelled).collect()} == {"und"}


def test_language_rejects_narrow_margins(spark):
    df = spark.createDataFrame([(1, "hello there", "en")], "doc_id long, text string, lang string")
    content = {"aa": b"some words", "bb": b"some words"}
    assert [r.lang for r in language.identify(df, content).collect()] == ["und"]
