"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

A statement is a line with a word of licensing in it, anywhere in the text. Its terms look up the weighted terms of the templates, and the best
template of `LEAST_COSINE` or more is the statement's license. Blocks of lines are compared in the same way with standard notices and whole licence
texts (`notices`): windows of a template's length, wherever they begin, so notices may be wrapped and commented at will; a word's weight is its
idf over all files. An SPDX identifier names its license outright. The best of all these is the file's own license. A licence file is one
whose statements and licence texts make up at least half of its words, or one with a license of its own and a customary name; a notice alone makes
none. Files are scanned where they are read.

A file without one takes that of the nearest directory above it that holds a licence file. Ancestors are joined for distinct
directories only, one row per directory and level, so a directory with a third of all files is one row until its files
look it up, in a join that splits large partitions.

Defined results: a null or empty text has no statement; a null path has no directory and inherits nothing; ties go to the smaller license name,
and of a directory's licence files to the higher score, then the smaller license name; repeated rows are scanned one by one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yushi.llm.notices import block_templates
from yushi.llm.tables import stored

LEAST_COSINE, LICENSE_FILE_SHARE = 0.6, 0.5
CUES = ("licens", "licenc", "copyright", "public domain", "redistribut", "permission is hereby", "all rights reserved", "spdx-")
BLOCK_CUES = (*CUES, "domain", "permission", "rights", "warrant", "creative commons")
SPDX = re.compile(r"(?i:SPDX-License-Identifier):[ \t]*(\(?[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)")
NAMES = r"(?i)^(licen[cs]e|copying|copyright|notice)([.-].*)?$"

#: What licenses and notices say of themselves.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]


def weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, license, term, weight of length 1) rows, idf by term, idf of a term that no template has."""
    terms = [Counter(re.findall(r"[a-z0-9]+", t.lower())) for _, t in templates]
    df = Counter(x for c in terms for x in c)
    n = len(templates)
    idf = {x: math.log((1 + n) / (1 + k)) + 1 for x, k in df.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, terms)):
        norm = math.sqrt(sum((v * idf[x]) ** 2 for x, v in c.items()))
        rows += [(k, name, x, c[x] * idf[x] / norm) for x in sorted(c)]
    return rows, idf, math.log(1 + n) + 1


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def identifiers(text: str) -> list[str]:
    """SPDX expressions of a text, with the names that the templates use."""
    short = lambda m: re.sub(r"(-only|-or-later|\+)$", "", m[0])
    return [re.sub(r"[A-Za-z0-9.+-]+", short, x) for x in SPDX.findall(text)]


class Blocks:
    """The blocks of a text that are nearest to templates: windows of as many words as a template has."""

    def __init__(self, templates: list[tuple[str, str, bool]], n_files: int, held: dict[str, int]):
        """held: files that hold a word of the templates; a word that no template has counts as one of a single file."""
        terms = [words(t) for _, t, _ in templates]
        self.number = {x: k for k, x in enumerate(sorted({x for t in terms for x in t}))}
        known = np.array([held.get(x, 0) for x in self.number])
        self.idf = np.log((1 + n_files) / (1 + np.minimum(known, n_files))) + 1
        self.other = math.log((1 + n_files) / (1 + min(1, n_files))) + 1
        self.templates = []
        for (name, _, whole), t in zip(templates, terms):
            w = np.bincount([self.number[x] for x in t], minlength=len(self.number)) * self.idf
            self.templates.append((name, whole, len(t), np.append(w / np.sqrt(w @ w) * self.idf, 0.0)))
        self.square = np.append(self.idf, self.other) ** 2

    def find(self, lines: list[str]) -> list[tuple[float, str, bool, int, int]]:
        """Cosine, license, whether it is a licence text, first and last line of the best block of each template that has a good one."""
        own = [words(x) for x in lines]
        n = sum(map(len, own))
        if not n:
            return []
        other = len(self.number)
        strange: dict[str, int] = {}
        # words of no template are numbered behind the others, so that each counts by itself
        ids = np.fromiter((self.number[x] if x in self.number else other + strange.setdefault(x, len(strange)) for t in own for x in t), np.int64, n)
        line = np.repeat(np.arange(len(own)), [len(t) for t in own])
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        short = np.minimum(ids, other)
        norms = np.concatenate([[0.0], np.cumsum(self.square[short])])
        out = []
        for name, whole, length, w in self.templates:
            size = min(length, n)
            at = np.arange(0, n - size + 1, max(1, length // 8))
            at = np.union1d(np.minimum(np.union1d(at, starts), n - size), [n - size])
            dots = np.concatenate([[0.0], np.cumsum(w[short])])
            dot = dots[at + size] - dots[at]
            bound = dot / np.sqrt(norms[at + size] - norms[at])  # a word said twice makes the block longer than this
            top, best = LEAST_COSINE, None
            for k in np.argsort(-bound, kind="stable").tolist():
                if bound[k] < top - 1e-6:
                    break
                a = int(at[k])
                x, c = np.unique(ids[a:a + size], return_counts=True)
                score = round(float(dot[k] / math.sqrt((c * c * self.square[np.minimum(x, other)]).sum())), 6)
                if score > top or (best is None and score == top):
                    top, best = score, (score, name, whole, int(line[a]), int(line[a + size - 1]))
            if best:
                out.append(best)
        return out


def texts_only(blocks: list[tuple[float, str, bool, int, int]]) -> list[tuple[int, int]]:
    """First and last line of the licence texts, without those that are rather a notice: half of their lines or more are in a nearer one."""
    notices = [b for b in blocks if not b[2]]
    inside = lambda b, n: 2 * (min(b[4], n[4]) - max(b[3], n[3]) + 1) >= b[4] - b[3] + 1
    return [b[3:] for b in blocks if b[2] and not any(n[0] > b[0] and inside(b, n) for n in notices)]


class Scanner:
    """Statements and blocks of a text and their cosines; nothing but the templates is kept between texts."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, blocks: Blocks | None = None):
        self.blocks = blocks
        rows, self.idf, self.other = weights(templates)
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.license: dict[int, str] = {}
        for k, name, term, w in rows:
            self.by_term.setdefault(term, []).append((k, w))
            self.license[k] = name

    def cosine(self, terms: list[str]) -> tuple[float, str | None]:
        """The best template's cosine and license."""
        dots: dict[int, float] = {}
        square = 0.0
        for x, n in sorted(Counter(terms).items()):
            w = n * self.idf.get(x, self.other)
            square += w * w
            for k, v in self.by_term.get(x, ()):
                dots[k] = dots.get(k, 0.0) + w * v
        best = min(((-round(d / math.sqrt(square), 6), self.license[k]) for k, d in dots.items()), default=(0.0, None))
        return -best[0], best[1]

    def scan(self, text: str | None) -> tuple[str | None, float | None, bool]:
        """License, score, and whether half of the words are statements."""
        low = text.lower() if text else ""
        if not any(c in low for c in BLOCK_CUES):
            return None, None, False
        lines = text.split("\n")
        said, best = set(), (-LEAST_COSINE, None)
        for k, line in enumerate(lines):
            low = line.lower()
            if any(c in low for c in CUES):
                score, name = self.cosine(re.findall(r"[a-z0-9]+", low))
                if name and score >= LEAST_COSINE:
                    said.add(k)
                    best = min(best, (-score, name)) if best[1] else (-score, name)
        blocks = self.blocks.find(lines) if self.blocks else []
        for score, name, *_ in blocks:
            best = min(best, (-score, name)) if best[1] else (-score, name)
        for first, last in texts_only(blocks):
            said.update(range(first, last + 1))
        for name in identifiers(text) if self.blocks else ():
            best = min(best, (-1.0, name)) if best[1] else (-1.0, name)
        if best[1] is None:
            return None, None, False
        return best[1], -best[0], sum(len(lines[k].split()) for k in said) >= LICENSE_FILE_SHARE * len(text.split())


def held(files: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each word of the vocabulary."""

    def run(batches):
        for b in batches:
            n = Counter({"": b.num_rows})
            for t in b.column(0).to_pylist():
                n.update(vocabulary.intersection(words(t or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    found = {r.term: r.n for r in files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


def own(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, dir, license, score, is_license_file: one row per file, decided in the task that reads it."""
    standard = block_templates()
    sent = files.sparkSession.sparkContext.broadcast((standard, *held(files, {x for _, t, _ in standard for x in words(t)})))

    def run(batches):
        scanner, named = Scanner(templates, Blocks(*sent.value)), re.compile(NAMES)
        for b in batches:
            paths = b.column(1).to_pylist()
            found = [scanner.scan(t.as_py()) for t in b.column(2)]
            dirs = [None if p is None else p.rpartition("/")[0] for p in paths]
            lic = [f[0] is not None and p is not None and (f[2] or bool(named.match(p.rpartition("/")[2]))) for p, f in zip(paths, found)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dirs, pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(lic, pa.bool_())],
                ["doc_id", "path", "dir", "license", "score", "is_license_file"],
            )

    return files.select(F.col("doc_id").cast("long"), "path", "text").mapInArrow(run, "doc_id long, path string, dir string, license string, score double, is_license_file boolean")


def ancestors(column: str) -> Column:
    """The directory itself and all above it, with their depths."""
    steps = F.split(column, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("above"), k.alias("depth")))


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned with the license of the nearest directory that has one: inherited, inherited_from."""
    held = scanned.filter("is_license_file").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license"))["license"].alias("inherited"))
    dirs = scanned.filter(F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.inline(ancestors("dir")))
    near = dirs.join(held, "above").groupBy("dir").agg(F.max(F.struct("depth", "inherited", F.col("above").alias("inherited_from"))).alias("n")).select("dir", "n.inherited", "n.inherited_from")
    return scanned.join(near, "dir", "left")


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, license, score, is_license_file, inherited_from, final_license."""
    rows = inherit(stored(own(files, templates), "licenses"))
    return rows.select(
        "doc_id", "path", "license", "score", "is_license_file",
        F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"), F.coalesce("license", "inherited").alias("final_license"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source, language and thousand of the id are their directories."""
    step = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    path = F.concat_ws("/", step("source"), step("lang"), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def report(docs: DataFrame) -> DataFrame:
    return scan(as_files(docs))
