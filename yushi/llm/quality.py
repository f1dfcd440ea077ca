"""Quality rules as a ledger of failure bits.

Each text is measured once; each rule is one SQL condition over the measures and sets one bit of `fail_bits`. A policy
is a versioned set of rules, that is a mask: applying or changing one needs the ledger only. Ablations (what a rule
decides alone, what comes back without it) are sums over the few distinct bit patterns.

Defined results: a null or empty text has no words, so every measure is 0 and `few_words` fails; a null doc_id stays a row;
repeated rows are judged one by one; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from yushi.llm.tables import by_place, ready, utf8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim", "n_marks"]

#: Rule k sets bit k. Conditions are valid in Spark SQL and in DuckDB.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "n_upper > n_lower"),
    ("exclamations", "5 * n_exclaim > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("marks", "10 * n_marks > 4 * word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Policies by version; a version never changes once it is used.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"

WINDOW = 5
_SPACES = b" \t\n\x0b\x0c\r"
_BYTES = np.arange(256)
_IS = {
    "n_symbols": np.isin(_BYTES, list(b"#*$%&|<>")),
    "n_upper": (_BYTES >= 65) & (_BYTES <= 90),
    "n_lower": (_BYTES >= 97) & (_BYTES <= 122),
    "n_exclaim": _BYTES == 33,
    "n_marks": (_BYTES > 32) & (_BYTES < 127) & ~np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "word_chars": ~np.isin(_BYTES, list(_SPACES)) & ((_BYTES < 128) | (_BYTES > 191)),
}
_CLASSES = np.stack([_IS[k] for k in _IS]).astype(np.int64)
_PIECE = 1 << 20


def _words(text: bytes):
    """Words of the text, a piece of about a megabyte at a time."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and text[end] not in _SPACES:
            end += 1
        yield text[at:end].split()
        at = end


def _repeated(text: bytes) -> tuple[int, int]:
    """Words, and words in windows that occur twice or more."""
    hashes = [np.fromiter(map(hash, w), np.int64, len(w)) for w in _words(text)]
    h = np.concatenate(hashes).view(np.uint64) if hashes else np.zeros(0, np.uint64)
    m = len(h) - WINDOW + 1
    if m < 2:
        return len(h), 0
    g = h[:m].copy()
    for k in range(1, WINDOW):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        g += h[k:k + m]
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return len(h), 0
    starts = np.flatnonzero(np.isin(g, twice))
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return len(h), int(np.count_nonzero(np.cumsum(edge[:-1])))


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(texts), np.int64) for k in MEASURES}
    for i, t in enumerate(texts):
        if not t:
            continue
        classes = _CLASSES @ np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        for k, v in zip(_IS, classes):
            out[k][i] = v
        out["n_words"][i], out["n_repeat_words"][i] = _repeated(t)
        out["n_lines"][i], out["n_dup_lines"][i] = _lines(t)
    return out


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns and rows of docs with the measures behind them; the names the measures got."""
    names = {m: _free(m, docs.columns) for m in MEASURES}
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names.values())])
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            m = measure(utf8(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m[k]) for k in MEASURES)], [*b.schema.names, *names.values()])

    return docs.mapInArrow(run, schema), names


def fail_bits(names: dict[str, str] | None = None) -> Column:
    """One bit for each rule that fails."""
    bits = F.lit(0).cast("long")
    for rule, condition in RULES:
        for m, n in sorted((names or {}).items(), key=lambda x: -len(x[0])):
            if m != n:
                condition = condition.replace(m, f"`{n}`")
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[rule])).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measure, fail_bits: one row per input row."""
    rows, _ = measured(docs.select("doc_id", "text"))
    return rows.select("doc_id", *MEASURES, fail_bits().alias("fail_bits"))


def mask(policy: str = CURRENT) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy accepts, with the columns of docs."""
    columns, docs = docs.columns, by_place(docs)
    rows, names = measured(docs)
    wanted = fail_bits(names).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0
    return rows.filter(wanted).select(*docs.columns).toDF(*columns)


def patterns(led: DataFrame) -> DataFrame:
    """Documents and words by failure pattern: at most one row per combination of bits."""
    return led.groupBy("fail_bits").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("words"))


def ablation(led: DataFrame, policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: failing, rejected by this rule alone, kept with and without the rule.

    An empty ledger gives no rows."""
    cases = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.lit(sum(BIT[x] for x in rules)).cast("long").alias("mask"))
        for p, rules in policies.items() for r in rules
    ])
    b = F.col("fail_bits").bitwiseAND(F.col("mask"))
    docs = lambda when: F.sum(F.when(when, F.col("n_docs")).otherwise(0))
    return (
        patterns(led).select("*", F.inline(cases)).groupBy("policy", "rule")
        .agg(
            docs(b.bitwiseAND(F.col("bit")) != 0).alias("failing"),
            docs(b == F.col("bit")).alias("only_this"),
            docs(b == 0).alias("kept"),
            docs((b == 0) | (b == F.col("bit"))).alias("kept_without"),
            F.sum(F.when(b == F.col("bit"), F.col("words")).otherwise(0)).alias("words_back"),
        )
    )


def judged(docs: DataFrame) -> DataFrame:
    """The ledger with the base rule and the verdict of the current policy."""
    led = ledger(docs)
    base = ~passes("base")
    return led.select("doc_id", *MEASURES, "fail_bits", base.alias("base_failed"), (~base & passes(CURRENT)).alias("kept"))


def drop_rejected(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy accepts."""
    ready(spark)
    return keep(docs, CURRENT)
