"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text come first. The list is learned from labelled
rows: a rule grows by the threshold condition of the largest FOIL gain on one
part of the rows, is pruned on the other part, and the rows that it covers
leave before the next rule grows. The list ends as one ordered Spark
conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.textops import SPACE, count_in, lean, mixed, prefix_hash, runs, slices, stretch_hash, sum_in
from loomspan.session import written

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")
#: What rules may test; each is a whole number derived from STATS.
FEATURES = {
    "n_words": "n_words",
    "chars_per_100_words": "100 * word_chars div greatest(n_words, 1)",
    "symbols_per_1000_words": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines_per_1000": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeat_words_per_1000": "1000 * n_repeat_words div greatest(n_words, 1)",
    "words_per_10_lines": "10 * n_words div greatest(n_lines, 1)",
    "upper_per_1000_chars": "1000 * n_upper div greatest(word_chars, 1)",
    "digits_per_1000_chars": "1000 * n_digits div greatest(word_chars, 1)",
    "marks_per_1000_words": "1000 * n_marks div greatest(n_words, 1)",
    "distinct_per_1000_words": "1000 * n_distinct_words div greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _per_text(keys: np.ndarray, where: np.ndarray) -> np.ndarray:
    return mixed(keys + where.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _unique_count(keys: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys in each of n texts."""
    if not len(keys):
        return np.zeros(n, np.int64)
    _, first = np.unique(_per_text(keys, where), return_index=True)
    return np.bincount(where[first], minlength=n)


def text_stats(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each text of a run of rows. Words, lines and windows are compared by 64-bit hashes."""
    n = len(at) - 1
    inside = ~SPACE[data]
    starts, ends = runs(inside, at)
    bounds = np.searchsorted(starts, at)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    prefix = prefix_hash(data)
    words = stretch_hash(prefix, starts, ends)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(bounds), "word_chars": sum_in(inside & lead, at)}
    for name, hit in (("n_symbols", SYMBOLS[data]), ("n_upper", (data >= 65) & (data <= 90)), ("n_digits", (data >= 48) & (data <= 57)), ("n_marks", (data == 33) | (data == 63))):
        out[name] = sum_in(hit, at)
    lines = data != 10
    s, e = runs(lines, at)
    w = np.searchsorted(starts, np.stack([s, e]))
    full = w[1] > w[0]
    s, e = s[full], e[full]
    line_of = np.searchsorted(at, s, side="right") - 1
    out["n_lines"] = np.bincount(line_of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _unique_count(stretch_hash(prefix, s, e), line_of, n)
    out["n_distinct_words"] = _unique_count(words, owner, n)
    repeat = np.zeros(n, np.int64)
    k = len(words) - 4
    if k > 0:
        grams = words[:k].copy()
        for j in range(1, 5):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + k]
        same = np.flatnonzero(owner[:k] == owner[4:])
        grams = _per_text(mixed(grams[same]), owner[same])
        order = np.argsort(grams)
        twin = grams[order][1:] == grams[order][:-1]
        found = np.zeros(len(grams), bool)
        found[order[1:][twin]] = True
        found[order[:-1][twin]] = True
        cover = np.zeros(len(words) + 1, np.int32)
        hit = same[found]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        repeat = sum_in(np.cumsum(cover)[:-1] > 0, bounds)
    out["n_repeat_words"] = repeat
    return out


def stats(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, STATS, carry) of every whole text; a null text has zeros. carry names long columns that stay with their row."""
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = [text_stats(data, at) for _, _, data, at in slices(b.column(1))]
            cols = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in STATS]
            yield pa.record_batch([b.column(0), *map(pa.array, cols), *b.columns[2:]], names=["key", *STATS, *carry])

    schema = f"key {kind}, " + ", ".join(f"{c} long" for c in (*STATS, *carry))
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *carry).mapInArrow(batches, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<=', threshold)."""

    tests: tuple[tuple[str, str, int], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for f, op, v in self.tests:
            hit &= x[f] >= v if op == ">=" else x[f] <= v
        return hit

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {v}" for f, op, v in self.tests)

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {v}" for f, op, v in self.tests)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most_tests: int) -> list[tuple[str, str, int]]:
    tests: list[tuple[str, str, int]] = []
    live = np.ones(len(y), bool)
    while len(tests) < most_tests:
        p, n = int(y[live].sum()), int((~y[live]).sum())
        if not n or not p:
            break
        best, gain = None, 1e-9
        base = np.log2(p / (p + n))
        for f, col in x.items():
            v = col[live]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.cumsum(y[live][order])
            edge = np.flatnonzero(np.append(v[1:] != v[:-1], True))
            for op, cp, ct in (("<=", pos[edge], edge + 1), (">=", p - np.append(0, pos[edge[:-1]]), len(v) - np.append(0, edge[:-1] + 1))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(cp > 0, cp * (np.log2(cp / ct) - base), -1.0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = (f, op, int(v[edge[i]])), float(g[i])
        if best is None:
            break
        tests.append(best)
        f, op, t = best
        live &= x[f] >= t if op == ">=" else x[f] <= t
    return tests


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, precision: float = 0.8, least: int = 8, seed: int = 7) -> list[Rule]:
    """Sequential covering: rules for the bad class, in order; rows under no rule are kept.

    A rule must cover ``least`` rows and reach ``precision`` on the pruning
    part as well as on all rows that are left, else the list ends before it.
    """
    rules: list[Rule] = []
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = left & part, left & ~part
        if not bad[grow].any() or not prune.any():
            break
        tests = _grow({f: c[grow] for f, c in x.items()}, bad[grow], max_tests)
        if not tests:
            break
        held = {f: c[prune] for f, c in x.items()}

        def worth(t: list) -> float:
            hit = Rule(tuple(t)).covers(held)
            p, n = int(bad[prune][hit].sum()), int((~bad[prune])[hit].sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        rule = Rule(tuple(tests))
        hit = rule.covers(x) & left
        share = bad[hit].mean() if hit.any() else 0.0
        mine = rule.covers(held)
        if hit.sum() < least or share < precision or not mine.any() or bad[prune][mine].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: the first matching rule's text, else null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.expr(r.sql()), F.lit(str(r))).otherwise(out)
    return out


def fit(measured: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how) -> list[Rule]:
    """Rules from at most max_labelled labelled rows, those of the smallest hashed key (a bounded sample for the fit alone).

    labels has doc_id and quality (0: bad). Rows whose key or label is null do
    not count; of repeated labels the least does, of repeated documents the row
    with the least statistics. So at most max_labelled rows of ten numbers reach
    the driver. Of rules with equal gain the one of the first feature and the
    lowest threshold is taken.
    """
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = measured.join(F.broadcast(picked), measured.key == picked.doc_id).where(f"not ({BASE_FAILED})")
    rows = rows.select("doc_id", F.struct("quality", *[F.expr(e).cast("long").alias(f) for f, e in FEATURES.items()]).alias("row"))
    rows = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*").toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return learn_rules({f: rows[f].to_numpy() for f in FEATURES}, (rows["quality"] == 0).to_numpy(), **how)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, STATS, carry, base_failed, rule, kept) of every document; carry as in ``stats``.

    kept is false where the base test or a learned rule says so; ``rule`` names
    the rule. Without usable labels the base test stands alone. A null or blank
    text has zeros and fails the base test; repeated rows give repeated results;
    extra columns are ignored; an empty table gives an empty result.
    """
    measured = written(stats(docs, text, key, carry), "quality-stats")
    rules = fit(measured, labels, max_labelled)
    out = measured.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", rule_column(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.withColumnRenamed("key", key)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
