"""Problem 10: repetition inside a single document.

Every document gets repetition statistics (shares of repeated words, lines and word runs of several lengths). A decision
list learned from labelled statistics says which documents are repetitive: sequential covering grows threshold
conjunctions by information gain, prunes them on held-out rows, and emits one ordered Spark conditional expression.
Labels come from the words themselves, compared one by one, on a bounded sample; documents whose statistics fall between
the labelled classes are labelled next, until none is left between them. The list then decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabularium.functions.segment import let
from tabularium.llm.words import distinct_runs, picked, runs, word_hashes
from tabularium.plans.staging import staged
from tabularium.sources.tables import table

RUNS = (1, 3, 5, 10)
STATISTICS = ("n_words", "rep_line", "rep_run1", "rep_run3", "rep_run5", "rep_run10", "top_run5")
#: Rows that are labelled at first, and at most in each later round; rounds at most. Every row is scored.
SAMPLE_ROWS, ROUNDS = 20_000, 4


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lines, texts = batch.columns
        flat, bounds = word_hashes(texts)
        n = len(texts)
        out = {"n_words": np.diff(bounds)}
        for k in RUNS:
            hashes, owner = runs(flat, bounds, k)
            _, texts_of, times = distinct_runs(hashes, owner, n)
            total = np.bincount(owner, minlength=n)
            out[f"rep_run{k}"] = np.where(total > 0, 1 - np.bincount(texts_of, minlength=n) / np.maximum(total, 1), 0.0)
            if k == 5:
                top = np.zeros(n)
                np.maximum.at(top, texts_of, times)
                out["top_run5"] = np.where(total > 1, (top - 1) / np.maximum(total - 1, 1), 0.0)
        columns = [lines if s == "rep_line" else pa.array(out[s]) for s in STATISTICS]
        yield pa.RecordBatch.from_arrays([keys, *columns], names=["_key", *STATISTICS])


def repetition_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the statistics of each row; shares lie in [0, 1).

    ``rep_runN`` is 1 - distinct runs of N words / all of them, ``rep_line`` the same of lines with a letter or digit,
    ``top_run5`` the share of the commonest run of five beyond its first. What a text is too short for is 0, so a null
    or empty text has only zeros. One pass over the texts, nothing is shuffled.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    n = F.size(lines)
    repeated = F.when(n > 0, 1 - F.size(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(F.trim(x))))) / n).otherwise(F.lit(0.0))
    kind = df.schema[key].dataType.simpleString()
    inner = df.select(F.col(key).alias("_key"), F.coalesce(repeated, F.lit(0.0)).alias("rep_line"), F.col(text))
    types = ", ".join(f"{s} {'bigint' if s == 'n_words' else 'double'}" for s in STATISTICS)
    return inner.mapInArrow(_measure, f"_key {kind}, {types}").withColumnRenamed("_key", key)


Rule = list[tuple[int, bool, float]]  # conditions: statistic, above (else at most), threshold


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, t in rule:
        ok &= (x[:, f] > t) if above else (x[:, f] <= t)
    return ok


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[int, bool, float]] | None:
    """The threshold of highest gain; it lies on an observed value, so values between two classes count as positive."""
    p0, n0 = int(y.sum()), int((~y).sum())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        low_p = pos[edge]
        low_n = edge + 1 - low_p
        for above, p, n, t in ((True, p0 - low_p, n0 - low_n, v[edge]), (False, low_p, low_n, np.nextafter(v[edge + 1], -np.inf))):
            g = _gain(p, n, p0, n0)
            i = int(np.argmax(g))
            if g[i] > 1e-9 and (best is None or g[i] > best[0]):
                best = (float(g[i]), (f, above, float(t[i])))
    return best


def _settled(rule: Rule, x: np.ndarray, y: np.ndarray, left: np.ndarray) -> Rule:
    """The rule with each threshold moved, by all rows that are left, to where it errs least.

    Of several such places the one next to the negatives, so that what lies between two classes counts as positive.
    """
    for k, (f, above, t) in enumerate(rule):
        inside = left & _holds(rule[:k] + rule[k + 1 :], x)
        order = np.argsort(x[inside, f], kind="stable")
        v, pos = x[inside, f][order], y[inside][order]
        if not len(v):
            continue
        edge = np.flatnonzero(v[1:] > v[:-1])
        low_p, low_n = np.cumsum(pos)[edge], np.cumsum(~pos)[edge]
        wrong = low_p + (~pos).sum() - low_n if above else pos.sum() - low_p + low_n
        if len(edge):
            best = np.flatnonzero(wrong == wrong.min())
            now = int((pos[v <= t].sum() + (~pos[v > t]).sum()) if above else (pos[v > t].sum() + (~pos[v <= t]).sum()))
            if wrong.min() <= now:
                i = edge[best[0] if above else best[-1]]
                rule = [*rule[:k], (f, above, float(v[i]) if above else float(np.nextafter(v[i + 1], -np.inf))), *rule[k + 1 :]]
    return rule


def learn_decision_list(x: np.ndarray, y: np.ndarray, max_conditions: int = 4, seed: int = 7) -> list[tuple[Rule, float]]:
    """Ordered rules for the positive class with their precision on held-out rows; no rule means negative.

    A rule grows on two thirds of the rows until it covers no negative, loses its last conditions while that doesn't
    worsen (p - n) / (p + n) on the other third, and is kept if it is right on at least half of what it covers there.
    """
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 1 / 3
    left, rules = np.ones(len(y), bool), []
    while (left & y & ~held).any():
        grow, prune = left & ~held, left & held
        rule: Rule = []
        inside = grow.copy()
        while (inside & ~y).any() and len(rule) < max_conditions:
            found = _best_condition(x[inside], y[inside])
            if found is None:
                break
            rule.append(found[1])
            inside = grow & _holds(rule, x)
        if not rule:
            break

        def worth(r: Rule) -> float:
            got = prune & _holds(r, x)
            p, n = int((got & y).sum()), int((got & ~y).sum())
            return (p - n) / (p + n) if p + n else -1.0

        scores = [worth(rule[:k]) for k in range(1, len(rule) + 1)]
        keep = int(np.argmax(scores)) + 1 if max(scores) > -1 else len(rule)
        rule = _settled(rule[:keep], x, y, left)
        covered = left & _holds(rule, x)
        exact = (covered & y).sum() / max(covered.sum(), 1)
        if exact < 0.5 or not (covered & y).any():
            break
        rules.append((rule, float(exact)))
        left &= ~covered
    return rules


def as_condition(rules: list[tuple[Rule, float]], names: tuple[str, ...] = STATISTICS) -> Column:
    """The list as one ordered ``CASE``: the precision of the first rule that holds, else 0."""
    out = None
    for rule, precision in rules:
        cond = None
        for f, above, t in rule:
            c = (F.col(names[f]) > t) if above else (F.col(names[f]) <= t)
            cond = c if cond is None else cond & c
        out = F.when(cond, F.lit(precision)) if out is None else out.when(cond, F.lit(precision))
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def exact_label(text: Column, least_words: int, share: float) -> Column:
    """Whether a text of ``least_words`` or more repeats ``share`` of its runs of five words, by comparing the words."""
    def judged(w: Column) -> Column:
        n = F.size(w) - 4
        runs_of = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, F.lit(5)), " "))
        return F.when((F.size(w) >= max(5, least_words)) & (n > 0), 1 - F.size(F.array_distinct(runs_of)) / n >= share).otherwise(False)

    return F.coalesce(let(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), judged), F.lit(False))


def _between(rules: list[tuple[Rule, float]], x: np.ndarray) -> list[tuple[str, float, float]]:
    """For each condition of a list the open interval between its threshold and the next labelled value."""
    out = []
    for rule, _ in rules:
        for f, above, t in rule:
            v = np.unique(x[:, f])
            i = int(np.searchsorted(v, t, "right"))
            low, high = (v[i - 1] if i else -np.inf), (v[i] if i < len(v) else np.inf)
            out.append((STATISTICS[f], float(low), float(high)))
    return out


def fit_repetition_list(df: DataFrame, stats: DataFrame, key: str, text: str, least_words: int, share: float, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> tuple[list[tuple[Rule, float]], pd.DataFrame]:
    """The list and the labelled rows it was learned from, with ``y``.

    About ``sample_rows`` rows of ``least_words`` or more, picked by hash of the key, are labelled by their words; then, in
    up to ``rounds`` rounds, as many of those whose statistics lie between a threshold and the next labelled value, as
    there the list guesses. Without positives or negatives nothing can be learned: no rule, or one that takes all.
    """
    able = stats.where(F.col("n_words") >= least_words)

    def labelled(keys: DataFrame) -> pd.DataFrame:
        judged = df.select(key, text).join(F.broadcast(keys), key).select(key, exact_label(F.col(text), least_words, share).alias("y"))  # at most 2 * sample_rows keys
        return able.join(F.broadcast(judged), key).select(*STATISTICS, "y").toPandas()

    got = labelled(picked(able.select(key), key, sample_rows))
    for k in range(rounds + 1):
        x, y = got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(bool)
        rules = learn_decision_list(x, y) if y.any() and not y.all() else [([(0, True, least_words - 1.0)], 1.0)] if len(y) and y.all() else []
        zones = [(F.col(c) > low) & (F.col(c) < high) for c, low, high in _between(rules, x)]
        if k == rounds or not zones:
            return rules, got
        more = labelled(picked(able.where(reduce(lambda a, b: a | b, zones)).select(key), key, sample_rows))
        if not len(more):
            return rules, got
        got = pd.concat([got, more], ignore_index=True)


def repetitive(df: DataFrame, key: str, text: str, least_words: int = 20, share: float = 0.2) -> DataFrame:
    """Statistics of each row with ``verdict`` of the learned list, in [0, 1]; a text under ``least_words`` gets 0."""
    stats = staged(repetition_statistics(df, key, text), "statistics")
    rules, _ = fit_repetition_list(df, stats, key, text, least_words, share)
    return stats.withColumn("verdict", F.when(F.col("n_words") >= least_words, as_condition(rules)).otherwise(F.lit(0.0)))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the learned list calls repetitive."""
    return repetitive(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text").where("verdict > 0").select("doc_id")


def p10_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of repeated content of every document, by words, lines and runs of words."""
    rows = repetition_statistics(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in STATISTICS[1:]])


def p10_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """The learned list's verdict on every document."""
    return repetitive(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "verdict")


def _runs_sql(k: int) -> str:
    return f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"


_SHARES_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') w, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[\p{{L}}\p{{N}}]')), lambda l: trim(l)) l FROM documents),
g AS (SELECT doc_id, w, l, {", ".join(f"CASE WHEN len(w) >= {k} THEN {_runs_sql(k)} ELSE [] END g{k}" for k in RUNS)} FROM w)
SELECT doc_id, len(w) AS n_words, {", ".join(f"round(CASE WHEN len(g{k}) > 0 THEN 1 - len(list_distinct(g{k})) / len(g{k}) ELSE 0 END, 6)::DOUBLE AS rep_run{k}" for k in RUNS)},
round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0 END, 6)::DOUBLE AS rep_line,
round(CASE WHEN len(g5) > 1 THEN (list_max(map_values(list_aggregate(g5, 'histogram'))) - 1) / (len(g5) - 1) ELSE 0 END, 6)::DOUBLE AS top_run5 FROM g
"""
_FOUND_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) g FROM w WHERE len(w) >= 20)
SELECT doc_id FROM g WHERE 1 - len(list_distinct(g)) / len(g) >= 0.2
"""
QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_verdicts": p10_verdicts}
ORACLES = {"p10_found": _FOUND_SQL, "p10_shares": _SHARES_SQL}
