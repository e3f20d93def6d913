"""Full-text search: BM25 over one or several fields, typo tolerance, filters, facets, highlights.

A query names few terms, so nothing is exploded or shuffled: each row counts the query's terms in its own words, the corpus
statistics are observed in the same pass, and the best rows come from a distributed top-k. ``build_postings``
materialises an inverted index for workloads that ask the same corpus often.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tabularium.functions.segment import let
from tabularium.functions.text import tokens
from tabularium.plans.staging import staged

#: Term saturation and length normalisation: of the main field, and of the others (fixed values).
MAIN, OTHER = (1.5, 0.6), (1.2, 0.75)


def query_terms(query: str | None) -> list[str]:
    """Distinct terms of a query, analysed as the documents are."""
    import re
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFD", (query or "").lower()) if not unicodedata.combining(c)).replace("œ", "oe").replace("æ", "ae")
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", text) if t))


def _holders(toks: Column, terms: list[str], near: dict[str, list[str]] | None) -> list[Column]:
    """How often each term, or a variant of it, stands among the words."""
    counts = lambda t: F.size(F.filter(toks, lambda x: x.isin(*variants) if len(variants := [t, *(near or {}).get(t, [])]) > 1 else x == t))
    return [counts(t) for t in terms]


def field_scores(df: DataFrame, fields: dict[str, tuple[float, float]], terms: list[str], where: Column | None = None, near: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of ``df`` within ``where`` that hold a term in some field, with ``score_<field>``.

    Texts are folded once: one pass counts the terms of every row, writes the few rows that hold one with their counts,
    and observes the statistics of the whole, unfiltered corpus on the way. Null fields have no score. ``near`` lists other
    spellings that count as the term.
    """
    def counted(f: str) -> Column:
        return let(tokens(F.col(f)), lambda t: F.when(t.isNotNull(), F.struct(F.size(t).alias("n"), F.array(*_holders(t, terms, near)).alias("tf"))))

    rows = df.select("*", *[counted(f).alias(f"_c_{f}") for f in fields])
    parts = []
    for f in fields:
        n = F.col(f"_c_{f}.n")
        parts += [F.count_if(n > 0).alias(f"n_{f}"), F.avg(F.when(n > 0, n)).alias(f"avg_{f}")]
        parts += [F.count_if(F.col(f"_c_{f}.tf")[i] > 0).alias(f"df_{f}_{i}") for i in range(len(terms))]
    seen = Observation()
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.exists(f"_c_{f}.tf", lambda x: x > 0), F.lit(False)) for f in fields])
    held = staged(rows.observe(seen, *parts).where(hit if where is None else hit & where), "hits")
    stats = seen.get
    scores = []
    for f, (k1, b) in fields.items():
        total, size = F.lit(0.0), F.col(f"_c_{f}.n")
        all_rows, mean = stats.get(f"n_{f}") or 0, stats.get(f"avg_{f}") or 1.0
        for i in range(len(terms)):
            d = stats.get(f"df_{f}_{i}") or 0
            count = F.col(f"_c_{f}.tf")[i].cast("double")
            total = total + F.when(count > 0, F.lit(math.log(1 + (all_rows - d + 0.5) / (d + 0.5))) * count / (count + k1 * (1 - b + b * size / F.lit(float(mean))))).otherwise(0.0)
        scores.append(F.coalesce(total, F.lit(0.0)).alias(f"score_{f}"))
    return held.select(*df.columns, *scores)


def bm25(df: DataFrame, text: str, query: str, where: Column | None = None, params: tuple[float, float] = MAIN) -> DataFrame:
    """Rows that hold a term of the query, with ``score``. A query without terms finds nothing."""
    terms = query_terms(query)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    return field_scores(df, {text: params}, terms, where).withColumnRenamed(f"score_{text}", "score").where("score > 0")


def spellings(df: DataFrame, fields: list[str], terms: list[str]) -> dict[str, list[str]]:
    """Words of the fields within the edits that each term's length allows: of each term the hundred commonest."""
    if not terms:
        return {}
    words = reduce(lambda a, b: a.unionAll(b), [df.select(F.col(f).cast("string").alias("t")) for f in fields])
    # a word per row before the shuffle, and of those only what is near a term
    near = fuzzy_terms(vocabulary(words, "t"), terms).where("edits > 0")
    ranked_words = near.groupBy("query_term").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("n"), "term"))), 1, 100).alias("w"))
    return {r.query_term: [w.term for w in r.w] for r in ranked_words.collect()}


def best_fields(df: DataFrame, boosts: dict[str, float], query: str, where: Column | None = None, fuzzy: bool = False) -> DataFrame:
    """Score of the best field after its boost; the first field is the main one. ``fuzzy`` counts near spellings too."""
    terms = query_terms(query)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    main = next(iter(boosts))
    scored = field_scores(df, {f: MAIN if f == main else OTHER for f in boosts}, terms, where, spellings(df, list(boosts), terms) if fuzzy else None)
    parts = [F.col(f"score_{f}") * w for f, w in boosts.items()]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return scored.withColumn("score", best).drop(*[f"score_{f}" for f in boosts]).where("score > 0")


def top(df: DataFrame, k: int, *tie: str, digits: int = 6) -> DataFrame:
    """The ``k`` best rows by rounded score, ties by ``tie``."""
    return df.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), *tie).limit(k)


def ranked(hits: DataFrame, *tie: str) -> DataFrame:
    """``hits`` of one result page with ``rank`` from 1 and ``percent`` of the best score, within 2 and 100.

    For what ``top`` has cut: ranks need all rows in one order.
    """
    best = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(0.01))
    percent = F.greatest(F.lit(2), F.least(F.lit(100), F.floor(F.col("score") / best * 100 + 0.5).cast("int")))
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *tie))).withColumn("percent", percent)


def matching(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows that hold a term of the query; no statistics are needed to know them. Without terms none."""
    terms = query_terms(query)
    return df.where(F.arrays_overlap(tokens(F.col(text)), F.array(*[F.lit(t) for t in terms]))) if terms else df.limit(0)


def facets(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(field, value, n)``: the commonest values of several columns by one scan and one aggregation, nulls left out.

    Ties go to the lesser value.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in sizes])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("field"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("r") <= most).drop("r")


def exact_filters(**values: str | None) -> Column | None:
    """Equality on each named column; ``all`` and None switch a filter off."""
    out = None
    for name, v in values.items():
        if v not in (None, "", "all"):
            cond = F.col(name) == v
            out = cond if out is None else out & cond
    return out


def facet(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` commonest values, count descending, then value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def max_edits(term: str) -> int:
    return 0 if len(term) < 3 else 1 if len(term) <= 5 else 2


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``(term, df)``: in how many rows each term occurs. Distinct within the row before the shuffle."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fuzzy_terms(vocab: DataFrame, terms: list[str]) -> DataFrame:
    """``(query_term, term, df, edits)`` of vocabulary terms within the edits that a query term's length allows.

    The query's terms are literals, so the vocabulary is filtered in place; lengths are compared before distances. A
    swap of neighbours counts as two edits.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(max_edits(t)).alias("k")) for t in terms]) if terms else F.array().cast("array<struct<t:string,k:int>>")
    edits = F.array(*[F.levenshtein("term", F.lit(t), max_edits(t)) for t in terms]) if terms else F.array().cast("array<int>")  # -1 beyond the bound
    near = F.filter(F.zip_with(pairs, edits, lambda p, e: F.struct(p["t"].alias("t"), e.alias("e"))), lambda p: p["e"] >= 0)
    short = reduce(lambda a, b: a | b, [F.abs(F.length("term") - len(t)) <= max_edits(t) for t in terms], F.lit(False))
    return vocab.where(short).select("term", "df", F.explode(near).alias("p")).select(F.col("p.t").alias("query_term"), "term", "df", F.col("p.e").alias("edits"))


def build_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, key, tf, dl)``: to be written bucketed or partitioned by term for repeated queries."""
    rows = df.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return rows.select(key, "dl", F.explode("t").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))


def keyword_any(df: DataFrame, fields: list[str], words: list[str]) -> DataFrame:
    """Rows of which some field contains some word, in lower case. Empty words match nothing."""
    cond = F.lit(False)
    for w in dict.fromkeys(w.lower() for w in words if w):
        for f in fields:
            cond = cond | F.coalesce(F.lower(F.col(f)).contains(w), F.lit(False))
    return df.where(cond)
