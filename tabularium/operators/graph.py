"""Property graph of chunks and entities: building, expansion, topic scores, statistics."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabularium.functions.extract import entities
from tabularium.functions.segment import let
from tabularium.functions.text import text_key, truncated


def same_page(chunks: DataFrame, key: str = "id", doc: str = "doc_name", page: str = "page_num") -> DataFrame:
    """``(src, dst)`` with src < dst for chunks of one page. Null documents or pages never meet.

    The result has every pair of a page by definition; a page is bounded by what fits on paper. Pages of unknown
    number (0) are the exception, so ``same_page_rows`` gives the linear form.
    """
    rows = chunks.select(F.col(key).alias("k"), F.col(doc).alias("d"), F.col(page).alias("p")).distinct()
    a, b = rows.select(F.col("k").alias("src"), "d", "p"), rows.select(F.col("k").alias("dst"), "d", "p")
    return a.join(b, ["d", "p"]).where("src < dst").select("src", "dst")


def same_page_rows(chunks: DataFrame, key: str = "id", doc: str = "doc_name", page: str = "page_num") -> DataFrame:
    """``(key, page_key, n_links)``: each chunk with its page and the number of others on it; linear in the chunks."""
    rows = chunks.select(F.col(key).alias("k"), F.col(doc).alias("d"), F.col(page).alias("p")).distinct()
    sizes = rows.groupBy("d", "p").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return rows.join(sizes, ["d", "p"]).select(F.col("k").alias(key), F.concat_ws("#", "d", F.col("p").cast("string")).alias("page_key"), "n_links")


def mentions(chunks: DataFrame, key: str = "id", text: str = "text", kind: str = "code") -> DataFrame:
    """``(entity_name, type, chunk_id, ord)`` of what the extractors find in each chunk."""
    return chunks.select(F.col(key).alias("chunk_id"), F.posexplode(entities(F.col(text), kind)).alias("ord", "e")).select(F.col("e.name").alias("entity_name"), F.col("e.type").alias("type"), "chunk_id", "ord")


def entity_nodes(mentioned: DataFrame) -> DataFrame:
    """One node for each name; the type of its first mention wins. Partial aggregation keeps hot names cheap."""
    return mentioned.groupBy(F.col("entity_name").alias("name")).agg(F.min(F.struct("chunk_id", "ord", "type"))["type"].alias("type"), F.count_distinct("chunk_id").alias("n_chunks"))


def expand(mentioned: DataFrame, chunks: DataFrame, terms: list[str], limit: int = 6) -> DataFrame:
    """Chunks that mention an entity whose name contains a term (case ignored); no term finds nothing."""
    cond = reduce(lambda a, b: a | b, [F.lower("entity_name").contains(t.lower()) for t in terms if t], F.lit(False))
    ids = mentioned.where(cond).select(F.col("chunk_id").alias("id")).distinct()
    return chunks.join(ids, "id", "left_semi").withColumn("score", F.lit(1.0)).orderBy("doc_name", "page_num", "id").limit(limit)


def topic_score(fields: list[tuple[Column, float]], topics: Column) -> Column:
    """Sum over the topics of the weight of the first field that contains the topic; a literal fold for one row."""

    def one(t: Column) -> Column:
        out = None
        for x, w in fields:
            cond = F.coalesce(F.lower(x).contains(F.lower(t)), F.lit(False)) & (t != "")
            out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
        return out.otherwise(F.lit(0.0))

    return F.aggregate(topics, F.lit(0.0), lambda s, t: s + one(t))


def topic_fields() -> list[tuple[Column, float]]:
    """Fields and weights of the topic score (fixed values)."""
    return [(F.col("text"), 2.0), (F.col("article_ref"), 1.5), (F.col("section_title"), 1.0), (F.col("doc_name"), 0.5)]


def topic_search(chunks: DataFrame, topics: list[str], limit: int) -> DataFrame:
    scored = chunks.withColumn("score", topic_score(topic_fields(), F.array(*[F.lit(t) for t in topics]) if topics else F.array().cast("array<string>")))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_name", "page_num", "id").limit(limit)


def _matched_topics(fields: list[tuple[Column, float]], topics: list[str]) -> Column:
    """``array<double>``: for each topic the weight of the first field that contains it, else 0. Fields are lowered once."""
    lows = F.struct(*[F.coalesce(F.lower(x), F.lit("")).alias(f"f{i}") for i, (x, _) in enumerate(fields)])
    wanted = F.transform(F.from_json(F.lit(json.dumps(topics)), "array<string>"), F.lower)

    def one(low: Column, t: Column) -> Column:
        out = F.when(F.coalesce(t == "", F.lit(True)), F.lit(0.0))
        for i, (_, w) in enumerate(fields):
            out = out.when(low[f"f{i}"].contains(t), F.lit(w))
        return out.otherwise(F.lit(0.0))

    return let(lows, lambda low: F.transform(wanted, lambda t: one(low, t)))


def scenario_topk(chunks: DataFrame, scenarios: DataFrame, primary: int = 8, secondary: int = 6, most: int = 10, block: int = 1000) -> DataFrame:
    """For each scenario the best chunks for its topics and for all its topics, equal texts once, cut to ``most``.

    Scenarios are a stated query set, asked in blocks of ``block``. Each distinct topic is looked for once in a chunk, and
    scenarios add up the weights of theirs, so the chunks are scanned once for a block and not joined; the top of each
    scenario is kept by partial rank limits before anything is shuffled. Null topics match nothing.
    """
    rows = scenarios.select("idx", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.coalesce("extra_topics", F.array().cast("array<string>")).alias("extra")).orderBy("idx").collect()
    parts = []
    for start in range(0, max(len(rows), 1), block):
        asked = [(r.idx, src, ts) for r in rows[start : start + block] for src, ts in enumerate(([*r.topics], [*r.topics, *r.extra]))]
        topics = list(dict.fromkeys(t for _, _, ts in asked for t in ts if t))
        at = {t: i for i, t in enumerate(topics)}
        questions = F.from_json(F.lit(json.dumps([{"idx": i, "src": s, "at": [at[t] for t in ts if t]} for i, s, ts in asked])), "array<struct<idx:int,src:int,at:array<int>>>")
        weigh = lambda w: F.filter(F.transform(questions, lambda q: F.struct(q["idx"].alias("idx"), q["src"].alias("src"), F.aggregate(q["at"], F.lit(0.0), lambda s, i: s + F.get(w, i)).alias("score"))), lambda x: x["score"] > 0)  # noqa: E731, B023
        weighed = chunks.select("id", "doc_name", "page_num", "text", _matched_topics(topic_fields(), topics).alias("_w")).where(F.exists("_w", lambda x: x > 0))
        parts.append(weighed.select("id", "doc_name", "page_num", "text", F.explode(weigh(F.col("_w"))).alias("q")).select("id", "doc_name", "page_num", "text", "q.*"))
    wide = reduce(lambda a, b: a.unionAll(b), parts)
    order = [F.desc("score"), "doc_name", "page_num", "id"]
    rank = F.row_number().over(Window.partitionBy("idx", "src").orderBy(*order))
    # a first cut in salted parts, so that no scenario's matches meet in one task
    salt = Window.partitionBy("idx", "src", "salt").orderBy(*order)
    cut = wide.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rs", F.row_number().over(salt)).where(F.col("rs") <= max(primary, secondary)).drop("salt", "rs")
    kept = cut.withColumn("r", rank).where(F.col("r") <= F.when(F.col("src") == 0, primary).otherwise(secondary))
    first = F.row_number().over(Window.partitionBy("idx", text_key(F.col("text"))).orderBy("src", "r"))
    place = F.row_number().over(Window.partitionBy("idx").orderBy("src", "r"))
    return kept.withColumn("f", first).where("f = 1").withColumn("place", place).where(F.col("place") <= most).select("idx", "place", "id", "score")


def vector_topk(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 8) -> DataFrame:
    """Exact cosine of one query against all rows and the ``k`` best; vectors of another length or norm 0 are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    rows = vectors.where(v.isNotNull() & (F.size(v) == len(query))).select(key, F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))).alias("similarity"))
    rows = rows.where(F.col("similarity").isNotNull() & ~F.isnan("similarity")).withColumn("similarity", F.round("similarity", 6))
    return rows.withColumn("score", F.round((1 + F.col("similarity")) / 2, 6)).orderBy(F.desc("similarity"), key).limit(k)


def merge_ranked(*parts: DataFrame, key: str = "id", limit: int = 10) -> DataFrame:
    """Union of ranked results, each key once with its best score."""
    whole = reduce(lambda a, b: a.unionByName(b), [p.select(key, "score") for p in parts])
    return whole.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def knowledge_stats(chunks: DataFrame) -> DataFrame:
    """Figures of the chunks in one pass; categories overlap and are case-sensitive. Entities and relations are counted apart."""
    has = lambda *w: reduce(lambda a, b: a | b, [F.col("doc_name").contains(x) for x in w])
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(has("loi", "finances")).alias("lois"), F.count_if(has("note")).alias("notes"), F.count_if(has("code", "recueil")).alias("codes"),
        F.count_if(has("convention")).alias("conventions"), F.count_if(F.col("chunk_type") == "text").alias("text_chunks"), F.count_if(F.col("chunk_type").startswith("table")).alias("table_chunks"),
        (F.count_if(F.col("gnn_embedding").isNotNull()) > 0).alias("gnn_active"),
    )


def properties(df: DataFrame, key: str, most: int = 200) -> DataFrame:
    """``(key, property, value)`` of every filled column of every row, long values cut with a mark."""
    pairs = [F.struct(F.lit(c).alias("property"), truncated(F.col(c).cast("string"), most, "... [TRUNCATED]").alias("value")) for c in df.columns if c != key]
    return df.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*").where("value IS NOT NULL")


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, empty and filled values of text columns, in one pass."""
    figures = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.col(c) == "").alias(f"{c}_empty"), F.count_if(F.col(c) != "").alias(f"{c}_filled"))]
    wide = df.agg(*figures)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_null").alias("n_null"), F.col(f"{c}_empty").alias("n_empty"), F.col(f"{c}_filled").alias("n_filled")) for c in columns])).alias("r")).select("r.*")
