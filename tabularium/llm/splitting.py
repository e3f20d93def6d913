"""Problem 1: cut oversized texts at natural boundaries.

One regular expression with bounded quantifiers walks a text: its alternatives are ordered by the strength of the
boundary that ends a piece, each consumes as much as fits, and single characters are the fallback. The overlap is
taken back from the previous body with array functions, so the operator is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabularium.sources.tables import table

#: Boundaries from strong to weak, as zero-width tests at the end of a piece.
BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,8}\n)",  # between paragraphs
    r"(?<=\n)(?=[ \t]*(?:[-•*–]|\(?\p{Alnum}{1,4}[.)°]|(?i:art|chap|sect)))",  # before an item or article
    r"(?<=[.!?؟…;:]\s{0,3}\n)",  # between sentences that end a line
    r"(?<=[.!?؟…][»\")\]]?\s)",  # between sentences
    r"(?<=\n)",
    r"(?<=\s)",
)


def walk_pattern(least: int, most: int) -> str:
    """The pattern of one piece: the rest if it fits, else the strongest boundary in the upper half, then below it."""
    half = max(least, most // 2)
    strong = [f".{{{half},{most}}}{b}" for b in BOUNDARIES[:4]]
    weak = [f".{{{least},{half}}}{b}" for b in BOUNDARIES[:4]] if half > least else []
    words = [f".{{{least},{most}}}{b}" for b in BOUNDARIES[4:]]
    return "(?s)(?:.{1,%d}\\z|%s)" % (most, "|".join([*strong, *weak, *words, f".{{1,{most}}}"]))


def pieces(text: Column, limit: int = 2000, overlap: int = 100) -> Column:
    """``array<string>``: pieces of at most ``limit`` code points, each but the first led by ``overlap`` of the last.

    A null text gives null, an empty text or one within the limit gives itself as the only piece. Bodies are at least
    ``overlap`` long (the last may be shorter), so the overlap always lies within the piece before.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of limit")
    least = max(1, overlap)
    head = F.regexp_extract(text, walk_pattern(least, limit), 0)
    rest = F.regexp_extract_all(F.substring(text, F.length(head) + 1, F.length(text)), F.lit(walk_pattern(least, limit - overlap)), F.lit(0))
    # bound by an outer lambda, as the inner one would walk the text again for each piece
    led = F.transform(
        F.array(F.concat(F.array(head), rest)),
        lambda bodies: F.transform(bodies, lambda b, i: F.when(i == 0, b).otherwise(F.concat(F.right(F.element_at(bodies, F.greatest(i, F.lit(1))), F.lit(overlap)), b))),
    )[0]
    return F.when(F.length(text) > limit, led).when(text.isNotNull(), F.array(text))


def split_oversized(df: DataFrame, text: str = "content", part: str = "part", limit: int = 2000, overlap: int = 100) -> DataFrame:
    """Every row of ``df``; oversized ones come out as several rows with their pieces numbered from 1 in ``part``.

    All other columns (``article_number`` among them) are kept on each piece. Rows within the limit, empty and null
    texts pass unchanged with their own ``part`` (null if there was none). A column ``was_split`` of the input is replaced.
    """
    columns = [c for c in df.columns if c not in (text, part, "was_split")]
    number = F.col(part) if part in df.columns else F.lit(None).cast("int")
    at, piece = "__at", "__piece"
    cut = df.select(*columns, number.alias(part), F.length(text).alias("__len"), F.posexplode_outer(pieces(F.col(text), limit, overlap)).alias(at, piece))
    return cut.select(*columns, F.when(F.col("__len") > limit, F.col(at) + 1).otherwise(F.col(part)).cast("int").alias(part), F.col(piece).alias(text), (F.col("__len") > limit).alias("was_split"))


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    cut = split_oversized(table(spark, root, "index_chunk").select("row_no", "chunk_id", "article_number", "part", "content"))
    return cut.select("row_no", "chunk_id", "article_number", "part", "content", "was_split")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that the operator had to cut: those of which it emits a second piece."""
    cut = split_oversized(table(spark, root, "index_chunk").select("row_no", "content"))
    return cut.where("was_split AND part = 2").select("row_no")


def p1_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Each content put together again from its pieces without their overlaps, and what would be wrong with them.

    ``n_over``: pieces above the limit; ``n_unlike``: pieces that don't begin with the end of the one before;
    ``n_short``: bodies shorter than the overlap before the last.
    """
    rows = p1_pieces(spark, root).where("content IS NOT NULL").select("row_no", "was_split", F.when(F.col("was_split"), F.col("part")).otherwise(1).alias("n"), "content")
    lists = rows.groupBy("row_no").agg(F.max("was_split").alias("cut"), F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]).alias("p"))
    body = F.transform("p", lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, 101, 2000)))
    before = F.zip_with(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda b, a: (~b.startswith(F.right(a, F.lit(100)))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return lists.select(
        "row_no", F.md5(F.array_join(body, "")).alias("content_md5"), total(F.transform("p", lambda x: (F.col("cut") & (F.length(x) > 2000)).cast("int"))).alias("n_over"), total(before).alias("n_unlike"),
        total(F.transform(F.slice(body, F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: (F.length(x) < 100).cast("int"))).alias("n_short"),
    )


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_round_trip": p1_round_trip}
ORACLES = {
    "p1_found": "SELECT row_no FROM index_chunk WHERE length(content) > 2000",
    "p1_round_trip": "SELECT row_no, md5(content) AS content_md5, 0 AS n_over, 0 AS n_unlike, 0 AS n_short FROM index_chunk WHERE content IS NOT NULL",
}
