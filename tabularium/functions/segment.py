"""Cutting texts at matches, packing pieces, and finding the page of a piece."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_CUT, _END = "\u0001", "\u0002"


def cut_before(text: Column, pattern: str) -> Column:
    """Segments that begin at each match; the first is what stands before (empty if the text begins with a match)."""
    return F.split(F.regexp_replace(text, pattern, _CUT + "$0"), _CUT)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often and within whatever lambda it is used."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<text, offset>>`` of all matches: position in code points from 0, without a Python worker."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_END}"), _CUT)

    def located(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(F.replace(x, F.lit(_END), F.lit(""))))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
        both = F.arrays_zip(F.transform(p, lambda x: F.substring_index(x, _END, 1)).alias("text"), F.slice(starts, F.lit(1), F.size(p)).alias("offset"))
        return F.slice(both, F.lit(2), F.size(p))

    return let(parts, located)


def packed(parts: Column, most: int, joint: str, extra: int) -> Column:
    """Greedy groups of consecutive parts: a part joins while group, part and ``extra`` stay within ``most``.

    Order decides, so this is a fold over one array: the work and memory of a row are those of its own text.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + F.length(p) + extra <= most
        grown = F.trim(F.concat(s["now"], F.lit(joint), p), F.lit(" \n\t\r"))
        flushed = F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])
        return F.when(fits, F.struct(s["done"].alias("done"), grown.alias("now"))).otherwise(F.struct(flushed.alias("done"), p.alias("now")))

    return F.aggregate(parts, start, step, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def packed_by(text: Column, most: int, pattern: str) -> Column:
    """Parts between the places of ``pattern`` packed below ``most``; an empty array where there is only one part."""
    return let(F.split(text, pattern), lambda ps: F.when(F.size(ps) > 1, packed(_trimmed(ps), most, "\n", 2)).otherwise(F.array().cast("array<string>")))


def packed_paragraphs(text: Column, most: int, pattern: str = r"(?=\n\s*\d{1,2}\))") -> Column:
    """Numbered paragraphs packed below ``most``; sentences where there are no numbered paragraphs."""
    sentences = F.split(text, r"(?U)(?<=[.!?])\s+")
    out = let(F.split(text, pattern), lambda ps: F.when(F.size(ps) > 1, packed(_trimmed(ps), most, "\n", 2)).otherwise(packed(sentences, most, " ", 1)))
    return let(out, lambda o: F.when(F.size(o) > 0, o).otherwise(F.array(text)))


def word_pieces(x: Column) -> Column:
    """Tokens by the plainest public rule: runs of word signs, and every other sign that is no white space."""
    return F.regexp_count(x, F.lit(r"(?U)\w+|[^\w\s]"))


def sentence_windows(text: Column, most: int = 1024, overlap: int = 100, measure: Callable[[Column], Column] = word_pieces) -> Column:
    """``array<string>``: sentences packed into windows of at most ``most`` tokens, led by up to ``overlap`` tokens of whole
    sentences of the window before.

    ``measure`` counts tokens and can be any column function. A sentence above ``most`` is cut between words first. A
    null text gives no window, and so does one of white space alone.
    """
    rough = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?؟])\s+|\n{2,}")
    words = r"(?sU)\S+(?:\s+\S+){0,%d}" % (max(1, most // 4) - 1)
    short = F.flatten(F.transform(_trimmed(rough), lambda s: F.when(measure(s) <= most, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(words), F.lit(0)))))
    sized = F.transform(short, lambda s: F.struct(s.alias("t"), measure(s).alias("n")))
    kind = "array<struct<t:string,n:int>>"
    joined = lambda now: F.array_join(F.transform(now, lambda x: x["t"]), " ")

    def tail(now: Column) -> Column:
        start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        step = lambda s, x: F.when(
            s["open"] & (s["n"] + x["n"] <= overlap), F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["n"] + x["n"]).alias("n"), F.lit(True).alias("open"))
        ).otherwise(F.struct(s["kept"].alias("kept"), s["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(F.reverse(now), start, step)

    def step(s: Column, x: Column) -> Column:
        grown = F.struct(s["done"].alias("done"), F.array_append(s["now"], x).alias("now"), (s["n"] + x["n"]).alias("n"))
        led = let(tail(s["now"]), lambda t: F.when(t["n"] + x["n"] <= most, F.struct(t["kept"].alias("kept"), t["n"].alias("n"))).otherwise(F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("n"))))
        fresh = let(led, lambda t: F.struct(F.array_append(s["done"], joined(s["now"])).alias("done"), F.array_append(t["kept"], x).alias("now"), (t["n"] + x["n"]).alias("n")))
        return F.when((F.size(s["now"]) == 0) | (s["n"] + x["n"] <= most), grown).otherwise(fresh)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(kind).alias("now"), F.lit(0).alias("n"))
    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], joined(s["now"]))).otherwise(s["done"]))
