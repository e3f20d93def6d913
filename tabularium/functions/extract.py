"""References, amounts and concepts by patterns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabularium.functions.segment import matches
from tabularium.functions.text import strip

# Patterns and word lists (fixed values; flags are those under which both regex dialects agree).
FLAGS = "(?imdU)"
CONCEPTS = {
    "code": [
        r"\bTVA\b", r"\bIRPP\b", r"\bIS\b", r"\bTFP\b", r"\bCNSS\b", r"\bexon[ée]ration\b", r"\bsuspension\b", r"\bd[ée]grev[ement|ement]\b",
        r"\bamortissement\b", r"\bplus-value\b", r"\bassiette\b", r"\btaux\b", r"\bbase\b", r"\bretenue\b", r"\bversement\b", r"\bd[ée]duction\b",
        r"\bcontribution\b", r"\bimposition\b", r"\bpénalité\b",
    ],
    "convention": [
        r"\bimpos(?:ition|able)\b", r"\brev(?:enu|enus)\b", r"\bsoci[ée]t[ée]s?\b", r"\bd[ée]duction\b", r"\bexon[ée]ration\b", r"\btaux\b", r"\bassiette\b",
        r"\bresidents?\b", r"\bnationaux\b", r"\b(?:personne|entreprise) physique\b", r"\b(?:personne|entreprise) morale\b", r"\bdroits? de douane\b",
        r"\b(?:retenue|rétention)\b", r"\bdividendes?\b", r"\bint[ée]r[êe]ts?\b", r"\bredevances?\b", r"\bpension\b", r"\bsalaire\b",
    ],
}
ARTICLE_REF = {"code": r"(?:l['´])?(?:article|art\.?)\s+(?:PREMIER|[\d\w]+(?:\s+bis|\s+ter|\s+quater)?)", "convention": r"(?:article|art\.?)\s+(\d+(?:\s+bis)?)"}
CHAPTER_REF = r"(?:chapitre|chap\.?)\s+(?:PREMIER|I{1,3}V?|VI{0,3}|\d+)"
SECTION_REF = r"(?:section|sec\.?)\s+(?:\d+|I{1,3}V?|VI{0,3})"
AMOUNT = {"code": r"(\d+(?:[.,]\d+)?)\s*(?:%|pour-?cent|dinars?|DT|d\.?\s?t\.?)", "convention": r"(\d+(?:[.,]\d+)?)\s*(?:%|pour-?cent)"}
CROSS_REF = r"(?:article|art\.?)\s+(\w+)\s+(?:du|de|la|l['´])\s+([^.]+?)(?:\.|,|;)"
LEGAL_TERM = {"code": r"(?:au sens|means?|d[ée]nomm[ée]|appel[ée])\s+[«\"]?([^«»\n.]{3,100})[»\"]?", "convention": r"(?:au sens|means?)\s+[«\"]?([^«»\n.]{3,100})[»\"]?"}


def _all(text: Column, pattern: str, group: int = 0, flags: str = FLAGS) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def concepts(text: Column, kind: str = "code") -> Column:
    """Distinct concepts in the order of the list, case-sensitive."""
    return F.array_distinct(F.concat(*[_all(text, p, 0, "(?dU)") for p in CONCEPTS[kind]]))


def article_refs(text: Column, kind: str = "code") -> Column:
    return F.slice(F.array_distinct(_all(text, ARTICLE_REF[kind], 0 if kind == "code" else 1)), 1, 10)


def chapter_refs(text: Column) -> Column:
    return F.slice(F.array_distinct(_all(text, CHAPTER_REF)), 1, 5)


def section_refs(text: Column) -> Column:
    return F.slice(F.array_distinct(_all(text, SECTION_REF)), 1, 5)


def legal_terms(text: Column, kind: str = "code") -> Column:
    """What a text defines, distinct, at most 10."""
    return F.slice(F.array_distinct(_all(text, LEGAL_TERM[kind], 1)), 1, 10)


def cross_refs(text: Column) -> Column:
    """``Art. N target``, distinct, at most 15."""
    pairs = F.zip_with(_all(text, CROSS_REF, 1), _all(text, CROSS_REF, 2), lambda a, b: F.concat(F.lit("Art. "), a, F.lit(" "), b))
    return F.slice(F.array_distinct(pairs), 1, 15)


def thresholds(text: Column, kind: str = "code", around: int = 50, most: int = 20) -> Column:
    """``array<struct<value, full_text, context>>`` of percentages and amounts with the text around them."""
    pattern = FLAGS + AMOUNT[kind]

    def entry(m: Column) -> Column:
        first = F.greatest(m["offset"] - around, F.lit(0))
        size = m["offset"] + F.length(m["text"]) + around - first
        return F.struct(F.regexp_extract(m["text"], pattern, 1).alias("value"), m["text"].alias("full_text"), strip(F.substring(text, first + 1, size)).alias("context"))

    return F.transform(F.slice(matches(text, pattern), 1, most), entry)


def article_key(title: Column) -> Column:
    """``Art. N`` of a heading, else the heading."""
    n = strip(F.regexp_extract(title, r"(?iU)(?:ARTICLE|ART\.?)\s+([\w\s]+?)(?:\s*[-:—–]|$)", 1))
    return F.when(n != "", F.concat(F.lit("Art. "), n)).otherwise(title)


def entities(text: Column, kind: str = "code", most: int = 15) -> Column:
    """``array<struct<name, type>>``: concepts, article and cross references, amounts; distinct, first seen, capped."""
    tag = lambda a, t: F.transform(a, lambda x: F.struct(x.alias("name"), F.lit(t).alias("type")))
    amounts = F.transform(F.slice(thresholds(text, kind), 1, 5), lambda t: F.concat_ws(" ", t["value"], t["full_text"]))
    cross = F.transform(cross_refs(text), lambda x: F.substring(x, 1, 100))
    parts = [tag(concepts(text, kind), "tax_concept"), tag(article_refs(text, kind), "article_reference"), tag(cross, "cross_reference"), tag(amounts, "threshold")]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)
