"""Problem 5: one consistent form for text that looks the same.

Strings and code points that look alike are joined into classes by union-find: compatibility forms, base letters with
detached accents, blanks, hyphens, invisible signs, and letters of one skeleton by the public confusables data that
ships with Spark's ICU. The corpus' own frequencies choose the representative of a class. A multi-pattern automaton
rewrites greedily; letters are rewritten only inside words, where the rest of the word decides for an alphabet.
"""

from __future__ import annotations

import unicodedata as U
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.llm.words import slices
from tabularium.sources.tables import table

#: A letter is native if it makes up this share of the letters of its alphabet and, against the commonest look-alike of
#: its own alphabet, the second share; an alphabet is at home if it makes up the third share of all letters.
NATIVE, BESIDE, HOME = 1 / 2000, 1 / 100, 1 / 100
#: Decompositions whose two sides look alike (tags of the Unicode character database, fixed values).
FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<font>")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class UnionFind:
    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, x: str, y: str) -> None:
        self.up[self.find(x)] = self.find(y)

    def classes(self) -> list[list[str]]:
        out = defaultdict(list)
        for x in self.up:
            out[self.find(x)].append(x)
        return list(out.values())


def script(ch: str) -> str:
    """Alphabet of a letter by its public name; empty for other signs."""
    return U.name(ch, "").split(" ")[0] if U.category(ch)[0] == "L" else ""


def plain_form(ch: str) -> str | None:
    """The plain string that looks like ``ch``, ``""`` for invisible signs, None if ``ch`` is plain itself."""
    category, tag = U.category(ch), U.decomposition(ch)
    if category == "Zs" and ch != " ":
        return " "
    if category == "Cf" and U.bidirectional(ch) not in ("AN", "AL") or ch in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    if category == "Pd" and "HYPHEN" in U.name(ch, "") and ch != "-" and U.name(ch).split()[0] in ("HYPHEN", "NON-BREAKING", "SMALL", "FULLWIDTH"):
        return "-"
    if tag.startswith(FORMS) or tag.startswith("<compat>") and "LIGATURE" in U.name(ch, "") and ord(ch) >= 0xFB00:
        return U.normalize("NFKC", ch)
    if tag and not tag.startswith("<") and len(tag.split()) == 1:
        return U.normalize("NFC", ch)
    return None


class LookAlikes:
    """Rewriting rules made from the frequencies of code points and the skeletons of the letters among them."""

    def __init__(self, counts: Counter, skeletons: dict[str, str]):
        self.counts = counts
        letters = {c: n for c, n in counts.items() if script(c) and plain_form(c) is None}
        total = Counter()
        for c, n in letters.items():
            total[script(c)] += n
        home = {s for s, n in total.items() if n >= HOME * sum(total.values())}
        alike = UnionFind()  # letters: one skeleton, one class
        for c in letters:
            if skeletons.get(c):
                alike.union(c, "=" + skeletons[c])
        self.alike = {c: [x for x in members if x[0] != "="] for members in alike.classes() for c in members if c[0] != "="}
        often = lambda c: max(letters[x] for x in self.alike.get(c, [c]) if script(x) == script(c))
        self.native = {c for c, n in letters.items() if script(c) in home and (n >= NATIVE * total[script(c)] and n >= BESIDE * often(c) or c.isascii())}
        # strings: a form and its plain string, a detached accent and its composed letter
        strings, self.rules = UnionFind(), {}
        for c in counts:
            plain = plain_form(c)
            if plain is not None:
                self.rules[c] = plain
                if plain:
                    strings.union(c, plain)
        marks = [c for c in counts if U.combining(c)]
        for m in marks:
            for c in counts:
                if c in self.native and len(whole := U.normalize("NFC", c + m)) == 1:
                    strings.union(c + m, whole)
        for members in strings.classes():
            best = max(members, key=lambda s: (plain_form(s) is None if len(s) == 1 else False, self._often(s), -ord(s[0])))
            for s in members:
                if s != best and (len(s) > 1 and U.combining(s[-1]) or s in self.rules):
                    self.rules[s] = best
        self.marks = set(marks)
        self.cache: dict[tuple[str, str], str | None] = {}
        rare = set(letters) - self.native
        self.foreign = {c for c in rare if script(c) not in home or self.counterpart(c, script(c))}
        self.unknown = rare - self.foreign
        self.automaton = None

    def _often(self, s: str) -> int:
        return min(self.counts[c] for c in s)

    def suspects(self) -> str:
        """A character class of every sign that may be part of a case; rows without one need no second look."""
        signs = sorted({s[-1] for s in self.rules} | self.foreign)
        return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in signs) + "]" if signs else ""

    def counterpart(self, c: str, alphabet: str) -> str | None:
        """The commonest native letter of ``alphabet`` that looks like ``c``, of its case if there is one."""
        key = (c, alphabet)
        if key not in self.cache:
            fit = [x for x in self.alike.get(c, ()) if x != c and script(x) == alphabet and x in self.native]
            self.cache[key] = max(fit, key=lambda x: (U.category(x) == U.category(c), self.counts[x])) if fit else None
        return self.cache[key]

    def _word(self, word: str, other_language: bool, mixed_row: set[str]) -> tuple[str, int]:
        parts = {script(c) for c in word} - {""}
        strange = [c for c in word if c in self.foreign]
        if not strange:
            return word, 0
        if len(parts) > 1:
            options = [(sum(self.counts[c] for c in word if script(c) == s), s) for s in parts if all(script(c) in ("", s) or self.counterpart(c, s) for c in word)]
            target = max(options)[1] if options else max(parts, key=lambda s: sum(script(c) == s for c in word))
            out = "".join(c if script(c) in ("", target) else self.counterpart(c, target) or c for c in word)
            return U.normalize("NFC", out), 1
        alphabet = parts.pop()
        if any(c in self.native for c in word):
            if not other_language and all(self.counterpart(c, alphabet) for c in strange):
                return "".join(self.counterpart(c, alphabet) if c in self.foreign else c for c in word), 1
            return word, 0
        if alphabet in mixed_row and len(word) > 1:
            homes = [s for s in {script(c) for c in self.native} if all(script(c) == "" or self.counterpart(c, s) for c in word)]
            if homes:
                return "".join(self.counterpart(c, homes[0]) or c for c in word), 1
        return word, 0

    def rewrite(self, text: str) -> tuple[str, int]:
        """The text in one form, and the number of places that were changed or can't be what they look like."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for s, best in self.rules.items():
                self.automaton.add_word(s, (len(s), best))
            if self.rules:
                self.automaton.make_automaton()
        out, at, n = [], 0, 0
        for end, (size, best) in self.automaton.iter_long(text) if self.rules else ():
            start = end - size + 1
            if not best and start and U.category(text[start - 1])[0] == "S":
                continue  # joins the parts of one pictograph
            out += [text[at:start], best]
            at = end + 1
            n += 1
        text = "".join(out) + text[at:]
        if not self.foreign.isdisjoint(text):
            words = [m for m in _WORD.finditer(text) if not self.foreign.isdisjoint(m.group())]
            mixed = {s for m in words if len(p := {script(c) for c in m.group()} - {""}) > 1 for s in p}
            lonely = {script(c) for c in self.unknown.intersection(text)}
            out, at = [], 0
            for m in words:
                new, hit = self._word(m.group(), bool(lonely & ({script(m.group()[0])} - mixed)), mixed)
                out += [text[at : m.start()], new]
                at = m.end()
                n += hit
            text = "".join(out) + text[at:]
        return text, n


def code_point_counts(df: DataFrame, columns: list[str]) -> Counter:
    """How often each code point occurs in the columns; the result is bounded by the size of Unicode."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for column in batch.columns:
                for a, b in slices(column):
                    points = np.frombuffer("".join(x for x in column.slice(a, b - a).to_pylist() if x).encode("utf-32-le", "surrogatepass"), np.uint32)
                    seen = np.bincount(points)
                    total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["point", "n"])

    rows = df.select(*columns).mapInArrow(count, "point int, n bigint").groupBy("point").agg(F.sum("n").alias("n")).collect()
    return Counter({chr(r[0]): r[1] for r in rows})


def fit_look_alikes(df: DataFrame, columns: list[str]) -> LookAlikes:
    """Rules for all code points of the corpus. Skeletons come from the JVM of the driver, one call for each letter."""
    counts = code_point_counts(df, columns)
    checker = df.sparkSession._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = {}
    for c in counts:
        if script(c) and not script(c).startswith(("CJK", "HANGUL", "HIRAGANA", "KATAKANA")) and plain_form(c) is None:
            shape = checker.getSkeleton(0, c)
            if len(shape) == 1:
                skeletons[c] = shape
    return LookAlikes(counts, skeletons)


def consistent_text(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, field, text, n_changed)`` of every row and column: the text in one form, and how many places changed.

    Null texts stay null with 0 changes, empty ones stay empty. Texts without a suspect sign, found by one pass of a
    compiled automaton over the whole batch, are passed through.
    """
    rules = fit_look_alikes(df, columns)
    shared = df.sparkSession.sparkContext.broadcast(rules)
    kind = df.schema[key].dataType.simpleString()
    wide = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pattern = own.suspects()
        for batch in batches:
            for i, field in enumerate(columns):
                texts = batch.column(i + 1)
                n = np.zeros(len(texts), np.int32)
                odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)) if pattern else ()
                if len(odd):
                    done = [own.rewrite(t) for t in texts.take(pa.array(odd)).to_pylist()]
                    n[odd] = [d[1] for d in done]
                    mask = np.zeros(len(texts), bool)
                    mask[odd] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([d[0] for d in done], texts.type))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([field] * len(texts), pa.string()), texts, pa.array(n)], names=["_key", "field", "text", "n_changed"])

    return wide.mapInArrow(rewrite, f"_key {kind}, field string, text string, n_changed int").withColumnRenamed("_key", key)


def p5_clean(spark: SparkSession, root: str) -> DataFrame:
    return consistent_text(table(spark, root, "index_chunk").select("row_no", "content", "section_title"), "row_no", ["content", "section_title"])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_clean(spark, root).where("n_changed > 0").select("row_no", "field")


def p5_untouched(spark: SparkSession, root: str) -> DataFrame:
    """What needs no other form comes out as it was."""
    return p5_clean(spark, root).where("n_changed = 0 AND text IS NOT NULL").select("row_no", "field", F.md5("text").alias("text_md5"))


# The classes of signs that the tables hold, as a plain rule: other blanks and hyphens, invisible signs, presentation and
# full-width forms, detached accents, letters of two alphabets in a word, and Persian and Urdu letters in texts that have
# none of the letters which only those languages use.
_RULE_SQL = r"""(regexp_matches(text, '[\x{A0}\x{AD}\x{1680}\x{2000}-\x{2011}\x{202A}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FB00}-\x{FB06}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{FF01}-\x{FFEE}]|\p{L}[\x{300}-\x{36F}]|\p{Latin}\p{M}*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{M}*\p{Latin}')
OR (regexp_matches(text, '[\x{6A9}\x{6CC}\x{6C1}\x{6BE}\x{6D5}\x{6D2}]') AND NOT regexp_matches(text, '[\x{67E}\x{686}\x{698}\x{6AF}]')))"""
_FIELDS_SQL = "WITH t AS (SELECT row_no, 'content' AS field, content AS text FROM index_chunk UNION ALL SELECT row_no, 'section_title', section_title FROM index_chunk)"
QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean, "p5_untouched": p5_untouched}
ORACLES = {
    "p5_found": f"{_FIELDS_SQL} SELECT row_no, field FROM t WHERE {_RULE_SQL}",
    "p5_untouched": f"{_FIELDS_SQL} SELECT row_no, field, md5(text) AS text_md5 FROM t WHERE NOT {_RULE_SQL}",
}
