"""Problem 7: noise in text from scanned pages.

A lexicon counted over the whole corpus says which words exist. An averaged perceptron, trained on lexicon words that
were damaged on purpose, edits suspect words character by character: keep, replace, delete, insert, and join or keep
at a hyphen that ends a line. Running heads and page numbers are told by a second perceptron, over the form and shape of
a line, its place on the page, and what stands before and after it; its lessons are pages of the corpus into which heads
and numbers of many forms were put. Texts without a suspect sign, decided by whole-batch array operations, pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.llm.lookalikes import plain_form
from tabularium.llm.words import picked, slices
from tabularium.plans.staging import staged
from tabularium.sources.tables import table

#: Signs of print and what a reader of scans takes them for (fixed values).
MISREAD = {
    "a": "@", "b": "6", "c": "e", "d": "cl", "e": "c", "é": "ë 6", "ê": "ë 6", "ô": "6", "g": "9", "i": "1 l |", "l": "1 | i", "li": "h",
    "m": "rn", "o": "0", "q": "9", "ri": "n", "s": "5", "t": "f l", "u": "ii", "v": "y", "z": "2", "ti": "fi",
}
#: The same for figures: what stands for a figure when it shouldn't.
FIGURES = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "Z": "2", "S": "5", "B": "8"}
#: A word is in the lexicon with this share of all words and at least so often; corrections need twice that.
SHARE, OFTEN = 5e-6, 8
#: Words that are damaged to train the editor, at most.
LESSONS = 5000
#: Texts whose lines teach what page furniture is, at most, and how long they are.
PAGES, PAGE_CHARS = 1500, (200, 20_000)
#: Share of ordinary lines of held-out pages that may score as high as a head of unknown form.
LOST = 5e-4
BREAK = "↵"
_MARKED = regex.compile(r"^\s*(?:[Pp]age \d{1,4} |\d{1,4}  )|\(suite\)\s*$|  \d{1,4}\s*$", regex.I)
_PAGE_ENDS, _INNER = regex.compile(r"^\s*(?:[Pp]age )?\d{1,4} |\s+\d{1,4}\s*$"), regex.compile(r"(?<![\p{L}\d@|])\d+(?![\p{L}\d@|])")

_PAGE = r"(?:[\[(—–-]\s*\d{1,4}\s*[\])—–-]|[Pp](?:age|\.)\s*\d{1,4}(?:\s*(?:/|sur)\s*\d{1,4})?|\d{1,4}\s*[|/—–-]|\d{1,4}\s*/\s*\d{1,4}|[|/—–]\s*\d{1,4})"
_NUMBER = r"\d{1,4}"
_TITLE = r"[\p{L}\d@|][\p{L}\p{M}\d@|'’\- ]{3,70}"
_HEAD = rf"(?:(?:[Pp]age )?\d{{1,4}} {{1,4}})?\p{{Lu}}{_TITLE} (?:—|/|\||-) {_TITLE}(?: \([Ss][Uu][Ii][Tt][Ee]\))?(?: {{1,4}}\d{{1,4}})?"
PAGE, NUMBER, HEAD = (regex.compile(rf"[ \t]*{p}[ \t]*") for p in (_PAGE, _NUMBER, _HEAD))
#: The two lines of a page number that was wrapped.
PAGE_SIGN, PAGE_REST = regex.compile(r"[ \t]*[Pp](?:age|\.)[ \t]*"), regex.compile(r"[ \t]*\d{1,4}(?:\s*(?:/|sur)\s*\d{1,4})?[ \t]*")
CUT = regex.compile(r"([\p{L}\d@|]+)([-¬])[ \t]*\n\s*([\p{L}\d@|]+)")
SPACED = regex.compile(r"(?<![\p{L}\p{M}\d@|])[\p{L}\d@|](?: [\p{L}\d@|]){2,}(?![\p{L}\p{M}\d@|])")
WORD = regex.compile(r"(?:[\p{L}\p{M}\d@]|(?<=[\p{L}\d@])\||\|(?=[\p{L}\d@]))+")
CODE = regex.compile(r"[A-Z]{1,2}\d{1,4}[A-Z]?|[A-Z]\d+[a-z]?|\d+(?:er|re|e|ème|eme|è|nd|nde|o|h|km|m|kg|g|cm|mm|px|k|th|st|rd|d)")
FIGURE = regex.compile(r"(?=.*\d)(?=.*[OolI|ZSB])[\dOolI|ZSB]{2,}")
OPEN_END = regex.compile(r"[.!?:;؟…»][\s\"»)]*$")
#: What a text must hold, besides suspect words, to be looked at (RE2).
_QUICK = (
    r"[\p{L}\d@|][-¬][ \t]*\n\s*[\p{L}\d@|]",
    r"(?:^|[^\p{L}\p{M}\d@|])[\p{L}\d@|] [\p{L}\d@|] [\p{L}\d@|](?:[^\p{L}\p{M}\d@|]|$)",
    rf"(?m)^[ \t]*(?:{_PAGE}|{_NUMBER}|{_HEAD})[ \t]*$",
    r"(?m)^[ \t]*(?:[Pp]age \d{1,4} |\d{1,4}  )\p{Lu}|\([Ss][Uu][Ii][Tt][Ee]\)[ \t]*$|\p{L}  +\d{1,4}[ \t]*$|\p{Lu}{3} (?:—|/|\|) \p{Lu}",
    r"(?m)^[^:\n]{1,40}: ?\d{1,4}\.?[ \t]*$",
    r"[:.] ?(?:[\[—–-] ?\d{1,4} ?[\]—–-]|[Pp](?:age|\.) ?\d)",
    r"(?m)^[ \t]*[^\p{L}\p{N}\n]{0,4}\d{1,4}[^\p{L}\p{N}\n]{0,4}(?:\d{1,4}[^\p{L}\p{N}\n]{0,4})?[ \t]*$",
    r"(?m)^[ \t]*\p{Lu}.{2,90}(?:::|[•·~»*]|\b[Pp]age|\b[Pp]\.|\bno|\bn°) ?\d{1,4}[^\p{L}\n]{0,10}$",
)


def _features(seen: str, i: int) -> tuple[str, ...]:
    s = "^^^" + seen + "$$$"
    j = i + 3
    c = s[j]
    return (c, s[j - 1] + c, c + s[j + 1], s[j - 2 : j + 1], s[j : j + 3], s[j - 1 : j + 2], s[j - 2 : j + 3], s[j - 3 : j + 1], s[j : j + 4])


class CharacterEditor:
    """Averaged perceptron over characters; the label of a character is what stands in its place.

    ``None`` keeps it, ``""`` deletes it, one character replaces it, two replace and insert. The sign for a hyphen at
    a line end is deleted (join) or becomes a hyphen.
    """

    def __init__(self):
        self.weights: dict[str, dict] = {}
        self.labels: dict[str, set] = defaultdict(set)

    def scores(self, seen: str, i: int) -> list[tuple[float, str | None]]:
        known = [self.weights.get(f) for f in _features(seen, i)]
        return sorted(((sum(w.get(label, 0.0) for w in known if w), label) for label in self.labels.get(seen[i], (None,))), key=lambda x: -x[0])

    def train(self, lessons: list[tuple[str, list]], epochs: int = 2) -> None:
        for seen, labels in lessons:
            for c, label in zip(seen, labels):
                self.labels[c] |= {None, label}
        totals, stamps, step = defaultdict(float), defaultdict(int), 0
        for _ in range(epochs):
            for seen, labels in lessons:
                for i, right in enumerate(labels):
                    step += 1
                    guess = self.scores(seen, i)[0][1]
                    if guess == right:
                        continue
                    for f in _features(seen, i):
                        w = self.weights.setdefault(f, {})
                        for label, up in ((right, 1.0), (guess, -1.0)):
                            totals[f, label] += (step - stamps[f, label]) * w.get(label, 0.0)
                            stamps[f, label] = step
                            w[label] = w.get(label, 0.0) + up
        for f, w in self.weights.items():
            for label in w:
                w[label] = (totals[f, label] + (step - stamps[f, label]) * w[label]) / max(step, 1)

    def candidates(self, seen: str, beam: int = 24, choices: int = 3) -> list[str]:
        """Edited forms by falling score."""
        states: list[tuple[float, str]] = [(0.0, "")]
        for i, c in enumerate(seen):
            options = self.scores(seen, i)[:choices]
            top = options[0][0]
            states = sorted(((s + score - top, out + (c if label is None else label)) for s, out in states for score, label in options), key=lambda x: -x[0])[:beam]
        return [out for _, out in states]


def lessons_from(lexicon: dict[str, int], most: int = LESSONS, seed: int = 11) -> list[tuple[str, list]]:
    """Damaged words with the label of each character; commoner words come more often, a fifth stays whole."""
    rng = np.random.default_rng(seed)
    words = sorted(w for w in lexicon if len(w) > 2 and w.isalpha())
    if not words:
        return []
    p = np.sqrt([lexicon[w] for w in words])
    options = {k: v.split() for k, v in MISREAD.items()}
    out = []
    for k in rng.choice(len(words), most, p=p / p.sum()):
        word, seen, labels, i = words[k], "", [], 0
        rate = rng.choice([0.0, 0.15, 0.3, 0.5])
        cut = int(rng.integers(1, len(word))) if rng.random() < 0.2 else -1
        while i < len(word):
            if i == cut:
                seen += BREAK
                labels.append("")
            step = 2 if word[i : i + 2] in options and rng.random() < rate and i + 1 != cut else 1
            true = word[i : i + step]
            if true in options and (step == 2 or rng.random() < rate):
                wrong = options[true][int(rng.integers(len(options[true])))]
                seen += wrong
                labels += [true, *[""] * (len(wrong) - 1)] if len(wrong) >= 1 else []
            else:
                seen += true
                labels += [None] * step
            i += step
        out.append((seen, labels))
    hyphened = sorted(w for w in lexicon if "-" in w.strip("-"))
    for k in rng.choice(len(hyphened), most // 20) if hyphened else ():
        seen = hyphened[k].replace("-", BREAK, 1)
        out.append((seen, ["-" if c == BREAK else None for c in seen]))
    return out


def is_head(line: str) -> bool:
    """A running head: two titles with a sign between them, whose only figures are the page number at either end."""
    return bool(HEAD.fullmatch(line)) and not _INNER.search(_PAGE_ENDS.sub("", line))


class Page:
    """The lines of a text with what the furniture model asks of them."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        form = [2 if PAGE.fullmatch(x) else 1 if NUMBER.fullmatch(x) or is_head(x) else 0 for x in lines]
        for i in range(len(lines) - 1):  # a head that was wrapped, known by its page number, mark or capitals
            if not form[i] and PAGE_SIGN.fullmatch(lines[i]) and PAGE_REST.fullmatch(lines[i + 1]):
                form[i] = form[i + 1] = 2
            elif not form[i] and not form[i + 1]:
                both = f"{lines[i].rstrip()} {lines[i + 1].strip()}"
                if len(both) < 150 and is_head(both) and (_MARKED.search(both) or both.isupper()):
                    form[i] = form[i + 1] = 3
        self.form = form
        self.masked = [_FIGURES.sub("#", x.strip()) for x in lines]
        self.times = Counter(self.masked)
        plain = [i for i, x in enumerate(lines) if x.strip() and not form[i]]
        self.before, self.after, last = [""] * len(lines), [""] * len(lines), ""
        for i, x in enumerate(lines):
            self.before[i] = last
            if x.strip() and not form[i]:
                last = x
        last = ""
        for i in range(len(lines) - 1, -1, -1):
            self.after[i] = last
            if lines[i].strip() and not form[i]:
                last = lines[i]
        self.first, self.last = (plain[0], plain[-1]) if plain else (0, 0)

    def context(self, i: int) -> tuple:
        """Form, whether the sentence before is open, how the line after begins, table row, text around, nothing after."""
        x, before, after = self.lines[i], self.before[i], self.after[i]
        opened = "-" if not before else "o" if not OPEN_END.search(before) else "s"
        goes_on = "-" if not after else "l" if after.strip()[:1].islower() else "x"
        return self.form[i], opened, goes_on, "|" in x and ("|" in before or "|" in after), any(c.isalpha() for c in before + after)

    def likely(self, i: int) -> bool:
        """What a line of known form would be without a model: amid a sentence, or of a form that nothing else has."""
        f, opened, goes_on, cell, letters = self.context(i)
        if f in (1, 3) and cell:
            return False
        amid = opened == "o" or opened != "-" and goes_on == "l"
        return amid and (goes_on != "-" or f == 2) or f == 2 and not cell and opened != "-" and goes_on != "-" and letters

    def possible(self, i: int) -> bool:
        """Whether a line of no known form may be furniture: short, parting a sentence, with a figure or some letters."""
        x = self.lines[i].strip()
        if self.form[i] or not 3 <= len(x) <= 110 or not self.first < i < self.last or not (any(c.isdigit() for c in x) or sum(c.isalpha() for c in x) > 8) or _ITEM.match(x):
            return False
        return self.context(i)[1:3] == ("o", "l")

    def features(self, i: int) -> list[str]:
        f, opened, goes_on, cell, letters = context = self.context(i)
        x = self.lines[i].strip()
        around = f"{opened}{goes_on}"
        bare = x.strip(_RIM)
        shape = f"{x[:1].isdigit():d}{x[-1:].isdigit():d}{bare.isdigit():d}{bool(bare) and bare.isupper():d}{x[:1].isupper():d}{bool(_PARTED.search(x)):d}{x[-1:] in '.!?;:,':d}"
        near = any(0 <= j < len(self.lines) and self.form[j] == 2 for j in (i - 1, i + 1))
        again = min(self.times[self.masked[i]], 3)
        own = "u" if not f else "k"  # lines of known and of unknown form are told apart by weights of their own
        return [own + x for x in (
            "1", f"f{f}", f"c{context}", f"s{shape}", f"s{shape}{around}", f"n{min(len(x) // 15, 6)}", f"n{min(len(x) // 15, 6)}{around}", f"w{min(x.count(' '), 8)}", f"t{min(i - self.first, 4)}", f"b{min(self.last - i, 4)}",
            f"r{again}{around}", f"p{near:d}{around}", f"u{x[:1].isupper():d}{around}", f"m{self.masked[i][:2]}{around}", f"e{self.masked[i][-2:]}{around}",
        )]


_ITEM = regex.compile(r"[-–•] ?\p{Ll}|\d+\)|[Aa]rt(?:icle)?\b")  # list items and articles, which open a line by right
_FIGURES, _PARTED, _RIM = regex.compile(r"\d+"), regex.compile(r"(?:^|\s)(?:—|/|\||-|::|[•·~»*])(?:\s|$)"), " -–—[](){}|/:•·~»*."
#: Forms of numbers and heads put into lessons, known ones and others: numbers ``n`` and ``m``, titles ``a`` and ``b``.
_INSERTS = (
    "- {n} -", "[{n}]", "Page {n}", "p. {n}/{m}", "{n}", "{n} / {m}", "— {n} —", "{n} |", "~ {n} ~", "• {n} •", "::{n}::", "{n} sur {m}", "*{n}*", "« {n} »",
    "{a} — {b}", "{a} | {b}   {n}", "{n}   {a} / {b}", "page {n} {a} - {b}", "{a} — {b} (suite)", "{a} :: page {n}", "{a} • {n}", "{a} · {b} · {n}", "{n} :: {a}", "{a} ~ {b}", "{a} * {n}", "{a}, page {n} sur {m}", "{n} • {a}",
)


class FurnitureModel:
    """Averaged perceptron over lines: whether a line is a running head or a page number."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.least = float("inf")  # for lines of no known form

    def score(self, page: Page, i: int) -> float:
        return sum(self.weights.get(f, 0.0) for f in page.features(i))

    def train(self, lessons: list[tuple[list[str], bool]], held: list[tuple[list[str], bool]], epochs: int = 20) -> None:
        """Weights from ``lessons``; lines of no known form must beat all but the share ``LOST`` of such lines of ``held``."""
        total, now, step = defaultdict(float), defaultdict(float), 0
        for _ in range(epochs):
            wrong = 0
            for features, right in lessons:
                step += 1
                if (sum(now[f] for f in features) > 0) != right:
                    wrong += 1
                    for f in features:
                        now[f] += 1.0 if right else -1.0
                        total[f] += step if right else -step
            if not wrong:
                break
        self.weights = {f: w - total[f] / max(step, 1) for f, w in now.items()}
        other = [sum(self.weights.get(f, 0.0) for f in features) for features, right in held if not right and features[0] == "u1"]
        self.least = max(0.5, float(np.quantile(other, 1 - LOST, method="higher"))) if other else float("inf")

    def taken(self, page: Page) -> set[int]:
        out = set()
        for i, x in enumerate(page.lines):
            if not x.strip() or not page.before[i]:
                continue
            if page.form[i]:
                if self.score(page, i) > 0:
                    out.add(i)
            elif page.possible(i) and self.score(page, i) > self.least:
                out.add(i)
        return out


def furniture_lessons(texts: list[str], lexicon: dict[str, int], seed: int = 17) -> list[tuple[list[str], bool]]:
    """Features and label of lines of pages made from ``texts``: their own, wrapped anew where they have few, and furniture
    put between them. Own lines of a known form are labelled by ``Page.likely``, as are put ones of a known form; other
    forms are lessons where they part a sentence, beside own lines that do."""
    rng = np.random.default_rng(seed)
    words = sorted(w for w in lexicon if len(w) > 2 and w.isalpha())
    if not words:
        return []
    title = lambda: " ".join(str(words[k]) for k in rng.integers(0, len(words), int(rng.integers(2, 5))))
    out = []
    for text in texts:
        lines = text.split("\n")
        if len(lines) < 6:
            tokens, lines, width = text.split(), [], int(rng.integers(40, 100))
            for t in tokens:
                if lines and len(lines[-1]) + len(t) < width:
                    lines[-1] += " " + t
                else:
                    lines.append(t)
        style = str.upper if rng.random() < 0.5 else str.capitalize
        heads, put = (style(title()), style(title())), set()
        form = _INSERTS[int(rng.integers(len(_INSERTS)))]
        for _ in range(max(1, len(lines) // int(rng.integers(5, 12)))):
            if len(lines) > 3:
                n = int(rng.integers(1, 900))
                new = _INSERTS[int(rng.integers(len(_INSERTS)))] if rng.random() < 0.5 else form
                at = int(rng.integers(1, len(lines)))
                made = [new.format(n=n, m=n + 40, a=heads[0], b=heads[1])]
                row = rng.random() < 0.25  # rows of a table, which are no furniture
                if row:
                    end = "." if rng.random() < 0.5 else ""
                    made = [f"{style(title())} | {n}{end}", *[f"{n} |", f"{n}", f"{style(title()) if rng.random() < 0.7 else title()} | {n + 1}{end}"][int(rng.integers(3)) :]]
                elif rng.random() < 0.2 and " " in made[0]:  # wrapped
                    gaps = [j for j, c in enumerate(made[0]) if c == " "]
                    cut = gaps[int(rng.integers(len(gaps)))]
                    made = [made[0][:cut].rstrip(), made[0][cut:].lstrip()]
                lines[at:at] = made
                put = {j + len(made) * (j >= at) for j in put} | (set() if row else set(range(at, at + len(made))))
        page = Page(lines)
        for i, x in enumerate(lines):
            if not x.strip() or not page.before[i]:
                continue
            if page.form[i]:
                out.append((page.features(i), page.likely(i)))
            elif not page.possible(i):
                continue
            else:
                out.append((page.features(i), i in put))
    return out


class ScanRepair:
    """Lexicon and editor, and what they do to one text."""

    def __init__(self, lexicon: dict[str, int], words: int, pages: list[str] | None = None):
        self.lexicon = lexicon
        self.sure = 2 * max(OFTEN, SHARE * words)
        self.editor = CharacterEditor()
        self.editor.train(lessons_from(lexicon))
        self.furnished = FurnitureModel()
        pages = pages or [" ".join(sorted(lexicon))]
        lessons = furniture_lessons(pages * max(1, 300 // len(pages)), lexicon)
        self.furnished.train([x for k, x in enumerate(lessons) if k % 3], lessons[::3])
        self.letters = {c for w in lexicon for c in w if c.isalpha()}
        self.longest = max(map(len, lexicon), default=0)
        self.fixed: dict[str, str | None] = {}
        self.fine: dict[str, bool] = {}

    def suspect(self, token: str) -> bool:
        """Whether a token of a batch may be misread; only distinct tokens are asked."""
        got = self.fine.get(token)
        if got is None:
            if len(self.fine) > 1_000_000:
                self.fine.clear()
            got = self.fine[token] = bool(self.correct(token))
        return got

    def correct(self, token: str) -> str | None:
        """The word or figure that was misread, None if the token can stand."""
        low = token.lower()
        if len(token) < 3 and not FIGURE.fullmatch(token) or low in self.lexicon or token.isdigit():
            return None
        if CODE.fullmatch(token):
            return None
        if FIGURE.fullmatch(token) and (any(c.isdigit() for c in token)):
            return "".join(FIGURES.get(c, c) for c in token)
        if not any(c.isalpha() for c in token) or not any(c in self.letters for c in low) or any(c.isalpha() and c not in self.letters and c not in "ëyhnfc" for c in low):
            return None
        if low not in self.fixed:
            if len(self.fixed) > 500_000:
                self.fixed.clear()
            best = next((c for c in self.editor.candidates(low) if c != low and self.lexicon.get(c, 0) >= self.sure), None) if len(low) <= 2 * self.longest else None  # an edit halves a word at most
            self.fixed[low] = best
        best = self.fixed[low]
        if best is None:
            return None
        return best.upper() if token.isupper() and len(token) > 1 else best.capitalize() if token[0].isupper() else best

    def _known(self, word: str) -> bool:
        return word.lower() in self.lexicon or self.correct(word) is not None

    def _join(self, m: regex.Match) -> str:
        """Both sides of a line end in one word, unless the hyphen belongs to it."""
        a, sign, b = m.groups()
        if sign == "-":
            whole, hyphened = (a + b).lower(), f"{a}-{b}".lower()
            if self.lexicon.get(hyphened, 0) > self.lexicon.get(whole, 0):
                return f"{a}-{b}"
            if not self._known(a + b):
                seen = a.lower() + BREAK + b.lower()
                at = len(a)
                if a.isdigit() or b.isdigit() or self.editor.scores(seen, at)[0][1] == "-" and not (a + b).islower():
                    return m.group()
        return a + b

    def _unspace(self, m: regex.Match) -> str:
        word = m.group().replace(" ", "")
        if sum(c.isalpha() for c in word) < 2:
            return m.group()
        if self._known(word):
            return word
        # a free letter before or after the spaced word, as in "a" or "y"
        for cut in (1, -1):
            rest = word[1:] if cut == 1 else word[:-1]
            if len(rest) > 2 and self._known(rest):
                return f"{word[0]} {rest}" if cut == 1 else f"{rest} {word[-1]}"
        return word if len(word) > 4 else m.group()

    def furniture(self, lines: list[str]) -> set[int]:
        """Lines that are page numbers or running heads, by the learned model. The first text line is none."""
        return self.furnished.taken(Page(lines))

    def repair(self, text: str) -> tuple[str, int]:
        """The text as continuous paragraphs, and the number of traces of scanning in it."""
        if not text.isascii():
            text = "".join((c if (p := plain_form(c)) is None else p) if ord(c) > 0xA0 and c not in self.letters else c for c in text.replace("\xad", "").replace("\xa0", " "))
        n, wrapped = 0, False
        lines = text.split("\n")
        if len(lines) > 1 and (gone := self.furniture(lines)):
            n += len(gone)
            lines = [x for i, x in enumerate(lines) if i not in gone]
            text = "\n".join(lines)
        for pattern, fix in ((CUT, self._join), (SPACED, self._unspace)):
            out, at = [], 0
            for m in pattern.finditer(text):
                new = fix(m)
                hit = new != m.group() and not (pattern is CUT and new == f"{m.group(1)}-{m.group(3)}")
                n += hit
                wrapped |= pattern is CUT
                out += [text[at : m.start()], new]
                at = m.end()
            text = "".join(out) + text[at:]
        out, at = [], 0
        for m in WORD.finditer(text):
            new = self.correct(m.group())
            if new:
                n += 1
                out += [text[at : m.start()], new]
                at = m.end()
        text = "".join(out) + text[at:]
        if n:
            text = regex.sub(r"(?<=[\p{L}\d,'’%])[ \t]*\n[ \t]*(?=[\p{Ll}\p{Lo}])", " ", text)
        return text, n

    def marked(self, texts: pa.Array) -> np.ndarray:
        """Which texts of a batch have a suspect word or form."""
        out = [np.empty(0, bool)]
        for a, b in slices(texts):
            part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())
            hit = np.zeros(b - a, bool)
            for p in _QUICK:
                hit |= pc.match_substring_regex(part, p).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(pc.replace_substring_regex(part, pattern=r"[^\p{L}\p{M}\p{N}@|]+", replacement=" "), " ")
            coded = lists.flatten().dictionary_encode()
            odd = np.array([self.suspect(t.strip("|")) or t.strip("|") != t and self.suspect(t) for t in coded.dictionary.to_pylist()], bool)
            total = np.concatenate([[0], np.cumsum(odd[coded.indices.to_numpy(zero_copy_only=False)])])
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            hit |= total[ends] > total[np.concatenate([[0], ends[:-1]])]
            out.append(hit)
        return np.concatenate(out)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of the only column, a text: runs of letters and inner hyphens, lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = pc.utf8_lower(pc.fill_null(batch.column(0).slice(a, b - a), ""))
                flat = pc.split_pattern(pc.replace_substring_regex(part, pattern=r"[^\p{L}-]+", replacement=" "), " ").flatten()
                for x in flat.value_counts().to_pylist():
                    total[x["values"]] += x["counts"]
            if len(total) > 200_000:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    words = [w for w in total if any(c.isalpha() for c in w)]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])


def fit_scan_repair(texts: DataFrame) -> ScanRepair:
    """Count the words of all texts, keep those above the share (at most 1 / ``SHARE`` of them) and train both models.

    The furniture model learns from about ``PAGES`` texts, picked by their hash.
    """
    counts = staged(word_counts(texts), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") >= max(OFTEN, SHARE * total)).collect()
    column = texts.columns[0]
    pages = picked(texts.where(F.length(column).between(*PAGE_CHARS)), column, PAGES).collect()
    return ScanRepair({r[0].strip("-"): r[1] for r in rows}, total, [r[0] for r in pages])


def repair_texts(df: DataFrame, repairer: ScanRepair) -> DataFrame:
    """``df`` with ``text`` repaired and the number of traces in ``n_traces``; null and empty texts have none.

    A column ``n_traces`` of the input is replaced.
    """
    df = df.drop("n_traces")
    shared = df.sparkSession.sparkContext.broadcast(repairer)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("text")
            fixed, n = texts.to_pylist(), np.zeros(len(texts), np.int32)
            for i in np.flatnonzero(own.marked(texts)):
                fixed[i], n[i] = own.repair(fixed[i])
            columns = [pa.array(fixed, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*batch.schema.names, "n_traces"])

    return df.mapInArrow(run, kinds + ", n_traces int")


def scanned_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(tab, row_no, field, at, text)``: contents, proses, and cells with their place ``row.column`` in the table.

    A row of a table whose only filled cell is the first is marked by a closing line break, as its place tells whether
    it may be a page number.
    """
    chunks = table(spark, root, "index_chunk").select(F.lit("index_chunk").alias("tab"), "row_no", F.lit("content").alias("field"), F.lit("").alias("at"), F.col("content").alias("text"))
    tables = table(spark, root, "raw_tables")
    prose = tables.select(F.lit("raw_tables"), "row_no", F.lit("prose"), F.lit(""), "prose")
    # one text for each table: cells apart by a sign that no word or line has
    grid = F.array_join(F.transform("raw_data", lambda r: F.array_join(F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))), CELL)), ROW)
    cells = tables.select(F.lit("raw_tables"), "row_no", F.lit("raw_data"), F.lit(""), grid)
    return chunks.unionAll(prose).unionAll(cells)


#: Signs between cells and rows of a table while it is one text.
CELL, ROW = "\x1f", "\x1e"


def repair_cells(own: ScanRepair, text: str) -> tuple[str, int]:
    """A table as one text: every cell is repaired on its own, rows that are page furniture go."""
    n, rows = 0, []
    for row in text.split(ROW):
        cells = row.split(CELL)
        filled = [c for c in cells if c.strip()]
        if len(filled) == 1 and filled[0] is cells[0] and len(cells) > 1 and (PAGE.fullmatch(cells[0]) or NUMBER.fullmatch(cells[0]) or is_head(cells[0])) or len(cells) == 1 and PAGE.fullmatch(row):
            n += 1
            continue
        done = [own.repair(c) for c in cells]
        n += sum(d[1] for d in done)
        rows.append(CELL.join(d[0] for d in done))
    return ROW.join(rows), n


def _prose(own: ScanRepair, text: str) -> tuple[str, int]:
    """Lines of a prose whose only cell is page furniture go; the rest is repaired as text."""
    lines = text.split("\n")
    opens = Counter(m.group() for x in lines if (m := _PROSE_KEY.match(x)))
    first = max(opens, key=opens.get) if opens else ""  # the name of the first column opens nearly every line
    keep = [x for x in lines if not _PROSE_PAGE.fullmatch(x) and not (first and len(lines) > 1 and x.startswith(first) and NUMBER.fullmatch(x[len(first) :].rstrip(" .")))]
    fixed, n = own.repair("\n".join(keep))
    return fixed, n + len(lines) - len(keep)


_PROSE_KEY = regex.compile(r"[^:\n]{1,40}: *")
_PROSE_PAGE = regex.compile(rf"[ \t]*[^:\n]{{1,40}}: *(?:{_PAGE}|{_HEAD}) *\.?[ \t]*")


def repaired(spark: SparkSession, root: str) -> DataFrame:
    texts = scanned_texts(spark, root)
    repairer = fit_scan_repair(texts.select("text"))
    shared = spark.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, fields = batch.column("text"), batch.column("field").to_pylist()
            fixed, n = texts.to_pylist(), np.zeros(len(texts), np.int32)
            hit = own.marked(pc.replace_substring(texts, ROW, "\n"))
            for i, field in enumerate(fields):
                if fixed[i] and (hit[i] or field == "raw_data"):
                    fixed[i], n[i] = own.repair(fixed[i]) if field == "content" else _prose(own, fixed[i]) if field == "prose" else repair_cells(own, fixed[i])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tab", "row_no", "field")], pa.array(fixed, pa.string()), pa.array(n)], names=["tab", "row_no", "field", "text", "n_traces"])

    return texts.mapInArrow(run, "tab string, row_no bigint, field string, text string, n_traces int")


def p7_repaired(spark: SparkSession, root: str) -> DataFrame:
    return repaired(spark, root)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return repaired(spark, root).where("n_traces > 0").select("tab", "row_no", "field")


QUERIES = {"p7_found": p7_found, "p7_repaired": p7_repaired}
