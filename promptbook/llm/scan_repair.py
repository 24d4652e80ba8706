"""Repairing text from scanned pages (problem 6).

A pass over the rows takes out running titles and page marks, joins words broken at line ends and emits the words
that are not among the commonest; an exact anti-join leaves those that no clean text has. Their candidates come from
an inverted join over positional character q-grams; boosted trees rank the candidates by their frequency, their
neighbours and the likelihood of the misreading. Three more boosted classifiers decide what is page furniture, on
lines with their neighbours and, in texts without line ends, on marks with the words to either side, and which breaks
were hyphens of compounds. All are fitted on a bounded sample of clean texts that ``typeset`` turns into scanned pages
with known noise; counts, candidates and decisions cover all data.

Words of at most seven letters are found by their q-grams that leave out one place, longer ones by two of four segments,
and words that differ only in letters that scans take for each other by their common shape, however many these are.
So one wrong letter in a short word, two in a long one and any number of usual misreadings are repaired.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook.llm.boosting import Boosted
from promptbook.plans.lineage import cut, cut_table
from promptbook.plans.sampling import bounded_sample

#: Clean texts from which the classifiers are fitted, at most, and words that stand for the vocabulary meanwhile.
SAMPLE_TEXTS, SAMPLE_WORDS = 1500, 20_000
#: Words, at most, that tasks carry to leave out early what is certainly known; all others are settled by a join.
COMMON_WORDS = 100_000
#: Least score of the best candidate of a form that cannot be right, as it has a digit or the sign of an illegible letter.
SIGN_SCORE = 0.05

#: Marks that printers and scanners leave where a word is broken, and the sign for an illegible letter: fixed values.
BREAKS = "-‐⸗=¬­"
MISSING = "•"
#: Letters that scans take for others, as (read, printed): fixed values.
MISREAD = frozenset([("c", "e"), ("e", "c"), ("1", "l"), ("l", "1"), ("0", "o"), ("l", "t"), ("t", "l"), ("u", "n"), ("n", "u"), ("b", "h"), ("h", "b"), ("q", "g"), ("f", "s"), ("rn", "m"), ("m", "rn"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("ii", "n"), ("i", "l"), ("l", "i"), ("1", "i"), ("5", "s"), ("8", "b"), ("vv", "w")])

_WORD = re.compile(rf"[\w{MISSING}]+(?:-[\w{MISSING}]+)*")
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_LEAF = r"(?:Page|Pag\.|pag\.|[Ff]ol\.|[Ff]olio)\s*\d{1,4}\.?"
_PAGE_LINE = re.compile(rf"\d{{1,4}}\.?|\[\s*\d{{1,4}}\s*\]|[-—–]\s*\d{{1,4}}\s*[-—–]|{_LEAF}|[A-Z]{{1,2}}\d{{1,2}}\.?|{_ROMAN}\.")
_PAGE_INLINE = re.compile(rf"\[\s*\d{{1,4}}\s*\]|(?<!\S)[-—–]\s*\d{{1,4}}\s*[-—–](?!\S)|(?<!\S){_LEAF}(?!\S)|(?<!\S)[A-Z]{{1,2}}\d{{1,2}}\.?(?!\S)|(?<!\S){_ROMAN}\.(?!\S)|(?<!\S)\d{{1,3}}(?!\S)")
_SMALL = rf"(?:[a-z{MISSING}][a-z0-9{MISSING}]{{0,2}}|[0-9][a-z]{{1,2}})"  # of, or, the, and the like, well read or not
_CAP = rf"(?!(?:Page|Pag|Fol|Folio)\b)[A-Z][\w{MISSING}'\-]*"
#: A run of words in capitals or with initial capitals, as titles are printed, in a text without line ends.
_TITLE_INLINE = re.compile(rf"(?<!\S){_CAP}(?:,?\s+(?:{_SMALL}\s+)*{_CAP})+[.,]?(?!\w)")
_NUMBER_BEFORE = re.compile(r"(?<!\S)(?<!Page )(?<!Pag\. )(?<!pag\. )(?<!fol\. )(?<!Fol\. )(?<!year )\d{1,3}\s+$")
_NUMBER_AFTER = re.compile(r"^\.?\s*(?:\[\s*\d{1,4}\s*\]|\d{1,3}(?!\S))")
_BREAK_LINE = re.compile(rf"(?<=[\w{MISSING}])[{BREAKS}][^\S\n]*\n\s*(?=[\w{MISSING}])")
_BREAK_INLINE = re.compile(rf"(?<=[\w{MISSING}])[{BREAKS}]\s+(?=[\w{MISSING}])")
_LAST = re.compile(rf"[\w{MISSING}]+(?:-[\w{MISSING}]+)*$")
_CAPITAL = re.compile(r"(?<!\S)[A-ZÀ-Þ]")
_TOKEN = re.compile(rf"[\w{MISSING}]+(?:-[\w{MISSING}]+)*|\x01")
_DIGITS = re.compile(r"\d+")
_ANY_DIGIT = re.compile(r"\d")
_BEFORE = re.compile(rf"([\w{MISSING}]+(?:-[\w{MISSING}]+)*)([^\w{MISSING}]*)$")
_AFTER = re.compile(rf"[^\w{MISSING}]*([\w{MISSING}]+(?:-[\w{MISSING}]+)*)")
#: Stands for any number among the neighbours of words.
NUMBER = "#"
_NUMBER = re.compile(r"\[?\d{1,4}\]?[.,]?")


def plain(word: str) -> str:
    return word.lower().replace("ſ", "s")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def title_key(text: str) -> str:
    """A running title without page number, case and punctuation, for comparing."""
    t = re.sub(r"^\s*\d+\s+|[\[\]]|\s*\d+\s*\]?\s*\.?$", " ", text)
    return squeeze(re.sub(r"[^\w\s]", " ", plain(_DIGITS.sub(lambda m: m.group() if len(m.group()) < 2 else " ", t))))


def likeness(a: str, b: str) -> float:
    """Share of equal letters of two keys compared from both ends; 1 for equal ones."""
    if not a or not b:
        return 0.0
    n = max(len(a), len(b))
    i = sum(x == y for x, y in zip(a, b))
    j = sum(x == y for x, y in zip(reversed(a), reversed(b)))
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    tail = sum(x == y for x, y in zip(reversed(a[k:]), reversed(b[k:])))
    return max(i, j, k + tail) / n


def around(lines: list[str]) -> tuple[int, list[str], list[str]]:
    """The usual length of the lines, and for each line the nearest lines before and after it that are not blank."""
    sizes = sorted(len(x) for x in lines if x)
    before, after = [""] * len(lines), [""] * len(lines)
    last = ""
    for i, x in enumerate(lines):
        before[i] = last
        last = x or last
    last = ""
    for i in range(len(lines) - 1, -1, -1):
        after[i] = last
        last = lines[i] or last
    return (sizes[len(sizes) // 2] if sizes else 1), before, after


def line_features(lines: list[str], i: int, known, near: tuple[int, list[str], list[str]]) -> list[float]:
    """A line with the lines around it: what tells page furniture from speech."""
    line = lines[i]
    parts = line.split()
    alpha = [p for p in parts if any(c.isalpha() for c in p)]
    longer = [p for p in alpha if sum(c.isalpha() for c in p) > 3]
    caps = sum(p.lstrip("([\"'")[:1].isupper() for p in longer) / len(longer) if longer else float(bool(alpha) and alpha[0][:1].isupper())
    usual, before, after = near[0], near[1][i], near[2][i]
    middle = [w for w in _WORD.findall(line) if not w.isdigit()]
    return [
        caps,
        sum(c.isupper() for c in line) / max(1, len(line)),
        float(len(parts)),
        sum(bool(_NUMBER.fullmatch(q)) and not re.fullmatch("year[e]?", p, re.I) for p, q in zip(["", *parts], parts)) / max(1, len(parts)),
        float(bool(_PAGE_LINE.fullmatch(line))),
        len(line) / usual,
        float(line[-1:] in ",;:?!"),
        float(before[-1:] not in ".?!;:,") if before else 0.5,
        float(after[:1].islower()) if after else 0.5,
        sum(known(plain(w)) for w in middle) / len(middle) if middle else 0.5,
        float(before[-1:] in BREAKS) if before else 0.0,
    ]


#: Length of what ``line_features`` returns.
LINE_FEATURES = 11


def mark_form(piece: str) -> float:
    """The kind of a page mark: a bare number, in brackets, between dashes, of a named leaf, of a sheet, a Roman number."""
    if piece.isdigit():
        return 0.0
    if piece[0] == "[":
        return 1.0
    if piece[0] in "-—–":
        return 2.0
    return 5.0 if piece[0].islower() and piece[0] in "ivxlc" else 4.0 if piece[0].isupper() and _ANY_DIGIT.search(piece[1:3]) else 3.0


def inline_marks(raw: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, str, str]]]:
    """Of a text without line ends the spans of runs that may be a title, and ``(start, end, before, after, look)`` of what
    may be a page mark outside of these: the words to either side, and how the mark stands between them."""
    titles: list[tuple[int, int]] = []
    for m in _TITLE_INLINE.finditer(raw):
        a, e = m.span()
        if before := _NUMBER_BEFORE.search(squeeze(raw[max(0, a - 14) : a]) + " "):
            a = raw.rindex(before.group().strip(), 0, a)
        if after := _NUMBER_AFTER.match(raw[e : e + 12]):
            e += len(after.group())
        if len(title_key(m.group())) > 6:
            titles.append((a, e))
    marks, k = [], 0
    for m in _PAGE_INLINE.finditer(raw):
        a, e = m.span()
        while k < len(titles) and titles[k][1] <= a:
            k += 1
        if k < len(titles) and titles[k][0] < e:
            continue
        left, right = _BEFORE.search(raw[max(0, a - 60) : a]), _AFTER.match(raw[e : e + 60])
        stop = left.group(2).strip()[-1:] if left else ""
        look = f"{mark_form(m.group()):.0f}{2 if stop and stop in BREAKS else 1 if stop else 0}{0 if not right else 1 if right.group(1)[0].islower() else 2}"
        word = lambda g: NUMBER if g.isdigit() else plain(g)
        marks.append((a, e, word(left.group(1)) if left else "", word(right.group(1)) if right else "", look))
    return titles, marks


def mark_features(look: str, before: str, after: str, n_between: float, n_before_number: float, n_number_after: float, n_before: float, n_after: float) -> list[float]:
    """A mark with its neighbours: a number that belongs to the text stands in place of a word, one of a page between two
    words that go together. Counts are bounded, so that they mean the same in a sample and in a large collection."""
    form, stop, case = (float(x) for x in look)
    sign = lambda w: float(MISSING in w or bool(_ANY_DIGIT.search(w)))
    return [form, stop, case, min(n_between, 3.0), min(n_before_number, 3.0), min(n_number_after, 3.0), float(n_before > 0), float(n_after > 0), sign(before), sign(after)]


#: Length of what ``mark_features`` returns.
MARK_FEATURES = 10


def looks_set_apart(line: str) -> bool:
    """Very short, with a digit, or with as many capitals as a title."""
    return len(line) < 10 or bool(_ANY_DIGIT.search(line)) or len(_CAPITAL.findall(line)) * 2 >= line.count(" ") + 1


def page_lines(text: str, known) -> tuple[list[str], list[int], list[list[float]]]:
    """The lines of a text, which of them may be page furniture, and the features of these."""
    lines = [x.strip() for x in text.replace("\r", "").split("\n")]
    if len(lines) == 1:
        return lines, [], []
    near = around(lines)
    suspects = [i for i, x in enumerate(lines) if x and (len(x) < 0.8 * near[0] or looks_set_apart(x)) and not (x[-1] in BREAKS and x[-2:-1].isalpha())]
    return lines, suspects, [line_features(lines, i, known, near) for i in suspects]


def completes(body: list[str], line: str, known) -> bool:
    """Whether the line begins with the rest of a word that the line before breaks, the whole being a common one."""
    before = next((x for x in reversed(body) if x), "")
    left, right = (_LAST.search(before[:-1]), _WORD.match(line)) if before[-1:] and before[-1] in BREAKS else (None, None)
    return bool(left and right) and known(plain(left.group() + right.group()))


def read_page(text: str, known, lines: list[str], furniture: dict[int, float]) -> list[tuple[str, str, str, str, str]]:
    """``(kind, piece, left, right, look)`` of a text, given its lines and how likely these are furniture: ``page_no``;
    ``furniture``, lines taken for a running title by the line classifier, with their key; ``title`` and ``mark``, what may
    be a title or a page mark where the text has no line ends, to be judged with its neighbours; ``hyphen`` with both
    halves; ``word`` (a word not among the commonest with its neighbours)."""
    out: list[tuple[str, str, str, str, str]] = []
    raw = text.replace("\r", "")
    if len(lines) > 1:
        body = []
        for i, x in enumerate(lines):
            if furniture.get(i, 0.0) > (0.5 if looks_set_apart(x) else 0.75) and not completes(body, x, known):
                if _PAGE_LINE.fullmatch(x):
                    out.append(("page_no", squeeze(x), "", "", ""))
                    continue
                if any(c.isalpha() for c in x):
                    out.append(("furniture", squeeze(x), title_key(x), "", ""))
                    continue
            body.append(x)
        whole, broken = "\n".join(body), _BREAK_LINE
    else:
        titles, marks = inline_marks(raw)
        out += [("title", squeeze(raw[a:e]), title_key(raw[a:e]), "", "") for a, e in titles]
        out += [("mark", squeeze(raw[a:e]), before, after, look) for a, e, before, after, look in marks]
        rest, at = [], 0
        for a, e in sorted(titles + [m[:2] for m in marks]):
            rest.append(raw[at:a].strip())
            at = max(at, e)
        rest.append(raw[at:].strip())
        whole, broken = " ".join(rest), _BREAK_INLINE
    halves: set[tuple[str, str]] = set()
    kept, at = [], 0
    for m in broken.finditer(whole):
        if m.start() < at:
            continue
        left, right = _LAST.search(whole[at : m.start()]), _WORD.match(whole, m.end())
        if left and right and not (right.group()[0].isupper() and not left.group().isupper()):  # before a capital the mark is a stop
            halves.add((plain(left.group()), plain(right.group())))
            kept += [whole[at : at + left.start()], "\x01"]
            at = right.end()
    whole = "".join([*kept, whole[at:]])
    out += [("hyphen", "", a, b, "") for a, b in sorted(halves)]
    tokens = [NUMBER if t.isdigit() else t for t in _TOKEN.findall(plain(whole))]
    for i, w in enumerate(tokens):
        if not known(w) and w not in ("\x01", NUMBER) and any(c.isalpha() for c in w):
            out.append(("word", w, tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else "", ""))
    return out


#: Words up to this length are found by q-grams without one place, longer ones by two of their four segments.
SHORT_WORD = 7
_RESIZED = tuple(sorted((x, y) for x, y in MISREAD if len(x) != len(y)))


def _classes() -> dict[int, str]:
    """Of letters that scans take for each other, each is mapped to the first of its class."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for x, y in sorted(MISREAD):
        if len(x) == len(y):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {ord(c): find(c) for c in root}


_CLASS = _classes()


def shape(word: str) -> str:
    """The same for all words that differ only in letters taken for each other."""
    return word.translate(_CLASS)


def _grams(word: str) -> list[str]:
    """Positional q-grams of a word, with its length: all places but one, or two of four segments."""
    n = len(word)
    if n <= SHORT_WORD:
        return [f"{n}.{i}.{word[:i]}.{word[i + 1 :]}" for i in range(n)] if n > 1 else []
    at = [n * i // 4 for i in range(5)]
    parts = [word[at[i] : at[i + 1]] for i in range(4)]
    return [f"{n}.{i}{j}.{parts[i]}.{parts[j]}" for i in range(4) for j in range(i + 1, 4)]


def index_keys(word: str) -> list[str]:
    """Keys of a known word: itself, its shape and its q-grams."""
    return [f"={word}", f"~{shape(word)}", *_grams(word)]


def probe_keys(word: str) -> list[str]:
    """Keys under which the words that ``word`` may be a misreading of are found: the words with one misread pair of letters
    set right, its shape and its q-grams; q-grams with an illegible letter are left out."""
    keys = [k for k in _grams(word) if MISSING not in k]
    if MISSING not in word:
        keys.append(f"~{shape(word)}")
        keys += [f"={word[:i]}{y}{word[i + len(x) :]}" for x, y in _RESIZED for i in range(len(word)) if word.startswith(x, i)]
    return list(dict.fromkeys(keys))


def misreading(read: str, printed: str) -> list[tuple[str, str, int]] | None:
    """Where two words differ: what was read, what was printed, and where. None if they are equal or differ in more than one
    letter of a short word or two of a long one, unless all are usual misreadings, or in their length by an unusual one."""
    n, m = len(read), len(printed)
    if n == m:
        found = [(x, y, i) for i, (x, y) in enumerate(zip(read, printed)) if x != y]
        usual = all(x == MISSING or (x, y) in MISREAD for x, y, _ in found)
        most = max(2, n // 3) if usual else 1 if n <= SHORT_WORD else 2
        return found if 0 < len(found) <= most and len(found) < n else None
    i = 0
    while i < min(n, m) and read[i] == printed[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and read[n - 1 - j] == printed[m - 1 - j]:
        j += 1
    for start in range(max(0, i - 1), i + 1):  # one of the equal letters may belong to the change
        x, y = read[start : n - j], printed[start : m - j]
        if (x, y) in MISREAD:
            return [(x, y, start)]
    return None


def rank_features(form: str, printed: str, n_form: float, n_printed: float, n_before: float, n_after: float, n_rivals: float) -> list[float] | None:
    got = misreading(form, printed)
    if got is None:
        return None
    missing = sum(x == MISSING for x, _, _ in got)
    usual = sum((x, y) in MISREAD for x, y, _ in got)
    digits = sum(x.isdigit() and (x, y) not in MISREAD for x, y, _ in got)
    first, last = got[0], got[-1]
    return [missing, usual, digits, len(got) - missing - usual - digits, np.log1p(n_printed), np.log1p(n_before), np.log1p(n_after), float(first[2] == 0), float(last[2] + len(last[0]) == len(form)), float(len(form)), np.log1p(n_form) - np.log1p(n_printed), n_rivals, float(len(form) != len(printed))]


#: Length of what ``rank_features`` returns.
RANK_FEATURES = 13


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def typeset(text: str, title: str, rng: np.random.Generator) -> tuple[list[str], list[int], list[tuple[str, str, int]]]:
    """A clean text set in lines like a scanned page: its lines, whether each is furniture, and its broken words
    as (left, right, whether the hyphen belongs to the word)."""
    width = int(rng.integers(30, 60))
    mark = BREAKS[int(rng.integers(len(BREAKS)))]
    lines, flags, breaks, line = [], [], [], ""

    def smudge(word: str) -> str:
        i = int(rng.integers(len(word)))
        return word[:i] + {"l": "1", "o": "0", "e": "c", "t": "l", "n": "u", "h": "b"}.get(word[i], MISSING) + word[i + 1 :]

    source = text.split()
    if rng.random() < 0.5 and len(source) > 8:
        i = int(rng.integers(1, len(source) - 1))
        source[i:i] = ["in", "the", "year", f"{int(rng.integers(1500, 1700))},"]
    if rng.random() < 0.35 and len(source) > 8:  # a number that belongs to the text stands in place of a word
        i = int(rng.integers(1, len(source) - 1))
        source[i] = str(int(rng.integers(2, 150)))
        if rng.random() < 0.5 and source[i + 1].isalpha():  # before a word that the vocabulary may lack
            source[i + 1] = "".join(source[i + 1][int(k)] for k in rng.permutation(len(source[i + 1]))).lower()
    for word in source:
        if rng.random() < 0.02 and not any(c.isdigit() for c in word):
            word = smudge(word)
        if len(line) + len(word) + 1 <= width:
            line = f"{line} {word}".strip()
            continue
        core = _WORD.match(word)
        if core and len(core.group()) >= 5 and rng.random() < 0.5:
            w = core.group()
            k = w.index("-") + 1 if "-" in w and rng.random() < 0.6 else int(rng.integers(2, len(w) - 2))
            left, right = w[:k].rstrip("-"), w[k:].lstrip("-")
            if left and right:
                hyphen = int(w[:k].endswith("-") or w[k:].startswith("-"))
                breaks.append((plain(left), plain(right), hyphen))
                lines.append(f"{line} {left}{mark}".strip())
                line = right + word[core.end() :]
            else:
                lines.append(line)
                line = word
        else:
            lines.append(line)
            line = word
        flags.append(0)
        if rng.random() < 0.12:
            n = int(rng.integers(1, 150))
            case = rng.random()
            name = title.upper() if case < 0.4 else title.lower() if case > 0.9 else title
            if rng.random() < 0.2:
                name = " ".join(smudge(p) if rng.random() < 0.4 else p for p in name.split())
            letter, low = "ABCDEFGHK"[int(rng.integers(9))], _roman(n)
            forms = [name, f"{name}.", f"{name} {n}", f"{n} {name}", f"{name}. [{n}]", f"{name} [{n}]", f"[{n}]", f"- {n} -", f"Page {n}", f"Pag. {n}", f"fol. {n}", *[str(n)] * 3, f"{letter}{n % 4 + 1}", f"{letter}{n % 4 + 1}.", f"{low}."]
            extra = forms[int(rng.integers(len(forms)))]
            lines.append(extra)
            flags.append(1)
    if line:
        lines.append(line)
        flags.append(0)
    return lines, flags, breaks


def mark_samples(lines: list[str], flags: list[int]) -> list[tuple[str, str, str, int]]:
    """``(before, after, look, whether it is furniture)`` of what may be a page mark once the lines run on."""
    ends, at = [], 0
    for x in lines:
        ends.append((at, at + len(x)))
        at += len(x) + 1
    spans = [s for s, f in zip(ends, flags) if f]
    out = []
    for a, e, before, after, look in inline_marks(" ".join(lines))[1]:
        out.append((before, after, look, int(any(lo <= a and e <= hi for lo, hi in spans))))
    return out


def fit_models(texts: list[str], titles: list[str], seed: int = 5):
    """Line, mark, join and candidate classifiers from clean texts (at most SAMPLE_TEXTS) set with known noise."""
    rng = np.random.default_rng(seed)
    words = Counter(w for t in texts for w in (plain(x) for x in _WORD.findall(t)) if not w.isdigit())
    words = Counter(dict(sorted(words.items(), key=lambda kv: (-kv[1], kv[0]))[:SAMPLE_WORDS]))
    titles = [t for t in titles if len(title_key(t)) > 6] or ["The Tragedy of the Prince", "A Merry Play"]
    line_x, line_y, mark_x, mark_y, join_x, join_y, rank_x, rank_y = [], [], [], [], [], [], [], []
    pairs: Counter = Counter()
    streams = []
    for t in texts:
        s = [NUMBER if x.isdigit() else plain(x) for x in _WORD.findall(t)]
        streams.append(s)
        pairs.update(zip(s, s[1:]))
    known = words.__contains__
    few = max(1, min(8, 600 // max(1, len(texts))))  # a small sample is set several times
    for k, t in enumerate(texts * few):
        lines, flags, breaks = typeset(t, titles[k % len(titles)], rng)
        near = around(lines)
        for i, f in enumerate(flags):
            if f or rng.random() < 0.15:
                line_x.append(line_features(lines, i, known, near))
                line_y.append(f)
        for a, b, look, y in mark_samples(lines, flags):
            mark_x.append(mark_features(look, a, b, max(0, pairs[a, b] - y), pairs[a, NUMBER], pairs[NUMBER, b], words[a], words[b]))  # without the text's own pair
            mark_y.append(y)
        for a, b, y in breaks:
            join_x.append(join_features(words.get(a + b, 0), words.get(f"{a}-{b}", 0), words.get(a, 0), words.get(b, 0)))
            join_y.append(y)
    by_key: dict[str, list[str]] = {}
    for w in words:
        for key in index_keys(w):
            by_key.setdefault(key, []).append(w)
    letters = sorted({c for w in words for c in w if c.isalpha()}) or ["e"]
    rare = sorted(words, key=lambda w: (words[w], w))[: len(words) // 4]
    unseen = set(rare[i] for i in rng.permutation(len(rare))[: len(rare) // 2])
    swaps: dict[str, list[str]] = {}
    for x, y in sorted(MISREAD):
        if len(x) == len(y):
            swaps.setdefault(y, []).append(x)

    def smear(word: str) -> str:
        i = int(rng.integers(len(word)))
        r = rng.random()
        options = [j for j, c in enumerate(word) if c in swaps]
        if r < 0.35:
            return word[:i] + MISSING + word[i + 1 :]
        if options and r < 0.92:
            i = options[int(rng.integers(len(options)))]
            return word[:i] + swaps[word[i]][int(rng.integers(len(swaps[word[i]])))] + word[i + 1 :]
        return word[:i] + letters[int(rng.integers(len(letters)))] + word[i + 1 :]

    for s in streams:
        if len(s) < 4 or len(rank_x) > 60_000:
            continue
        for p in rng.integers(1, len(s) - 1, size=6):
            truth = s[p]
            if len(truth) < 2 or truth not in words:
                continue
            real = truth in unseen  # a word of its own that the vocabulary lacks
            form = truth if real else smear(truth)
            if not real and len(truth) > 3 and rng.random() < 0.12:
                form = smear(form)
            if form in words and not real:
                continue
            rivals = {c for key in probe_keys(form) for c in by_key.get(key, ()) if c not in unseen and misreading(form, c)}
            for c in sorted(rivals):
                before, after = pairs.get((s[p - 1], c), 0) - (c == truth), pairs.get((c, s[p + 1]), 0) - (c == truth)
                f = rank_features(form, c, words[truth] if real else 1 + words[truth] * 0.002, words[c], max(0, before), max(0, after), len(rivals))
                if f is not None:
                    rank_x.append(f)
                    rank_y.append(int(c == truth and not real))
    fit = lambda x, y, d: Boosted().fit(np.array(x or [[0.0] * d] * 2), np.array(y or [0, 1]))
    return fit(line_x, line_y, LINE_FEATURES), fit(mark_x, mark_y, MARK_FEATURES), fit(join_x, join_y, 5), fit(rank_x, rank_y, RANK_FEATURES)


def join_features(n_joined: float, n_hyphen: float, n_left: float, n_right: float) -> list[float]:
    return [np.log1p(n_joined), np.log1p(n_hyphen), np.log1p(n_left), np.log1p(n_right), np.log1p(n_hyphen) - np.log1p(n_joined)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs of neighbours of each batch, counted where they are read."""
    for b in (x.slice(i, 4000) for x in batches for i in range(0, x.num_rows, 4000)):
        words: Counter = Counter()
        pairs: Counter = Counter()
        for t in b.column(0).to_pylist():
            s = [NUMBER if w.isdigit() else w for w in _WORD.findall(t.lower().replace("ſ", "s"))]
            words.update(s)
            pairs.update(zip(s, s[1:]))
        rows = [(w, "", n) for w, n in words.items() if MISSING not in w and any(c.isalpha() for c in w)] + [(x, y, n) for (x, y), n in pairs.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["word", "next", "n"])


def _read_rows(common, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value.__contains__
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            ids, tcps, texts = (b.column(i).to_pylist() for i in range(3))
            pages = [page_lines(t, known) for t in texts]
            scores = model.predict(np.array([f for _, _, feats in pages for f in feats], float).reshape(-1, LINE_FEATURES))  # all lines of the batch at once
            rows, at = [], 0
            for r, p, t, (lines, suspects, _) in zip(ids, tcps, texts, pages):
                furniture = dict(zip(suspects, scores[at : at + len(suspects)]))
                at += len(suspects)
                rows += [(r, p, *e) for e in read_page(t, known, lines, furniture)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], b.column(0).type), *(pa.array([x[i] for x in rows], pa.string()) for i in range(1, 7))], names=["row_id", "tcp", "kind", "piece", "a", "b", "look"])

    return run


def _judge_marks(model):
    """The contexts of marks that are page furniture."""
    counts = ("n_between", "n_before_number", "n_number_after", "n_before", "n_after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            looks, before, after = (b.column(n).to_pylist() for n in ("look", "a", "b"))
            x = [mark_features(*row) for row in zip(looks, before, after, *(b.column(n).to_pylist() for n in counts))]
            keep = model.predict(np.array(x, float).reshape(-1, MARK_FEATURES)) > 0.5
            yield b.select(["look", "a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rank(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("form", "printed", "n_form", "n_printed", "n_before", "n_after", "n_rivals")}
            feats = [rank_features(*row) for row in zip(*cols.values())]
            ok = np.array([f is not None for f in feats], bool)
            score = np.zeros(len(feats))
            if ok.any():
                score[ok] = model.predict(np.array([f for f in feats if f is not None]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row_id", "source", "form", "before", "after", "printed")), pa.array(score)], names=["row_id", "source", "form", "before", "after", "printed", "score"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [misreading(f, p) is not None for f, p in zip(b.column("form").to_pylist(), b.column("printed").to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def _keys_of(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k) for i, w in enumerate(b.column(0).to_pylist()) for k in keys(w)]
            where = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(where) for c in b.columns), pa.array([r[1] for r in rows], pa.string())], names=[*b.schema.names, "key"])

    return run


def find_repairs(pages: DataFrame, clean: DataFrame, metadata: DataFrame) -> DataFrame:
    """``(row_id, kind, piece)``: one row per different repair in a row.

    ``pages(row_id, tcp, speech_text)`` are scanned; ``clean(speech_text)`` gives the vocabulary, the pairs of
    neighbours and the sample for the classifiers; ``metadata(tcp, title)`` the running titles.

    Edge cases: null and blank texts have no repairs; a text of any length is read whole; a ``row_id`` in
    several rows counts once (its greatest text); plays without a title in the metadata get theirs from the
    lines of their own pages; without clean texts no word is repaired and unbroken words are joined as they
    stand; other columns are ignored; empty tables give no rows.
    """
    spark = pages.sparkSession
    source = clean.where("speech_text is not null").select("speech_text")
    counts = cut_table(source.mapInArrow(_count_words, "word string, next string, n bigint").groupBy("word", "next").agg(F.sum("n").alias("n")))
    vocabulary = counts.where("next = ''").select("word", "n")
    pairs = counts.where("next <> ''").select("word", "next", "n")

    # the least count that at most COMMON_WORDS words reach; counts are gathered by their size, at most some hundred rows
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r.step, r.k) for r in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, float("inf")
    for size, k in sizes:
        held += k
        if held > COMMON_WORDS:
            break
        least = size
    common = frozenset(r.word for r in vocabulary.where(step >= least).select("word").toLocalIterator()) if least < float("inf") else frozenset()
    shared = spark.sparkContext.broadcast(common)  # at most COMMON_WORDS words

    sample = bounded_sample(source.where(F.length("speech_text") < 20_000), "speech_text", SAMPLE_TEXTS)
    titles = metadata.where("tcp is not null and title is not null").groupBy("tcp").agg(F.max(F.trim("title")).alias("title"))
    some = bounded_sample(titles, "title", SAMPLE_TEXTS)
    line_model, mark_model, join_model, rank_model = fit_models(sample, some)

    once = pages.where("row_id is not null and speech_text is not null").groupBy("row_id").agg(F.max(F.struct("speech_text", "tcp")).alias("r")).select("row_id", F.coalesce("r.tcp", F.lit("")).alias("tcp"), "r.speech_text")
    kind = dict(pages.dtypes)["row_id"]
    found = cut(once.mapInArrow(_read_rows(shared, line_model), f"row_id {kind}, tcp string, kind string, piece string, a string, b string, look string"))

    # page marks without line ends: with how often the words around them go together, and with numbers, in the clean texts
    marks = found.where("kind = 'mark'")
    places = marks.select("look", "a", "b").distinct()
    asked_for = [("n_between", "a", "b"), ("n_before_number", "a", NUMBER), ("n_number_after", NUMBER, "b"), ("n_before", "a", ""), ("n_after", "b", "")]
    side = lambda c: F.col(c) if c in ("a", "b") else F.lit(c)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), side(x).alias("word"), side(y).alias("next")) for name, x, y in asked_for])).alias("w")
    counted = places.select("look", "a", "b", wanted).select("look", "a", "b", "w.*").join(counts, ["word", "next"], "left")
    counted = counted.groupBy("look", "a", "b").agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name, _, _ in asked_for])
    foreign = counted.mapInArrow(_judge_marks(mark_model), "look string, a string, b string")
    page_no = found.where("kind = 'page_no'").select("row_id", "kind", "piece").unionByName(marks.join(foreign, ["look", "a", "b"]).select("row_id", F.lit("page_no").alias("kind"), "piece"))
    # running titles: by the play's title, or, where the metadata lack it, by the commonest such line or run of its pages
    lines = found.where("kind = 'furniture'")
    own = titles.select("tcp", F.col("title"))
    common = found.where("kind in ('furniture', 'title')").join(own, "tcp", "left_anti").groupBy("tcp", "a").agg(F.count("*").alias("n")).groupBy("tcp").agg(F.max_by("a", F.struct("n", "a")).alias("title"))
    keyed = cut(own.mapInArrow(_title_keys, "tcp string, title string").unionByName(common))
    checked = lines.join(keyed, "tcp", "left").select("row_id", "piece", "a", "title")
    header = checked.mapInArrow(_confirm_lines, f"row_id {kind}, kind string, piece string")
    inline = found.where("kind = 'title'").join(keyed, "tcp").mapInArrow(_match_titles, f"row_id {kind}, kind string, piece string")

    unknown = found.where("kind = 'word'").join(vocabulary.select(F.col("word").alias("piece")), "piece", "left_anti")
    words = unknown.select("row_id", F.lit("char").alias("source"), F.col("piece").alias("form"), F.col("a").alias("before"), F.col("b").alias("after")).distinct()
    broken = found.where("kind = 'hyphen'").select("row_id", F.col("a").alias("left"), F.col("b").alias("right")).distinct()
    n_of = lambda name: vocabulary.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    halves = broken.select("left", "right").distinct().withColumn("joined", F.concat("left", "right")).withColumn("hyphen", F.concat_ws("-", "left", "right"))
    for name in ("joined", "hyphen", "left", "right"):
        halves = halves.join(n_of(name), name, "left")
    halves = cut(halves.na.fill(0).mapInArrow(_decide_joins(join_model), "left string, right string, whole string, sure boolean"))
    whole = cut(broken.join(halves, ["left", "right"]).select("row_id", "whole", "sure"))

    doubtful = whole.where("not sure").select("row_id", F.lit("hyphen").alias("source"), F.col("whole").alias("form"), F.lit("").alias("before"), F.lit("").alias("after")).distinct()
    occurrences = cut(words.unionByName(doubtful))
    forms = occurrences.groupBy("form").agg(F.count("*").alias("n_form"))
    hashed = lambda df: df.withColumn("key", F.xxhash64("key"))
    probes = hashed(forms.mapInArrow(_keys_of(probe_keys), "form string, n_form bigint, key string"))
    index = hashed(vocabulary.select(F.col("word").alias("printed"), F.col("n").alias("n_printed")).mapInArrow(_keys_of(index_keys), "printed string, n_printed bigint, key string"))
    close = probes.join(index, "key").drop("key").distinct().mapInArrow(_candidates, "form string, n_form bigint, printed string, n_printed bigint")
    close = cut(close.withColumn("n_rivals", F.count("*").over(W.partitionBy("form"))))
    asked = occurrences.join(close, "form")
    asked = asked.join(pairs.select(F.col("word").alias("before"), F.col("next").alias("printed"), F.col("n").alias("n_before")), ["before", "printed"], "left")
    asked = asked.join(pairs.select(F.col("word").alias("printed"), F.col("next").alias("after"), F.col("n").alias("n_after")), ["printed", "after"], "left").na.fill(0, ["n_before", "n_after"])
    scored = asked.mapInArrow(_rank(rank_model), f"row_id {kind}, source string, form string, before string, after string, printed string, score double")
    best = scored.groupBy("row_id", "source", "form", "before", "after").agg(F.max(F.struct("score", "printed")).alias("b"))
    sign = F.col("form").contains(MISSING) | F.col("form").rlike(r"\d")
    repaired = cut(best.where((F.col("b.score") > 0.5) | (sign & (F.col("b.score") > SIGN_SCORE))).select("row_id", "source", "form", F.col("b.printed").alias("piece")))
    char = repaired.where("source = 'char'").select("row_id", F.lit("char").alias("kind"), "piece")
    fixed = repaired.where("source = 'hyphen'").select("row_id", F.col("form").alias("whole"), F.col("piece").alias("right_word"))
    hyphen = whole.join(fixed, ["row_id", "whole"], "left").select("row_id", F.lit("hyphen").alias("kind"), F.coalesce("right_word", "whole").alias("piece"), (F.col("right_word").isNotNull()).alias("misread"))
    also = hyphen.where("misread").select("row_id", F.lit("char").alias("kind"), "piece")
    return page_no.unionByName(header).unionByName(inline).unionByName(char).unionByName(hyphen.drop("misread")).unionByName(also).distinct()


def _title_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([title_key(t) for t in b.column(1).to_pylist()], pa.string())], names=["tcp", "title"])


def _match_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a run of capitalised words, the part that is the play's title."""
    for b in batches:
        ids, pieces = [], []
        for r, piece, title in zip(b.column("row_id").to_pylist(), b.column("piece").to_pylist(), b.column("title").to_pylist()):
            if got := title_span(piece, title):
                ids.append(r)
                pieces.append(got)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("row_id").type), pa.array(["header"] * len(ids), pa.string()), pa.array(pieces, pa.string())], names=["row_id", "kind", "piece"])


def _confirm_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines taken for a running title that are like the play's title, or of plays without any."""
    for b in batches:
        keep = [not t or likeness(a, t) > 0.6 for a, t in zip(b.column("a").to_pylist(), b.column("title").to_pylist())]
        b = b.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(["header"] * b.num_rows, pa.string()), b.column("piece")], names=["row_id", "kind", "piece"])


def title_span(piece: str, title: str) -> str | None:
    """The words of ``piece`` that spell ``title``, with a page number right before or after them; None if none do."""
    parts = piece.split(" ")
    n = len(title.split())
    best, span = 0.8, None
    for i in range(len(parts)):
        for k in (n, n - 1, n + 1):
            if k > 0 and i + k <= len(parts):
                score = likeness(squeeze(re.sub(r"[^\w\s]", " ", plain(" ".join(parts[i : i + k])))), title)
                if score > best:
                    best, span = score, (i, i + k)
    if span is None:
        return None
    a, e = span
    if a > 0 and parts[a - 1].isdigit():
        a -= 1
    if e < len(parts) and re.fullmatch(r"\[?\d+\]?", parts[e]):
        e += 1
    return " ".join(parts[a:e])


def _decide_joins(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("left", "right", "joined", "hyphen", "n_joined", "n_hyphen", "n_left", "n_right")}
            x = np.array([join_features(*r) for r in zip(c["n_joined"], c["n_hyphen"], c["n_left"], c["n_right"])]).reshape(-1, 5)
            compound = model.predict(x) > 0.5
            whole = [h if y else j for h, j, y in zip(c["hyphen"], c["joined"], compound)]
            sure = [bool(nh if y else nj) for nh, nj, y in zip(c["n_hyphen"], c["n_joined"], compound)]
            yield pa.RecordBatch.from_arrays([b.column("left"), b.column("right"), pa.array(whole, pa.string()), pa.array(sure, pa.bool_())], names=["left", "right", "whole", "sure"])

    return run
