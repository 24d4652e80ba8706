"""Keyword-stuffed and link-list pages (problem 10): recurrence gaps and lag windows.

Every word of a page is judged by the words around it. A word counts as spam if it is a link, if it stands
in a stretch almost without function words (lists of nouns, tags, prices), or in a stretch where content
words come back after unnaturally short gaps, or in a stretch most of whose content words come back at a
steady distance, whatever that is: by equal gaps of a word, or at a lag at which the page's autocorrelation
stands out, or between the ends of a long chain of a word whose gaps do not vary at all. A longer passage in the style
of writing that is copied whole is no keyword. A page is flagged if more than the given share of its words counts as
spam. All pages are judged by themselves, so nothing is shuffled and a page is judged alike in any collection.

Function words are those of a list for some languages. A page in another language shows by its words of one or two
letters: where these are as frequent as in writing, its words of up to three letters stand for its function words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words to either side that make up the lag window of a word.
LAG = 12
#: At most this share of function words makes a stretch a list. A content word that makes up this share of its
#: window (and occurs three times in it) is dense, and a window with this share of dense words is stuffed.
LIST_SHARE, DENSE_TERM, DENSE_SHARE = 0.12, 0.19, 0.16
#: A word is steady if it comes back so often at gaps that differ by at most this share (or one word); a stretch
#: is steady if this share of its content words is. Lags count from this autocorrelation on.
TIMES, JITTER, STEADY_SHARE, LAG_SHARE = 5, 0.15, 0.66, 0.15
#: A steady passage of more than two lag windows is a keyword page only below this share of function words.
PASSAGE_SHARE = 0.45
#: A word that comes back so often at exactly one gap of at most two lag windows makes a keyword page of what lies between.
CHAIN = 12
#: A page below the first share of known function words is in another language if words of one or two letters have at
#: least the second share, and both together the third.
KNOWN_SHARE, SHORT_SHARE, BOTH_SHARE = 0.2, 0.05, 0.1
#: Shorter segments are judged with the words around them; fewer words make no list.
SHORT = 6

#: Function words of English (older spellings included), French, German, Latin, Spanish and Italian: fixed values.
FUNCTION_WORDS = frozenset(
    """a an the this that these those each every some any no all both other such my mine thy thine his her hers its our ours your yours their
    i me thou thee he him she it we us vs you ye they them who whom whose which what
    am is are was were be been being do does did doth done have has had haue hath hast hadst will would shall should may might must can could wilt shalt
    and or but if as than then so yet nor for because when while where how why though
    of in on at to from by with within without into onto vpon upon vnto unto vnder under ouer over out off up down about after before beyond between through
    not now never neuer still too again againe here there very just only also more most yes nay oh alas fie soft come let
    le la les un une des du de et ou mais dans sur sous avec pour par ne pas que qui il elle nous vous ils elles mon ma mes ton son sa ses ce cette est au aux en se je tu on
    der die das den dem des ein eine einen einem und oder aber nicht auf aus bei mit von zu zum zur ist sind war ich du er sie es wir ihr im am als auch wie nach
    et in ad ex cum sed non si qui quae quod ut nec aut est sunt iam mihi tibi ab per pro atque enim
    el los las una y o con por para su lo se il gli che di da non mi si per""".split()
)
_STRIP = re.compile(r"^[^\w$]+|[^\w]+$")
_LINK = re.compile(r"://|^\W*www\.|href=|</a>|^<a$", re.I)
_END = re.compile(r"[.!?;:][\"')\]]*$")


class _Words:
    """Numbers and kinds of the words seen by a task; forgotten when they get many."""

    FUNCTION, CONTENT, LINK, NONE, TWO, THREE = range(6)

    def __init__(self):
        self.clear()

    def clear(self):
        self.seen: dict[str, tuple[int, int, bool]] = {}
        self.terms: dict[str, int] = {}

    def look(self, raw: str) -> tuple[int, int, bool]:
        if _LINK.search(raw):
            got = (-1, self.LINK, False)
        elif term := _STRIP.sub("", raw).lower():
            term = term.replace("ſ", "s")
            kind = self.FUNCTION if term in FUNCTION_WORDS else self.CONTENT
            if kind == self.CONTENT and len(term) < 4 and term.isalpha() and term in raw.replace("ſ", "s"):
                kind = self.TWO if len(term) < 3 else self.THREE
            got = (self.terms.setdefault(term, len(self.terms)), kind, bool(_END.search(raw)))
        else:
            got = (-1, self.NONE, False)
        self.seen[raw] = got
        return got


def _chained(term: np.ndarray, lag: int) -> np.ndarray:
    """Words that stand, lag after lag, in a chain of at least TIMES equal words; terms below 0 never do."""
    n = len(term)
    rows = -(-n // lag)
    grid = np.full(rows * lag, -1, np.int64)
    grid[:n] = term
    flat = grid.reshape(rows, lag).T.ravel()  # each chain in one piece
    start = np.ones(len(flat), bool)
    start[1:] = flat[1:] != flat[:-1]
    start[::rows] = True
    run = np.cumsum(start) - 1
    long = (np.bincount(run)[run] >= TIMES) & (flat >= 0)
    return long.reshape(lag, rows).T.ravel()[:n]


def _lags(term: np.ndarray) -> np.ndarray:
    """Lags, the least first, at which the autocorrelation of the content words stands out; all lags are looked at."""
    n = len(term)
    size = 1 << (2 * n - 1).bit_length()
    total = np.zeros(n)
    rng = np.random.default_rng(5)
    for _ in range(4):  # equal terms agree in sign, others by chance
        sign = np.where(term >= 0, rng.choice([-1.0, 1.0], int(term.max()) + 1)[np.maximum(term, 0)], 0.0)
        f = np.fft.rfft(sign, size)
        total += np.fft.irfft(f * f.conj(), size)[:n]
    total /= 4
    lags = np.arange(1, (n - 1) // (TIMES - 1) + 1)
    return lags[total[lags] >= LAG_SHARE * max(total[0], 1)]


def _steady(term: np.ndarray, function: np.ndarray) -> np.ndarray:
    """Words of one page in stretches whose content words come back at a steady distance; other terms are -1."""
    n = len(term)
    out = np.zeros(n, bool)
    content = term >= 0
    at = np.flatnonzero(content)
    at = at[np.argsort(term[at], kind="stable")]
    back = np.zeros(n, np.int64)  # the steady distance of a word
    if len(at) >= TIMES:
        gap = np.where(term[at[1:]] == term[at[:-1]], np.diff(at), 0)
        like = (gap[1:] > 0) & (gap[:-1] > 0) & (np.abs(np.diff(gap)) <= np.maximum(1, JITTER * np.maximum(gap[1:], gap[:-1])))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], like.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= TIMES - 2:
                back[at[a : b + 2]] = int(np.median(gap[a : b + 1]))
    known = np.unique(term[content], return_counts=True)[1]
    if known.max(initial=0) >= TIMES:
        used: list[int] = []
        for lag in _lags(term):
            if any(lag % u == 0 for u in used):
                continue
            chained = _chained(np.where(content, term, -1), int(lag))
            if chained.any():
                used.append(int(lag))
                back[chained & (back == 0)] = lag
    hit = back > 0
    if not hit.any():
        return out
    total = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    hits, contents, functions = total(hit), total(content), total(function)
    for period in np.unique(back[hit]):
        wide = max(LAG, int(period))
        near = total(back == period)
        lo, hi = np.maximum(np.arange(n) - wide, 0), np.minimum(np.arange(n) + wide + 1, n)
        good = (near[hi] > near[lo]) & (hits[hi] - hits[lo] >= STEADY_SHARE * (contents[hi] - contents[lo]))
        if period > 2 * LAG:
            good &= functions[hi] - functions[lo] <= PASSAGE_SHARE * (hi - lo)
        out |= good
    return out


def _even_chains(group: np.ndarray, place: np.ndarray, line: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of every chain of at least CHAIN rows of one group whose places differ by one and the same gap,
    neither a word on end nor more than two lag windows. Rows are sorted by group and place; a word at the same place
    ``within`` one line or sentence after another, as in glossaries and refrains, makes no chain."""
    formed = (line[1:] != line[:-1]) & (within[1:] == within[:-1])
    gap = np.where((group[1:] == group[:-1]) & ~formed, np.diff(place), 0)
    same = (gap[1:] == gap[:-1]) & (gap[1:] > 2) & (gap[1:] <= 2 * LAG)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    first, end = edge[::2], edge[1::2]
    long = end - first >= CHAIN - 2
    return first[long], end[long] + 1


def _judge(texts: list[str], words: _Words) -> tuple[np.ndarray, ...]:
    """Words, and of these links, words of lists and stuffed words, for each text."""
    if len(words.seen) > 500_000:
        words.clear()
    seen, look = words.seen, words.look
    rows, doc, line_ends = [], [], []
    for k, text in enumerate(texts):
        for line in text.split("\n"):
            got = [seen.get(w) or look(w) for w in line.split()]
            if got:
                rows += got
                doc += [k] * len(got)
                line_ends.append(len(rows) - 1)
    n_docs = len(texts)
    if not rows:
        return tuple(np.zeros(n_docs, np.int64) for _ in range(4))
    table = np.array(rows, dtype=np.int64)
    doc = np.array(doc, dtype=np.int64)
    end = table[:, 2].astype(bool)
    end[line_ends] = True
    real = table[:, 1] != _Words.NONE
    # segments keep their ends when marks without letters are dropped
    segment = np.concatenate([[0], np.cumsum(end)[:-1]])[real]
    term, kind, doc = table[real, 0], table[real, 1], doc[real]
    n = len(term)
    if not n:
        return tuple(np.zeros(n_docs, np.int64) for _ in range(4))
    share = lambda flag: np.bincount(doc[flag], minlength=n_docs) / np.maximum(1, np.bincount(doc, minlength=n_docs))
    known, two = share(kind == _Words.FUNCTION), share(kind == _Words.TWO)
    other = (known < KNOWN_SHARE) & (two >= SHORT_SHARE) & (known + two >= BOTH_SHARE)
    short_word = (kind == _Words.TWO) | (kind == _Words.THREE)
    kind[short_word] = np.where(other[doc[short_word]], _Words.FUNCTION, _Words.CONTENT)
    at = np.arange(n)
    doc_lo, doc_hi = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    seg_lo, seg_hi = np.searchsorted(segment, segment, "left"), np.searchsorted(segment, segment, "right")
    short = seg_hi - seg_lo < SHORT
    lo = np.maximum(at - LAG, np.where(short, doc_lo, np.maximum(seg_lo, doc_lo)))
    hi = np.minimum(at + LAG + 1, np.where(short, doc_hi, np.minimum(seg_hi, doc_hi)))

    def within(flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[b] - total[a]

    wide_lo, wide_hi = np.maximum(at - LAG, doc_lo), np.minimum(at + LAG + 1, doc_hi)
    function = kind == _Words.FUNCTION
    in_list = (within(function, lo, hi) <= LIST_SHARE * (hi - lo)) & (hi - lo >= SHORT)
    # gaps between equal content words: positions sorted by document and term
    content = np.flatnonzero(kind == _Words.CONTENT)
    dense = np.zeros(n, bool)
    if len(content):
        step = 2 * LAG + 2
        key = (doc[content] * (int(term.max()) + 2) + term[content]) * np.int64(n + step) + content
        order = np.argsort(key, kind="stable")
        s = key[order]
        close = np.searchsorted(s, s + LAG, "right") - np.searchsorted(s, s - LAG, "left")
        own = content[order]
        dense[own] = close >= np.maximum(3, DENSE_TERM * (wide_hi - wide_lo)[own])
    stuffed = within(dense, wide_lo, wide_hi) >= DENSE_SHARE * (wide_hi - wide_lo)
    if len(content) > CHAIN:
        edge = _even_chains(s // (n + step), own, segment[own], own - seg_lo[own])
        open_at = np.bincount(own[edge[0]], minlength=n + 1) - np.bincount(own[edge[1]] + 1, minlength=n + 1)
        stuffed |= np.cumsum(open_at)[:n] > 0
    if len(content):
        # only pages with a window half of whose content words come often enough can have a steady stretch
        _, which, times = np.unique(s // (n + step), return_inverse=True, return_counts=True)
        often = np.zeros(n, bool)
        often[own] = times[which] >= TIMES
        of_content = within(kind == _Words.CONTENT, wide_lo, wide_hi)
        again = np.bincount(doc[often & (2 * within(often, wide_lo, wide_hi) >= of_content)], minlength=n_docs) > 0
        for k in np.flatnonzero(again):
            lo_k, hi_k = np.searchsorted(doc, [k, k + 1])
            page = slice(lo_k, hi_k)
            stuffed[page] |= _steady(np.where(kind[page] == _Words.CONTENT, term[page], -1), function[page])
    link = kind == _Words.LINK
    count = lambda flag: np.bincount(doc[flag], minlength=n_docs)
    return np.bincount(doc, minlength=n_docs), count(link), count(in_list & ~link), count(stuffed & ~in_list & ~link)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
        n, link, listed, stuffed = _judge(b.column(1).to_pylist(), words)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (n, link, listed, stuffed))], names=["id", "n_words", "n_link", "n_listed", "n_stuffed"])


def spam_shares(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_words, n_link, n_listed, n_stuffed, spam_share)`` for every page with words.

    Edge cases: null, empty and blank texts, and texts of marks only, have no words and give no row; a text of
    any length is judged whole; a repeated row gives its row again; other columns are ignored; an empty table
    gives no rows.
    """
    kind = dict(pages.dtypes)[id_col]
    got = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(_batches, f"id {kind}, n_words bigint, n_link bigint, n_listed bigint, n_stuffed bigint")
    return got.where("n_words > 0").withColumn("spam_share", (F.col("n_link") + F.col("n_listed") + F.col("n_stuffed")) / F.col("n_words"))


def spam_pages(pages: DataFrame, id_col: str, text_col: str, share: float = 0.5) -> DataFrame:
    """The rows of ``spam_shares`` with more than ``share`` of their words in keywords, links or tags."""
    return spam_shares(pages, id_col, text_col).where(F.col("spam_share") > share)
