"""Per-document text quality statistics and a prose rule (problem 10).

A text is cut into *segments*: lines, of which those wrapped by hand are joined
again, cut at sentence ends.  Every segment is judged prose or not from its
counts (words, share of common words, repeats, symbols, comma gaps); segments
too short to tell follow their neighbours on the line.  The verdict of the
text weighs the characters of both kinds.

Common words are learned from the corpus: per language, the words that most
documents use in segments shaped like sentences and that are at home there
rather than in the other segments.  Of the segments of 12 words or more that
are prose in the test corpus, 99.9 % have at most 25 % of repeated words and at
least 25 % of common words, half have 10 % and 67 %.  The limits of ``verdicts``
lie outside these.

Every text goes the same way, whatever its length.  It is cut into chunks of
CHUNK characters; each chunk is measured with HALO characters of its
neighbours in view, so all that is decided locally (words, boundaries, wrapped
lines, repeats) is decided as in the whole text.  What a chunk cannot decide
stays open in its summary: the line and the segment reaching over each end, as
counts, and the segments whose verdict hangs on a neighbour over the end.
Summaries merge associatively, FAN at a time in a tree of LEVELS levels, and
give exactly the counts of the whole text; a text of one chunk is a tree of
one leaf.  A task's work is bounded by what it reads, as no text is shuffled;
only summaries are.

Defined results: null, empty and blank texts have zero counts, null ratios and
no verdict; texts without a line break have one line; repeated rows each get
their row; of the caller's columns only the key is kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.runtime import stage

CHUNK = 4096
HALO = 320
FAN = 128
LEVELS = 3  # FAN ** LEVELS chunks hold the longest string Spark can have
COMMON_WORDS = 100  # per language
AT_HOME = 2  # a common word is used by so many times more documents in sentences than elsewhere
SUPPORT = 0.02  # and by this part of the documents that use the language's most common word
MAX_LANGUAGES = 10_000
COUNTS = ("n_chars", "n_words", "n_word_chars", "n_common", "n_symbols", "n_digits", "n_lines", "n_lines_punct", "n_prose_chars", "n_other_chars")

# Characters by what they do.
_LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
_STOPS = ".!?;。！？"
_WIDE_STOPS = "。！？"
_CLOSERS = ".!?:;。！？…\"'”’)"
_NO_WRAP = _CLOSERS + "|,"
_JOINERS = "'’-"
_BULLETS = "-*•>+"
_BLANKS = " \t\u3000"
_PAIR = re.compile(r"\s*[^:\s][^:]{0,59}:\s*\S{0,12}\s*")
# How far a local decision looks; all sums of them stay within HALO.
WRAPPED = (38, 160)  # solid lengths of a line that may be wrapped
_TRAIL, _LEAD, _SHORT, _BACK, _LONG_TOKEN, _LONG_WORD = 64, 32, 96, 192, 30, 24


class _Classes:
    """What every code point is, one bit a class, looked up once per character."""

    NAMES = ("alpha", "alnum", "digit", "decimal", "space")
    SETS = {"line_end": _LINE_ENDS, "stop": _STOPS, "wide_stop": _WIDE_STOPS, "closer": _CLOSERS, "no_wrap": _NO_WRAP, "joiner": _JOINERS, "bullet": _BULLETS, "blank": _BLANKS, "broken": "\ufffd\xc2\xf0\xa4", "bracket": ".)"}

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.flags = np.zeros(0x110000, np.uint16)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for i, chars in enumerate(self.SETS.values(), len(self.NAMES)):
            self.flags[[ord(c) for c in chars]] |= 1 << i

    def learn(self, codes: np.ndarray) -> None:
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        for c in np.flatnonzero(seen & ~self.known):
            ch = chr(c)
            self.flags[c] |= sum(bool(getattr(ch, "is" + n)()) << i for i, n in enumerate(self.NAMES))
            self.lower[c] = ord(ch.lower()[0])
        self.known |= seen


_BIT = {n: np.uint16(1 << i) for i, n in enumerate([*_Classes.NAMES, *_Classes.SETS])}


@functools.lru_cache(maxsize=1)
def _classes() -> _Classes:
    return _Classes()


def _shift(a: np.ndarray, by: int) -> np.ndarray:
    """``a[i - by]`` at i; the first value (or the last) stands at the ends."""
    if by == 0:
        return a
    out = np.empty_like(a)
    if by > 0:
        out[by:], out[:by] = a[:-by], a[0]
    else:
        out[:by], out[by:] = a[-by:], a[-1]
    return out


def _sums(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.int64)
    np.cumsum(a, out=out[1:])
    return out


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _long_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return _long_powers(base, 1 << (n - 1).bit_length())[:n]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    return x[first], np.diff(first, append=len(x))


def _at(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of ``x`` lie between the cuts, for an ``x`` with few hits."""
    return np.diff(np.searchsorted(np.flatnonzero(x), cuts))


class _Page:
    """Chunks with their halos, laid out one after the other, and what each character is."""

    def __init__(self, chunks: list[tuple[str, int, int]]) -> None:
        """``chunks``: (text, start, end) of each chunk in its text."""
        parts, self.start, self.end, self.base = [], [], [], []
        at = 0
        for text, a, b in chunks:
            lo = max(0, a - HALO)
            piece = text[lo : b + HALO]
            parts.append(piece)
            at += 2
            self.base.append(at - 2)
            self.start.append(at + a - lo)
            self.end.append(at + b - lo)
            at += len(piece)
        # blank lines keep the pieces apart, as the ends of a text do
        self.text = "\n\n" + "\n\n".join(parts) + "\n\n"
        self.start, self.end, self.base = np.array(self.start), np.array(self.end), np.array(self.base)
        c = self.c = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _classes()
        classes.learn(c)
        self.flags = classes.flags[c]
        self.solid = ~self.is_("space")
        n = len(c)
        index = np.arange(n, dtype=np.int32)
        self.line_end = self.is_("line_end")
        joined = (c == 10) & (_shift(c, 1) == 13)  # the \n of a \r\n
        self.first_end = self.line_end & ~joined
        after = _shift(self.line_end, 1) & ~joined
        after[0] = True
        self.line_start = after
        self.last_solid = np.maximum.accumulate(np.where(self.solid, index, np.int32(-1)))
        self.last_start = np.maximum.accumulate(np.where(after, index, np.int32(0)))
        ahead = np.where(self.solid, index, np.int32(n))
        self.next_solid = np.minimum.accumulate(ahead[::-1])[::-1]
        self._words(classes)
        self._boundaries(index)

    def is_(self, name: str, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.flags[at] & _BIT[name] != 0

    def _words(self, classes: _Classes) -> None:
        c = self.c
        letter = self.flags & (_BIT["alnum"] | _BIT["decimal"]) == _BIT["alnum"]
        inner = self.is_("joiner") & _shift(letter, 1) & _shift(letter, -1)
        self.word_char = letter | inner
        self.word = self.word_char & ~_shift(self.word_char, 1)
        run = letter & ~_shift(letter, 1)
        run_end = letter & ~_shift(letter, -1)
        starts, ends = np.flatnonzero(run), np.flatnonzero(run_end) + 1
        first = self.word[starts]  # the first letters of a word, up to its first joiner, stand for it
        starts, ends = starts[first], ends[first]
        low = classes.lower[c].astype(np.uint64)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(low * _powers(_BASE, len(c)), out=total[1:])
        self.word_at = starts
        # words too long to see whole from a chunk are told apart by nothing
        long = ends - starts > _LONG_WORD
        self.word_hash = np.where(long, np.uint64(0), (total[ends] - total[starts]) * _powers(_BASE_INVERSE, len(c))[starts])
        # the upper bits of the hash before the number of the word: one sort brings equal words together in order
        bits = max(1, len(starts) - 1).bit_length()
        low_bits = np.uint64((1 << bits) - 1)
        keys = np.sort(self.word_hash & ~low_bits | np.arange(len(starts), dtype=np.uint64))
        h, at = keys & ~low_bits, starts[(keys & low_bits).astype(np.int64)]
        near = np.flatnonzero((h[1:] == h[:-1]) & (h[1:] != 0) & (at[1:] - at[:-1] <= _BACK)) + 1
        same = np.searchsorted(self.base, at[near], "right") == np.searchsorted(self.base, at[near - 1], "right")
        self.echo = np.stack([at[near[same] - 1], at[near[same]]])  # a word and its next use nearby

    def _bullet(self, at: np.ndarray) -> np.ndarray:
        """Whether a list mark starts at these places, after some blanks."""
        last = len(self.c) - 1
        p = self.next_solid[at]
        ok = p - at <= _LEAD
        ch = lambda k: self.c[np.minimum(p + k, last)]
        is_ = lambda k, name: self.is_(name, np.minimum(p + k, last))
        mark = is_(0, "bullet") & is_(1, "space")
        box = (ch(0) == ord("[")) & (((ch(1) == ord("]")) & is_(2, "space")) | ((ch(2) == ord("]")) & is_(3, "space")))
        p = np.minimum(p + (ch(0) == ord("(")), last)
        close = lambda k: is_(k, "bracket") & is_(k + 1, "space")
        digits = is_(0, "decimal")
        number = digits & (close(1) | (is_(1, "decimal") & (close(2) | (is_(2, "decimal") & close(3)))))
        lettered = is_(0, "alpha") & (ch(0) < 128) & close(1)
        return ok & (mark | box | number | lettered)

    def _boundaries(self, index: np.ndarray) -> None:
        c = self.c
        starts = np.flatnonzero(self.line_start)
        bullets = np.zeros(len(c), bool)
        bullets[starts] = self._bullet(starts)
        at = starts[starts > 1]
        e = at - 1 - ((c[at - 1] == 10) & (c[at - 2] == 13))  # where the line end before it begins
        q = self.last_solid[e]
        ls = self.last_start[e]
        size = q - ls + 1
        wrapped = (e - q <= _TRAIL) & (size >= WRAPPED[0]) & (size <= WRAPPED[1]) & ~self.is_("no_wrap", np.maximum(q, 0)) & ~bullets[ls]
        lead = self.next_solid[at]
        nxt = np.minimum(lead, len(c) - 1)
        solid_line = (lead - at <= _LEAD) & (self.last_start[nxt] == at)
        soft = wrapped & solid_line & ~bullets[at] & (c[at] != ord("|")) & (c[at] != 9)
        self.group = self.line_start.copy()
        self.group[at[soft]] = False
        stops = np.flatnonzero(self.is_("stop"))
        stops = stops[stops < len(c) - 2]
        self.boundary = self.group.copy()
        for i in (stops[self.is_("blank", stops + 1)] + 2, (wide := stops[self.is_("wide_stop", stops)] + 1)[self.solid[wide]]):
            self.boundary[i[~self.line_start[i]]] = True
        self.at = np.flatnonzero(self.boundary)
        self.bullet = self._bullet(self.at)
        within = np.searchsorted(self.at, self.echo[0], "right") == np.searchsorted(self.at, self.echo[1], "right")
        self.repeat_at, self.echo_at = np.sort(self.echo[1][within]), np.sort(self.echo[1])

    def counts(self, cuts: np.ndarray, common: np.ndarray) -> np.ndarray:
        """STATS between the cuts, and what else the counts need: rows of STATS, word characters, symbols, digits."""
        c = self.c
        broken = self.is_("broken")
        for pattern, more in (("\xc3", 1), ("\xe2\u20ac", 2), ("\xef\xbf\xbd", 2)):
            hit = np.flatnonzero(c == ord(pattern[0]))
            for k, ch in enumerate(pattern[1:], 1):
                hit = hit[c[np.minimum(hit + k, len(c) - 1)] == ord(ch)]
            for k in range(more + 1):
                broken[np.minimum(hit + k, len(c) - 1)] = True
        begin = np.flatnonzero(self.solid & ~_shift(self.solid, 1))
        n = np.flatnonzero(self.solid & ~_shift(self.solid, -1)) + 1 - begin
        long = np.zeros(len(c), bool)
        for a, k in zip(begin[n > _LONG_TOKEN].tolist(), n[n > _LONG_TOKEN].tolist()):
            long[a : a + k] = True
        known = np.zeros(0, np.int64)
        if len(common):
            place = np.minimum(np.searchsorted(common, self.word_hash), len(common) - 1)
            known = self.word_at[(common[place] == self.word_hash) & (self.word_hash != 0)]
        alpha = self.is_("alpha")
        ends = np.append(self.at[1:], len(c))
        few = np.flatnonzero((ends - self.at <= _SHORT) & (np.searchsorted(self.word_at, ends) - np.searchsorted(self.word_at, self.at) < 7))
        colons = np.flatnonzero(c == ord(":"))
        few = few[np.searchsorted(colons, ends[few]) > np.searchsorted(colons, self.at[few])]
        pair = self.at[[i for i in few.tolist() if _PAIR.fullmatch(self.text, self.at[i], ends[i])]]
        within = lambda places: np.diff(np.searchsorted(places, cuts))
        dense = lambda x: np.diff(_sums(x)[cuts])
        return np.stack([
            np.diff(cuts), dense(self.solid), dense(alpha), _at(alpha & (c >= 0x370), cuts), _at(broken & self.solid, cuts), _at(long, cuts), within(self.word_at), within(known),
            _at(c == ord(","), cuts), within(self.repeat_at), within(self.at[self.bullet]), within(pair), within(self.echo_at), dense(self.word_char), _at(~self.is_("alnum") & self.solid, cuts), _at(self.is_("digit"), cuts),
        ], 1)

#: What a segment is judged by; all add up over its parts.
STATS = ("chars", "solid", "letters", "other_letters", "broken", "long", "words", "common", "commas", "repeats", "bullet", "pair", "echoes")
_N = len(STATS)


def verdicts(s: np.ndarray) -> np.ndarray:
    """1 prose, 0 not, -1 too short to tell, of rows of STATS."""
    chars, solid, letters, foreign, broken, long, n, common, commas, repeats, bullet, pair, echoes = s.astype(np.float64).T
    share = common / np.maximum(n, 1)
    told = share > np.where(bullet > 0, 0.32, 0.22)
    listed = (n >= 6) & (n < 3.5 * (1 + commas)) & (commas >= 3) & (share < 0.4)
    repeated = (n >= 6) & (repeats > 0.4 * n) | (n >= 2) & (n < 7) & (echoes >= n)
    junk = (broken > 0.12 * solid) | (letters < 0.55 * solid) | (long > 0.3 * solid) | repeated | listed
    short = np.where((bullet > 0) | (pair > 0), 0, -1)
    out = np.where(junk, 0, np.where(n >= 7, told, short))
    other_script = (letters > 0) & (foreign > 0.5 * letters)  # scripts written by other rules
    out = np.where(other_script, (letters >= 6) & (letters > 0.6 * solid), out)
    return np.where(solid == 0, -1, out).astype(np.int64)


# A part of a line's segments: characters before its first verdict, of prose, of other, its first and last verdict.
_EMPTY = (0, 0, 0, -1, -1)


def _join(a: tuple, b: tuple) -> tuple:
    if a[3] < 0:
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2], b[3], b[4])
    prose, other = a[1] + b[1], a[2] + b[2]
    if a[4] == 1:
        prose += b[0]
    else:
        other += b[0]
    return (a[0], prose, other, a[3], b[4] if b[3] >= 0 else a[4])


def _shut(a: tuple) -> tuple[int, int]:
    """Characters of prose and of other text of a whole line."""
    return (a[1] + a[0], a[2]) if a[3] == 1 else (a[1], a[2] + a[0])


def _item(verdict: int, chars: int) -> tuple:
    return (chars, 0, 0, -1, -1) if verdict < 0 else (0, chars * verdict, chars * (1 - verdict), verdict, verdict)


# A sequence of segments: whether a line starts in it, the part before that, both sums of whole lines, the part after.
_NOTHING = (0, *_EMPTY, 0, 0, *_EMPTY)


def _chain(a: tuple, b: tuple) -> tuple:
    if not b[0]:
        return (0, *_join(a[1:6], b[1:6]), 0, 0, *_EMPTY) if not a[0] else (*a[:8], *_join(a[8:], b[1:6]))
    if not a[0]:
        return (1, *_join(a[1:6], b[1:6]), *b[6:])
    prose, other = _shut(_join(a[8:], b[1:6]))
    return (*a[:6], a[6] + prose + b[6], a[7] + other + b[7], *b[8:])


def _sequence(kinds: list[int], chars: list[int], groups: list[bool]) -> tuple:
    """Chain of closed segments."""
    before, now, started, prose, other = _EMPTY, _EMPTY, 0, 0, 0
    for v, n, g in zip(kinds, chars, groups):
        if g:
            if started:
                x, y = _shut(now)
                prose, other = prose + x, other + y
            else:
                before, started = now, 1
            now = _EMPTY
        now = _join(now, _item(v, n))
    return (1, *before, prose, other, *now) if started else (0, *now, 0, 0, *_EMPTY)


# A summary: COUNTS but the last two; open lines at both ends (0 blank, 1 solid, 2 closed by punctuation) and whether a line
# ends between; whether a segment starts, the STATS before and after, whether a line starts with the last; the sequence.
_LINES, _CUT, _HEAD = 8, 11, 12
_TAIL, _TAIL_LINE, _SEQ = _HEAD + _N, _HEAD + 2 * _N, _HEAD + 2 * _N + 1


def _seen(s: np.ndarray) -> tuple[list[int], list[int]]:
    """Verdicts of segments and the characters they speak for."""
    return verdicts(s).tolist(), np.where(s[:, 1] > 0, s[:, 0], 0).tolist()


def summaries(chunks: list[tuple[str, int, int]], common: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Summary of every chunk (text, start, end), and the verdict on its last segment if nothing follows."""
    if not chunks:
        return [], []
    page = _Page(chunks)
    inside = np.zeros(len(page.c) + 1, np.int8)
    inside[page.start] += 1
    inside[page.end] -= 1
    here = page.at[np.cumsum(inside[:-1], dtype=np.int8)[page.at] > 0]
    cuts = np.unique(np.concatenate([page.start, page.end, here]))
    every = page.counts(cuts, common)
    stats = every[:, :_N]
    where, upto = np.searchsorted(cuts, page.start), np.searchsorted(cuts, page.end)
    opened = page.boundary[np.minimum(cuts, len(page.c) - 1)]
    group = page.group[np.minimum(cuts, len(page.c) - 1)].tolist()
    kinds, chars = _seen(stats)
    totals = np.add.reduceat(every[:, [0, 6, _N, 7, _N + 1, _N + 2]], np.stack([where, upto], 1).ravel()[:-1], axis=0)[::2].tolist()
    lines = _line_states(page)
    rows = stats.tolist()
    out = []
    for j, (a, b) in enumerate(zip(where.tolist(), upto.tolist())):
        first = a if opened[a] else a + 1  # the segment over the start is open unless one starts there
        head = rows[a] if first > a else [0] * _N
        if first >= b:
            state = [0, *head, *[0] * _N, 0, *_NOTHING]
        else:
            state = [1, *head, *rows[b - 1], int(group[b - 1]), *_sequence(kinds[first : b - 1], chars[first : b - 1], group[first : b - 1])]
        out.append([*totals[j], *lines[j], *state])
    return out, [kinds[b - 1] for b in upto.tolist()]


def _line_states(page: _Page) -> list[list[int]]:
    """Per chunk: solid lines that both start and end in it, those closed by punctuation, the open lines' states."""
    ends = np.flatnonzero(page.first_end)
    closed = page.is_("closer")
    out = []
    lo, hi = np.searchsorted(ends, page.start), np.searchsorted(ends, page.end)
    q = page.last_solid[np.maximum(ends - 1, 0)]
    solid = np.zeros(len(ends), bool)
    solid[1:] = q[1:] > ends[:-1]
    good = solid & closed[np.maximum(q, 0)]
    n_solid, n_good = _sums(solid), _sums(good)

    def state(upto: int, since: int) -> int:
        x = page.last_solid[upto - 1]
        return 0 if x < since else 1 + int(closed[x])

    for a, b, i, k in zip(page.start.tolist(), page.end.tolist(), lo.tolist(), hi.tolist()):
        if i == k:
            out.append([0, 0, state(b, a), 0, 0])
        else:
            first = state(int(ends[i]), a) if ends[i] > a else 0
            out.append([int(n_solid[k] - n_solid[i + 1]), int(n_good[k] - n_good[i + 1]), first, 1, state(b, int(ends[k - 1]))])
    return out


def merge(a: list[int], b: list[int]) -> list[int]:
    """Summary of two adjacent chunks."""
    out = [x + y for x, y in zip(a[:_LINES], b[:_LINES])]
    (ah, ac, at), (bh, bc, bt) = a[_LINES:_CUT], b[_LINES:_CUT]
    if ac and bc:
        line = bh or at
        out[6] += int(line > 0)
        out[7] += int(line == 2)
    out += [ah if ac else bh or ah, int(ac or bc), (bt if bc else bh or at) if ac or bc else 0] if ac else [bh or ah, bc, bt]
    bhead, btail = b[_HEAD:_TAIL], b[_TAIL:_TAIL_LINE]
    plus = lambda x, y: [p + q for p, q in zip(x, y)]
    if not a[_CUT]:
        return [*out, b[_CUT], *plus(a[_HEAD:_TAIL], bhead), *b[_TAIL:]]
    over = plus(a[_TAIL:_TAIL_LINE], bhead)
    if not b[_CUT]:
        return [*out, *a[_CUT:_TAIL], *over, *a[_TAIL_LINE:]]
    return [*out, *a[_CUT:_TAIL], *btail, b[_TAIL_LINE], *_chain(_chain(tuple(a[_SEQ:]), _single(over, a[_TAIL_LINE])), tuple(b[_SEQ:]))]


def _single(stats: list[int], starts_line: int) -> tuple:
    kinds, chars = _seen(np.array([stats]))
    return _sequence(kinds, chars, [bool(starts_line)])


def close(s: list[int], verdict: int | None = None) -> list[int]:
    """COUNTS of a whole text from its summary; ``verdict`` is that on its last segment, where it is known."""
    lines = [x for x in ((s[_LINES], s[_LINES + 2]) if s[_LINES + 1] else (s[_LINES],)) if x]
    last = _single(s[_TAIL:_TAIL_LINE], s[_TAIL_LINE]) if verdict is None else _sequence([verdict], [s[_TAIL] if s[_TAIL + 1] else 0], [bool(s[_TAIL_LINE])])
    seq = _chain(tuple(s[_SEQ:]), last)
    before, after = _shut(seq[1:6]), _shut(seq[8:])
    return [*s[:6], s[6] + len(lines), s[7] + lines.count(2), before[0] + seq[6] + after[0], before[1] + seq[7] + after[1]]


def _chunks(text: str) -> list[tuple[str, int, int]]:
    return [(text, a, min(a + CHUNK, len(text))) for a in range(0, len(text), CHUNK)]


def measure(text: str, common: np.ndarray) -> list[int]:
    """COUNTS of one text."""
    if not text.strip():
        return [0] * len(COUNTS)
    return close(functools.reduce(merge, summaries(_chunks(text), common)[0]))


_PAGE_CHARS = 1 << 19  # small enough for the processor's cache


def _pages(texts: list) -> Iterator[tuple[int, list[tuple[str, int, int]], list[int]]]:
    """(first row, chunks, number of chunks per row) of some neighbouring texts at a time; blank texts have none."""
    first, chunks, sizes, chars = 0, [], [], 0
    for i, t in enumerate(texts):
        own = _chunks(t) if t and not t.isspace() else []
        chunks += own
        sizes.append(len(own))
        chars += len(t) if own else 0
        if chars >= _PAGE_CHARS:
            yield first, chunks, sizes
            first, chunks, sizes, chars = i + 1, [], [], 0
    if sizes:
        yield first, chunks, sizes


def _measured(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, id, k, state) of chunks; texts of at most one chunk are closed: k is null and the state has COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            for first, chunks, sizes in _pages(texts):
                found, last = summaries(chunks, common)
                rows, ks, states, at = [], [], [], 0
                for i, n in enumerate(sizes):
                    own, verdict = found[at : at + n], last[at] if n else None
                    at += n
                    if n > 1:
                        rows += [first + i] * n
                        ks += range(n)
                        states += own
                    else:
                        rows.append(first + i)
                        ks.append(None)
                        states.append(close(own[0], verdict) if own else [0] * len(COUNTS))
                place = np.array(rows, np.int64)
                columns = [keys.take(pa.array(place)), pa.array(place + number), pa.array(ks, pa.int64()), pa.array(states, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "k", "state"])
            number += len(texts)

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges rows (key, id, k, state), sorted, whose id and k div FAN agree."""
    held = None
    for batch in batches:
        out = []
        for key, number, k, state in zip(batch["key"], batch["id"], batch["k"], batch["state"]):
            k, state = k // FAN, [int(x) for x in state]
            if held is not None and held[1] == number and held[2] == k:
                held = (key, number, k, merge(held[3], state))
            else:
                if held is not None:
                    out.append(held)
                held = (key, number, k, state)
        yield pd.DataFrame(out, columns=["key", "id", "k", "state"])
    if held is not None:
        yield pd.DataFrame([held], columns=["key", "id", "k", "state"])


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "state": [close([int(x) for x in s]) for s in batch["state"]]})


def sentence_like(s: np.ndarray, page: _Page, cuts: np.ndarray) -> np.ndarray:
    """Whether segments look like sentences by their shape alone: eight words or more, mostly letters, few repeats and commas, a stop at the end."""
    chars, solid, letters, _, broken, long, n, _, commas, repeats, bullet, *_ = s[:, :_N].T
    last = np.maximum(page.last_solid[np.minimum(cuts[1:], len(page.c)) - 1], 0)
    return (n >= 8) & (letters > 0.7 * solid) & (broken == 0) & (long == 0) & (repeats < 0.4 * n) & (n > 4 * commas) & (bullet == 0) & page.is_("stop", last)


def _word_uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, inside, outside): documents of a batch that use a word in sentence-like and in other segments."""
    for batch in batches:
        langs = batch["lang"].tolist()
        names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        for first, chunks, sizes in _pages(batch["text"].tolist()):
            if not chunks:
                continue
            page = _Page(chunks)
            cuts = np.append(page.at, len(page.c))
            like = sentence_like(page.counts(cuts, np.zeros(0, np.uint64)), page, cuts)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            piece = np.searchsorted(page.base, page.word_at, "right") - 1
            core = (page.word_at >= page.start[piece]) & (page.word_at < page.end[piece]) & (page.word_hash != 0)
            inside = like[np.searchsorted(page.at, page.word_at[core], "right") - 1]
            word, distinct = pd.factorize(page.word_hash[core])
            # every word of a document once inside and once outside, then per language
            used, _ = _distinct((word * len(sizes) + doc[piece[core]]) * 2 + inside)
            lang = np.array([names[langs[first + d]] for d in range(len(sizes))])[used // 2 % len(sizes)]
            groups, n = _distinct((used // 2 // len(sizes) * len(names) + lang) * 2 + used % 2)
            back, side = list(names), groups % 2
            table = pd.DataFrame({"lang": [back[i] for i in (groups // 2 % len(names)).tolist()], "word": distinct[groups // 2 // len(names)].view(np.int64), "inside": n * side, "outside": n * (1 - side)})
            yield table


def common_words(df: DataFrame, text: str, lang: str | None) -> DataFrame:
    """(lang, word, inside, outside): hashes of at most COMMON_WORDS words of each language, from all documents.

    Words are ranked by the documents that use them in sentence-like segments;
    those not AT_HOME there, and rare ones under SUPPORT or of one document, are
    none.  Documents without a language make one of their own.
    """
    rows = df.select((F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    uses = rows.mapInPandas(_word_uses, "lang string, word bigint, inside bigint, outside bigint")
    total = stage(uses.groupBy("lang", "word").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where(f"inside >= 2 and inside > {AT_HOME} * outside"))
    most = total.groupBy(F.col("lang").alias("__l")).agg(F.max("inside").alias("__m"))
    # few words are in so many documents, so the rank runs over a short list
    frequent = total.join(most, F.col("lang").eqNullSafe(F.col("__l"))).where(F.col("inside") >= SUPPORT * F.col("__m"))
    ranked = frequent.withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("inside"), "word")))
    return ranked.where(F.col("__r") <= COMMON_WORDS).select("lang", "word", "inside", "outside")


def statistics(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """One row per row of ``df``: key, COUNTS, ratios, and ``is_prose`` (null for texts without characters).

    The common words reach the driver: COMMON_WORDS for each of at most
    MAX_LANGUAGES languages, checked.
    """
    words = common_words(df, text, lang).select("word").distinct().limit(COMMON_WORDS * MAX_LANGUAGES + 1).toPandas()["word"]
    if len(words) > COMMON_WORDS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    common = np.sort(words.to_numpy(np.int64).view(np.uint64))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, id bigint, k bigint, state array<bigint>"
    measured = stage(rows.mapInArrow(_measured(common), schema))
    level = measured.where("k is not null")
    for _ in range(LEVELS):
        level = level.repartition("id", F.expr(f"k div {FAN}")).sortWithinPartitions("id", "k").mapInPandas(_merged, schema)
    ended = level.mapInPandas(_closed, f"key {kind}, state array<bigint>")
    counts = measured.where("k is null").select("key", "state").unionByName(ended).select("key", *[F.col("state")[i].alias(c) for i, c in enumerate(COUNTS)])
    judged = F.col("n_prose_chars") + F.col("n_other_chars")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.select(
        F.col("key").alias(key), *COUNTS,
        per("n_word_chars", "n_words").alias("mean_word_length"),
        per("n_symbols", "n_chars").alias("symbol_ratio"),
        per("n_digits", "n_chars").alias("digit_ratio"),
        per("n_lines_punct", "n_lines").alias("punct_line_share"),
        per("n_common", "n_words").alias("common_word_share"),
        F.when(judged > 0, F.col("n_other_chars") / judged).alias("other_share"),
        F.when(judged > 0, F.col("n_other_chars") <= 0.5 * judged).alias("is_prose"),
    )
