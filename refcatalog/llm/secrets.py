"""Secret scans: patterns, and a linear-chain conditional random field that adds to them.

Tokens are runs of ASCII letters, digits, underscores and non-ASCII characters.
The field tags each as begin (of a secret), inside or outside, from its shape,
its neighbouring words, the gaps around it and features of its file, and is
decoded by Viterbi over all tokens of a text. The values that the patterns find,
and rewritten copies of them in pieces and cut short, are the training signal;
what the patterns find always stays.
"""

from __future__ import annotations

import bisect
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import byte_class, mix, slices, utf8, word_hashes, words

#: The patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "crf"]

#: A token of this many bytes (with a digit, or longer) looks like a secret.
SHORTEST, LONG = 8, 24
#: Of documents without a match, one in so many may still hold one added span of a class.
ROWS_A_SPAN = 4_000
#: Rewritten copies in all, about, and of each match at least and at most.
COPIES, LEAST_COPIES, MOST_COPIES = 6_000, 3, 90
#: Characters of the surroundings that a rewritten copy keeps on each side.
SHOWN = 150
SLOTS, BINS = 12, 1 << 11
#: Tokens whose features are held at once.
BLOCK = 1 << 15
#: Consecutive tokens that are learned from together, and how many such chunks an update of the weights takes.
CHUNK, BATCH = 8, 512
#: Tokens that a task learns from at least, about: with fewer, its weights are too unlike those of other tasks to be joined.
TASK = 2_000_000
#: Passes over all rows at least and at most, and the tokens they read together where that makes more than the least.
LEAST_PASSES, MOST_PASSES, READ = 2, 8, 8_000_000
#: Binary digits after the point of the sums that passes are joined by; whole numbers, so that their order changes nothing.
POINT = 36

_assign, _access, _hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_named, _NAMES = re.compile(ASSIGN.split("([")[0].removesuffix(r"""\x20*["']?"""), re.I | re.A), ("passw", "secret", "token", "api")
#: A run of hexadecimal digits that is long enough, when each of them is an x and all else is blank.
_DIGITS, _RUN = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256)), b"x" * LEAST["hex"]
_TOKEN = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x5F, 0x5F), (0x80, 0xFF))
_KIND = np.zeros(256, np.uint8)
_KIND[0x30:0x3A] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x61:0x67] = 4
_KIND[0x67:0x7B] = 8
_KIND[0x5F] = 16
_KIND[0x80:] = 32


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters, sorted by start and kind: leftmost non-overlapping matches of each kind that are long enough."""
    out = []
    if ("=" in text or ":" in text) and _names(text):
        out += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _RUN in text.encode("utf-8", "replace").translate(_DIGITS):
        out += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _names(text: str) -> bool:
    """Whether a key word of an assignment may be in ``text``."""
    low = text.lower()
    return any(x in low for x in _NAMES)


def plain(text: str, spans: list[tuple[int, int, str]]) -> bool:
    """Whether a text with these spans of the patterns has neither a match nor a key word of an assignment before a mark."""
    return not spans and not (_names(text) and _named.search(text))


@dataclass
class Tokens:
    """Tokens of a slice of rows."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    row: np.ndarray
    kinds: np.ndarray
    candidate: np.ndarray
    digits: np.ndarray  # in each token
    file: np.ndarray  # of each row: a number for its share of digits and of lines


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, firsts = words(data, offsets, _TOKEN)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    kinds = np.zeros(len(starts), np.uint8)
    if len(starts):
        edges = np.stack([starts, ends], axis=1).ravel()
        if edges[-1] == len(data):
            edges = edges[:-1]
        kinds = np.bitwise_or.reduceat(_KIND[data], edges)[::2]
    size = ends - starts
    candidate = (((kinds & 1) > 0) & (size >= SHORTEST)) | ((size >= LONG) & ((kinds & 32) == 0))
    total = np.maximum(np.diff(offsets), 1)
    upto = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    seen = upto(_KIND[data] == 1)
    digits = np.minimum((100 * np.diff(seen[offsets]) / total), 15).astype(np.int64)
    lines = np.minimum(np.log2(1 + np.diff(upto(data == 10)[offsets])), 7).astype(np.int64)
    return Tokens(data, starts, ends, firsts, row, kinds, candidate, seen[ends] - seen[starts], digits * 8 + lines)


def features(t: Tokens, at: np.ndarray) -> np.ndarray:
    """Rows of ``SLOTS`` feature numbers for the consecutive tokens ``at``."""
    n = len(t.starts)
    out = np.zeros((SLOTS, len(at)), np.int64).T  # slots are read one by one
    if not len(at):
        return out
    before, after = np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)
    has_before = (at > 0) & (t.row[before] == t.row[at])
    has_after = (at < n - 1) & (t.row[after] == t.row[at])
    # Words and gaps are hashed once, for the token and both of its neighbours.
    lo, hi = int(before[0]), int(after[-1]) + 1
    word = word_hashes(t.data, t.starts[lo:hi], t.ends[lo:hi])
    gap = np.zeros(hi - lo + 1, np.uint64)  # before each token
    some = np.flatnonzero(t.row[lo : hi - 1] == t.row[lo + 1 : hi]) + 1
    gap[some] = word_hashes(t.data, t.ends[lo + some - 1], np.minimum(t.starts[lo + some], t.ends[lo + some - 1] + 6), lower=False)
    sizes, kinds = t.ends[lo:hi] - t.starts[lo:hi], t.kinds[lo:hi].astype(np.int64)
    size, kind = sizes[at - lo], kinds[at - lo]
    length = np.minimum(size, 63)
    prefix = word_hashes(t.data, t.starts[at], t.starts[at] + np.minimum(4, size), lower=False)
    share = (8 * t.digits[at].astype(np.int64) // np.maximum(size, 1)).astype(np.int64)
    values = [
        kind * 64 + length,
        kind,
        length,
        prefix,
        np.where(has_before, word[before - lo], np.uint64(1)),
        np.where(has_after, word[after - lo], np.uint64(1)),
        np.where(has_before, gap[at - lo], np.uint64(0)),
        np.where(has_after, gap[at - lo + 1], np.uint64(0)),
        kind * 16 + share,
        t.file[t.row[at]],
        np.where(has_before, kinds[before - lo] * 64 + np.minimum(sizes[before - lo], 63), -1),
        np.where(has_after, kinds[after - lo] * 64 + np.minimum(sizes[after - lo], 63), -1),
    ]
    for s, v in enumerate(values):
        raw = v.astype(np.uint64) if v.dtype != np.uint64 else v
        out[:, s] = s * BINS + (mix(raw + np.uint64(s)) >> np.uint64(53)).astype(np.int64)
    return out


@dataclass
class Field:
    """Weights of the tags outside, begin, inside: of each feature, of each step, and of the first tag.

    ``least``: by how much a path with a span must be better than the same path
    without it, for each of its tokens, of spans without a digit and with one.
    """

    unary: np.ndarray
    step: np.ndarray
    first: np.ndarray
    least: tuple[float, float] = (0.0, 0.0)


_START = np.array([0, 0, -1e9])  # nor stands first
_BLOCKED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])  # inside never follows outside


def _forward_backward(u: np.ndarray, step: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (n, length, 3), pair marginals (3, 3) summed by ``share``, and marginals of the first tag, of chunks of one length that begin with the scores ``start`` (n, 3)."""
    n, size, _ = u.shape
    likely = lambda x: np.exp(np.maximum(x - np.maximum(np.maximum(x[..., 0], x[..., 1]), x[..., 2])[..., None], -50))
    total = np.ones((3, 1))
    psi, turn, begin = likely(u), np.exp(np.clip(step, -50, 50)) * (step > -1e8), likely(start) * (start > -1e8)
    a, b = np.empty((size, n, 3)), np.empty((size, n, 3))
    a[0] = begin * psi[:, 0]
    for t in range(size):
        if t:
            a[t] = (a[t - 1] @ turn) * psi[:, t]
        a[t] /= a[t] @ total
    b[-1] = 1
    pairs = np.zeros((3, 3))
    for t in range(size - 1, 0, -1):
        ahead = psi[:, t] * b[t]
        back = ahead @ turn.T
        pairs += turn * ((a[t - 1] * (share[:, None] / ((a[t - 1] * back) @ total))).T @ ahead)
        b[t - 1] = back / (back @ total)
    p = a * b
    p /= p @ total
    return p.transpose(1, 0, 2), pairs, p[0]


def _values(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) in characters of what the patterns hold to be secret: of an assignment its value only."""
    return [((_assign.match(text, a).start(2) if kind == "assign" else a), b) for a, b, kind in spans]


#: Characters of rewritten values: keys of mixed letters and digits, capital or small ones, hexadecimal ones.
_MIXES = [string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789ABCDEF"]


def _rewritten(text: str, draw: random.Random, copies: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """``copies`` rewritten copies of each pattern's match with its surroundings, and where the value is.

    Values come in pieces of 3 to 12 characters, or whole from other characters,
    now and then with a word and an underscore before them; of assignments also
    with other key words, short, or of letters only.
    """
    some = lambda known, n: "".join(draw.choice(known) for _ in range(n))
    for a, b, kind in pattern_spans(text):
        for turn in range(copies):
            head, value, tail = text[max(0, a - SHOWN) : a], text[a:b], text[b : b + SHOWN]
            if kind == "assign":
                value = text[_assign.match(text, a).start(2) : b]
                head += draw.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "passphrase", "key"]) + draw.choice(["=", ": ", " = ", "='", ' = "', '": "', " "])
                tail = head[-1] * (head[-1] in "'\"") + tail.lstrip("'\"")
            if turn % 3 == 1:  # whole, of other characters
                value = some(draw.choice(_MIXES), draw.randint(16, 44))
                if draw.random() < 0.3:
                    value = some(string.ascii_lowercase, draw.randint(2, 4)) + "_" + value
            elif kind == "assign" and turn % 3 == 2:
                known = string.ascii_lowercase + (string.digits if draw.random() < 0.3 else "")
                value = some(known, draw.randint(6, 18))
            else:
                if draw.random() < 0.5:
                    value = some(string.ascii_letters + string.digits, len(value))
                mark, parts = draw.choice("-./+="), []
                while value:
                    n = draw.randint(3, 12)
                    parts.append(value[:n])
                    value = value[n:]
                value = mark.join(parts)
            yield head + value + tail, [(len(head), len(head) + len(value))]


@dataclass
class Lesson:
    """How all rows are learned from, as counts over all of them give it: copies of each match, weights of chunks of ordinary tokens, of those with a digit and of those with a secret or what looks like one, and the mean weight."""

    copies: int
    weights: np.ndarray
    mean: float
    passes: int

    @staticmethod
    def of(matches: int, chunks: np.ndarray) -> Lesson:
        """Where ordinary chunks and those with a digit outnumber the others, their weights sum up to that of the others, so that rare forms of secrets can stand against them."""
        copies = min(MOST_COPIES, max(LEAST_COPIES, COPIES // max(1, matches)))
        total = chunks + np.array([0, 0, matches * copies])
        weights = np.minimum(1.0, max(1, total[2]) / np.maximum(1, total))
        tokens = CHUNK * max(1, int(chunks.sum()))
        return Lesson(copies, weights, float((total * weights).sum() / max(1, total.sum())), min(MOST_PASSES, max(LEAST_PASSES, READ // tokens)))


def _chunks(t: Tokens, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of each chunk of ``CHUNK`` tokens of a text (the last may be shorter), and its kind: 2 with a marked token, 1 with a digit, else 0."""
    if not len(t.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = np.arange(len(t.starts)) - t.firsts[:-1][t.row]
    at = np.flatnonzero(within % CHUNK == 0)
    return at, np.maximum.reduceat(np.where(marked, 2, t.kinds & 1).astype(np.int64), at)


def _taught(texts: list[str], found: list[list[tuple[int, int, str]]], copies: int, turn: int) -> tuple[Tokens, np.ndarray]:
    """Tokens of ``texts``, each followed by rewritten copies of its matches, and their tags."""
    each, origin = [], []
    for text, known in zip(texts, found, strict=True):
        spans, own = _values(text, known), len(each)
        each.append((text, spans))
        if spans:
            each += _rewritten(text, random.Random(zlib.crc32(text.encode()) + turn), copies)
        origin += [own] * (len(each) - own)
    data, offsets = utf8(pa.array([x for x, _ in each], pa.large_string()))
    t = tokens(data, offsets)
    t.file = t.file[origin]
    gold = np.zeros(len(t.starts), np.int64)
    for r, (_, spans) in enumerate(each):
        if not spans:
            continue
        at = np.append(np.flatnonzero((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80), offsets[r + 1] - offsets[r]) + offsets[r]
        for a, b in spans:
            i, j = np.searchsorted(t.starts, at[a]), np.searchsorted(t.starts, at[b])
            if i < j and not gold[i]:
                gold[i], gold[i + 1 : j] = 1, 2
    return t, gold


class Learner:
    """Weights that follow the gradient of the log likelihood, update by update, each by its own rate (AdaGrad).

    ``seen`` is the sum of each weight's squared gradients of former passes,
    ``own`` that of this one; by it the weights of several tasks are joined.
    """

    def __init__(self, weights: np.ndarray, seen: np.ndarray, lesson: Lesson, turn: int, rate: float = 0.3, ridge: float = 1e-6):
        self.weights, self.seen, self.own = weights.copy(), seen, np.zeros_like(weights)
        self.lesson, self.turn, self.rate, self.ridge, self.draw = lesson, turn, rate, ridge, np.random.default_rng(11 + turn)

    def learn(self, texts: list[str]) -> None:
        """Every token of ``texts``, a number of chunks at a time."""
        t, gold = _taught(texts, [pattern_spans(x) for x in texts], self.lesson.copies, self.turn)
        at, kind = _chunks(t, (gold > 0) | t.candidate)
        ends = np.append(at[1:], len(t.starts))
        for k in range(0, len(at), BATCH):
            self._update(t, gold, at[k : k + BATCH], ends[k : k + BATCH], self.lesson.weights[kind[k : k + BATCH]])

    def _update(self, t: Tokens, gold: np.ndarray, at: np.ndarray, ends: np.ndarray, share: np.ndarray) -> None:
        field = field_of(self.weights)
        some = np.arange(at[0], ends[-1])
        chunk = np.repeat(np.arange(len(at)), ends - at)
        place = chunk * CHUNK + some - at[chunk]
        x = features(t, some)
        # A random third of the feature slots is hidden in each update, so that no single one (a prefix, say) carries a tag alone.
        shown = np.flatnonzero(self.draw.random(SLOTS) < 2 / 3).tolist()
        u = np.tile([0.0, -50.0, -50.0], (len(at) * CHUNK, 1))  # what a text lacks at its end is outside
        u[place] = _scores(field.unary, x, shown)
        y = np.zeros(len(u), np.int64)
        y[place] = gold[some]
        one = np.eye(3)[y].reshape(-1, CHUNK, 3)
        opens = at == t.firsts[:-1][t.row[at]]
        prior = np.where(opens, 0, gold[np.maximum(at - 1, 0)])
        step = field.step + _BLOCKED
        p, expected, begun = _forward_backward(u.reshape(one.shape), step, np.where(opens[:, None], field.first + _START, step[prior]), share)
        pull = np.zeros((SLOTS * BINS + 4, 3))
        wrong = ((one - p) * share[:, None, None]).reshape(-1, 3)[place].T.copy()
        for s in shown:
            bins, own = x[:, s] - s * BINS, slice(s * BINS, (s + 1) * BINS)
            for c in (1, 2):
                pull[own, c] = np.bincount(bins, wrong[c], BINS)
            pull[own, 0] = -pull[own, 1] - pull[own, 2]  # the three add up to nothing
        first = (one[:, 0] - begun) * share[:, None]
        y = y.reshape(-1, CHUNK)
        pull[-4:-1] = np.bincount((3 * y[:, :-1] + y[:, 1:]).ravel(), np.repeat(share, CHUNK - 1), 9).reshape(3, 3) - expected
        for tag in range(3):
            pull[-4 + tag] += first[~opens & (prior == tag)].sum(axis=0)
        pull[-1] = first[opens].sum(axis=0)
        g = pull / (self.lesson.mean * CHUNK * BATCH)
        g -= self.ridge * self.weights
        self.own += np.square(g, out=pull)
        size = np.add(self.seen, self.own, out=pull)
        size += 1e-16
        g *= self.rate
        g /= np.sqrt(size, out=size)
        self.weights += g


def field_of(weights: np.ndarray) -> Field:
    """The field whose features, steps and first tags weigh so, in this order."""
    return Field(weights[:-4], weights[-4:-1], weights[-1])


def _blank() -> np.ndarray:
    return np.zeros((SLOTS * BINS + 4, 3))


def _counted(texts: list[str]) -> tuple[int, int, np.ndarray]:
    """Plain texts, matches of the patterns, and chunks of each kind."""
    spans = [pattern_spans(x) for x in texts]
    t, gold = _taught(texts, spans, 0, 0)
    return sum(map(plain, texts, spans)), sum(map(len, spans)), np.bincount(_chunks(t, (gold > 0) | t.candidate)[1], minlength=3)


def fit(texts: list[str]) -> Field:
    """The field that best explains the patterns' values in ``texts`` and in rewritten copies of them, without Spark: as ``train`` does in one task."""
    _, matches, chunks = _counted(texts)
    lesson = Lesson.of(matches, chunks)
    weights, seen = _blank(), _blank()
    for turn in range(lesson.passes):
        one = Learner(weights, seen, lesson, turn)
        one.learn(texts)
        weights, seen = one.weights, seen + one.own
    return field_of(weights)


def _open(t: Tokens, u: np.ndarray, field: Field) -> np.ndarray:
    """Tokens that the best path may tag begin or inside.

    A token is left out only if any path that tags it so can be bettered by tagging
    it outside (and a following inside begin), whatever the tags around it: the
    path over the others, with it outside, then is the best of all. So nothing is cut.
    """
    step, start_at, n = field.step, field.first + _START, len(u)
    last = np.ones(n, bool)
    last[:-1] = t.row[1:] != t.row[:-1]
    start = np.ones(n, bool)
    start[1:] = last[:-1]
    turn = np.zeros(n)  # what a following token loses as begin instead of inside
    turn[:-1] = u[1:, 1] - u[1:, 2]
    after = min(0.0, (step[1] - step[2]).min())
    out = np.zeros(n, bool)
    for x in (1, 2):
        before = min(step[p, 0] - step[p, x] for p in ((0, 1, 2) if x == 1 else (1, 2)))
        ahead = np.where(start, start_at[0] - start_at[x], before)
        plain = min(step[0, m] - step[x, m] for m in (0, 1))
        follow = np.where(last, 0.0, np.minimum(plain, step[0, 1] - step[x, 2] + after + turn))
        out |= u[:, 0] - u[:, x] + ahead + follow <= 1e-6
    return out


def _scores(unary: np.ndarray, x: np.ndarray, slots: list[int]) -> np.ndarray:
    """Sums of the weights of the features ``x`` in ``slots``, for each tag."""
    out = np.zeros((len(x), 3))
    for s in slots:
        out += np.take(unary, x[:, s], axis=0)
    return out


def decode(t: Tokens, field: Field) -> list[tuple[int, int, float]]:
    """(first token, last token, margin) of each secret, by Viterbi over all tokens of each row; by its margin, a token of it, the path is better than with the span outside."""
    if not len(t.starts):
        return []
    u = np.concatenate([_scores(field.unary, features(t, np.arange(i, min(i + BLOCK, len(t.starts)))), list(range(SLOTS))) for i in range(0, len(t.starts), BLOCK)])
    at = np.flatnonzero(_open(t, u, field))
    if not len(at):
        return []
    u = u[at]
    step = field.step + _BLOCKED
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(t.row[at]) > 0)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    size = ends - starts
    new = t.row[np.maximum(at[starts] - 1, 0)] != t.row[at[starts]]
    new |= at[starts] == 0
    # What an outside token before and after adds; runs of one token need no loop.
    enter = np.where(new[:, None], field.first + _START, step[0])
    leave = np.where((np.minimum(at[ends - 1] + 1, len(t.starts) - 1) > at[ends - 1]) & (t.row[np.minimum(at[ends - 1] + 1, len(t.starts) - 1)] == t.row[at[ends - 1]]), 1.0, 0.0)[:, None] * step[:, 0]
    out = []
    single = size == 1
    score = (u[starts] + enter + leave)[single]
    alone = np.flatnonzero(score.argmax(axis=1) == 1)
    out += [(int(i), int(i), float(m)) for i, m in zip(at[starts[single]][alone], (score[:, 1] - score[:, 0])[alone], strict=True)]
    for k in np.flatnonzero(~single).tolist():
        a, b = int(starts[k]), int(ends[k])
        best, back = u[a] + enter[k], []
        for i in range(a + 1, b):
            path = best[:, None] + step
            back.append(path.argmax(axis=0))
            best = path.max(axis=0) + u[i]
        tags = [int((best + leave[k]).argmax())]
        for prior in reversed(back):
            tags.append(int(prior[tags[-1]]))
        tags.reverse()
        first = None
        for i, g in enumerate([*tags, 0]):
            if g != 2 and first is not None:
                into = enter[k, 1] - enter[k, 0] if not first else step[tags[first - 1], 1] - step[tags[first - 1], 0]
                onto = leave[k, tags[i - 1]] - leave[k, 0] if i == len(tags) else step[tags[i - 1], g] - step[0, g]
                own = sum(u[a + n, tags[n]] - u[a + n, 0] for n in range(first, i)) + sum(step[tags[n - 1], 2] - step[0, 0] for n in range(first + 1, i))
                out.append((int(at[a + first]), int(at[a + i - 1]), float(own + into + onto) / (i - first)))
                first = None
            if g == 1:
                first = i
    return out


def find(part: pa.RecordBatch, field: Field) -> list[list[tuple[int, int, str]]]:
    """All spans (start, end, kind) of each row's text, in characters: the patterns', and those of the field that reach beyond them."""
    texts = [x or "" for x in part.column("text").to_pylist()]
    data, offsets = utf8(part.column("text"))
    t = tokens(data, offsets)
    out = [pattern_spans(x) for x in texts]
    added: dict[int, list[tuple[int, int]]] = {}
    for i, j, margin in decode(t, field):
        if margin >= field.least[int(t.digits[i : j + 1].any())]:
            added.setdefault(int(t.row[i]), []).append((int(t.starts[i]), int(t.ends[j])))
    for r, ends in added.items():
        # Characters are counted once for a text: bytes that don't continue one.
        begins = np.flatnonzero((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)
        own, reach = out[r], _reach(out[r])
        for a, b in np.searchsorted(begins, np.array(ends) - offsets[r]).tolist():
            k = bisect.bisect_right(reach, (a, len(texts[r]) + 1)) - 1
            if k < 0 or reach[k][1] < b:
                own.append((a, b, "crf"))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for x in out]


def _reach(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The widest of the patterns' spans that start at or before each start, sorted: (start, end)."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Field:
    """A field from every token of every row, and least margins from every row without a secret.

    One pass counts; by the counts, ordinary tokens, those with a digit and
    those that look like secrets are weighed. In each of the next passes every task
    learns from all its rows, beginning with the weights of the pass before, and
    the weights of all tasks are joined: each is the mean over the tasks by the
    size of their gradients, so tasks that never met a feature don't count for it. The
    driver holds the weights only, whatever the number and length of the texts;
    tasks hold a slice. Small partitions are read by one task together. Spans that the field adds to documents without a match, as
    a rule without secrets, then set the least margins: of spans with and without
    a digit, all but about one in ``ROWS_A_SPAN`` of these documents fall below.
    Which rows share a task changes the weights a little. Null texts and an empty
    table give a field that adds nothing.
    """
    rows = docs.select(F.col(text).alias("text")).where("text != ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                plains, matches, chunks = _counted(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pylist([{"plain": plains, "matches": matches, **{f"k{k}": int(n) for k, n in enumerate(chunks)}}])

    names = ("plain", "matches", "k0", "k1", "k2")
    told = rows.mapInArrow(count, ", ".join(f"{c} long" for c in names)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    if not told["matches"]:
        return nothing()
    lesson = Lesson.of(told["matches"], np.array([told["k0"], told["k1"], told["k2"]]))
    weights, seen = _blank(), _blank()
    shared = rows.coalesce(max(1, CHUNK * (told["k0"] + told["k1"] + told["k2"]) // TASK))
    for turn in range(lesson.passes):
        weights, seen = _pass(shared, weights, seen, lesson, turn)
    return calibrated(field_of(weights), rows, told["plain"] // ROWS_A_SPAN, only_plain=True)


def nothing() -> Field:
    """A field that adds no span."""
    weights = _blank()
    weights[-4:, 0] = 1
    return field_of(weights)


def _pass(rows: DataFrame, weights: np.ndarray, seen: np.ndarray, lesson: Lesson, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and squared gradients after one more pass of all tasks over their rows."""
    held = rows.sparkSession.sparkContext.broadcast((weights, seen))
    sums = [f"{c}{k}" for c in "no" for k in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(*held.value, lesson, turn)
        for batch in batches:
            for part in slices(batch):
                learner.learn(part.column("text").to_pylist())
        met = np.flatnonzero(learner.own.any(axis=1))
        own = np.round(np.ldexp(np.sqrt(learner.own[met]), POINT))
        moved = np.round(own * (learner.weights - held.value[0])[met])
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(x.astype(np.int64)) for x in (*moved.T, *own.T))], ["i", *sums])

    told = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("i", *sums))).groupBy("i").agg(*(F.sum(c).alias(c) for c in sums), F.count(F.lit(1)).alias("tasks")).toArrow()
    held.unpersist()
    at = told.column("i").to_numpy()
    moved, own = (np.stack([told.column(f"{c}{k}").to_numpy() for k in range(3)], axis=1).astype(float) for c in "no")
    weights, seen = weights.copy(), seen.copy()
    weights[at] += moved / np.maximum(own, 1)
    seen[at] += (np.ldexp(own, -POINT) / told.column("tasks").to_numpy()[:, None]) ** 2
    return weights, seen


#: Parts of one that margins are counted by.
PARTS = 256


def calibrated(field: Field, texts: DataFrame, spared: int, only_plain: bool = False) -> Field:
    """``field`` with least margins beyond which it adds at most ``spared`` spans of each class to ``texts``, or to those of them that are plain.

    Margins are counted in bins of 1/256, so the driver gets a bounded number of
    counts, however many spans there are.
    """
    held = texts.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if only_plain:
                    part = part.filter(pa.array([plain(x, pattern_spans(x)) for x in part.column("text").to_pylist()], pa.bool_()))
                t = tokens(*utf8(part.column("text")))
                own = [(bool(t.digits[i : j + 1].any()), int(np.floor(m * PARTS))) for i, j, m in decode(t, held.value)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.bool_()), pa.array([m for _, m in own], pa.int64())], ["digit", "part"])

    told = texts.mapInArrow(run, "digit boolean, part long").groupBy("digit", "part").count().collect()
    least = []
    for digit in (False, True):
        bins = sorted(((r["part"], r["count"]) for r in told if r["digit"] == digit), reverse=True)
        upto = np.cumsum([n for _, n in bins])
        k = int(np.searchsorted(upto, spared, "right"))  # the first bin that doesn't fit
        least.append(max(0.0, (bins[k][0] + 1) / PARTS) if k < len(bins) else 0.0)
    return Field(field.unary, field.step, field.first, (least[0], least[1]))


def scan(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans of the patterns) and spans (all), as ``kind:start:end`` joined by commas.

    Offsets are characters of the whole text, ends exclusive. A very long text is
    decoded whole in one task, some 30 bytes for each of its bytes. Null and empty
    texts have no spans; repeated rows are scanned each; extra columns are left
    out; an empty table gives an empty one. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = find(part, held.value)
                base = [[s for s in x if s[2] != "crf"] for x in found]
                counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(map(listed, base), pa.string()), pa.array(map(listed, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all columns and rows stay, under any names.

    Overlapping spans become one mark. Null and empty texts stay, repeated rows are
    masked each, and an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                own = pa.RecordBatch.from_arrays([part.column(text)], ["text"])
                out = []
                for t, spans in zip(part.column(text).to_pylist(), find(own, held.value), strict=True):
                    out.append(cover(t, spans, mark) if spans else t)
                at = part.schema.get_field_index(text)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def cover(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])

