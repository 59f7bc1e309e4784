"""Personal information in free text: found by a linear-chain conditional random field, replaced by typed placeholders.

Everything is done for a batch of texts at once: characters are cut into tokens by class masks, tokens become numbers, the
scores of a token's labels are sums of rows of small tables (its own and its neighbours' word, shape, ending), and Viterbi
steps through the n-th token of all sequences together. A text is cut into sequences at tokens that no value can hold, such as
the end of a paragraph, so that long texts take few steps. The model is fitted on the driver from the labelled table of
`pii_table`, whose size is a parameter, and goes to the tasks as a few arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm.pii_table import CUE_NAMES, CUES, HAN_CUES, HAN_DOUBLE, HAN_FAMILY, KINDS, PARTICLES, labelled

#: Passages of the labelled table, its seed, rounds of fitting, step.
TABLE, SEED, ROUNDS, STEP = 8000, 11, 16, 0.05
#: Weight of the quadratic penalty, which keeps rare words from deciding alone.
PENALTY = 2.0
#: How far values are preferred to none in a close case; the exact checks then refuse what can't be one.
LEAN = 0.3
#: Shares in which the table goes by.
SHARES = 8
#: The share of words shown to the fit by their form only.
HIDDEN = 0.6
LABELS = ["O"] + [p + k for k in KINDS for p in ("B", "I")]
REACH = 4
#: Characters tagged at once.
BLOCK = 3_000_000

LETTER, HAN, DIGIT, LINE, SPACE, NONE, SIGN = range(1, 8)


#: Signs that no value holds; they end a sequence.
_STOPS = np.array([ord(c) for c in "。！？!?=≤≥∑∈→|\\^~*;；“”\"⟦⟧"], np.uint32)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, SIGN, np.uint8)
    out[0x20000:0x32000] = HAN
    for o in range(0x10000):
        c = chr(o)
        cat = unicodedata.category(c)
        if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
            out[o] = HAN
        elif cat[0] in "LM":
            out[o] = LETTER
        elif cat == "Nd":
            out[o] = DIGIT
        elif c in "\n\r\v\f\x85":
            out[o] = LINE
        elif cat in ("Zs", "Zl", "Zp") or c == "\t":
            out[o] = SPACE
        elif cat in ("Cf", "Cc"):
            out[o] = NONE
    return out


_HAN_FAMILY = frozenset(HAN_FAMILY)
_CUES = {w: k for k, ws in CUES.items() for w in ws.split()}
_PAIRS = sorted((ord(w[0]) << 32 | ord(w[1]), CUE_NAMES.index(k)) for k, ws in HAN_CUES.items() for w in ws.split())
_PAIR, _PAIR_CUE = np.array([p for p, _ in _PAIRS], np.uint64), np.array([c for _, c in _PAIRS], np.uint64)


_START = np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)


class Tokens:
    """Tokens of a batch of texts: start and end in their text, text number, key. Spaces are none, but leave a mark on the
    token behind them; characters without width vanish, within tokens too; one line break or several are one token."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        where = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        of = np.repeat(np.arange(len(texts)), size)
        kind = _classes()[codes]
        seen = kind != NONE
        codes, where, of, kind = codes[seen], where[seen], of[seen], kind[seen]
        n = len(codes)
        same = np.zeros(n, bool)
        if n:
            same[1:] = (kind[1:] == kind[:-1]) & (of[1:] == of[:-1]) & ((kind[1:] == LETTER) | (kind[1:] == DIGIT) | (kind[1:] == LINE) | (kind[1:] == SPACE))
        first = np.flatnonzero(~same)
        length = np.diff(np.append(first, n))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()) if n else 1, 0x9E3779B97F4A7C15, np.uint64))
            inner = np.arange(n) - np.repeat(first, length)
            mixed = (codes.astype(np.uint64) + np.uint64(7)) * power[inner]
            key = np.add.reduceat(mixed, first) if n else np.array([], np.uint64)
        kept = kind[first] != SPACE
        gap = np.zeros(len(first), bool)
        if len(first) > 1:
            gap[1:] = (kind[first[:-1]] == SPACE) & (of[first[1:]] == of[first[:-1]])
        # a line break, with its carriage return, is one token, and an empty line another, whatever follows
        broken = kind[first] == LINE
        feeds = np.add.reduceat((codes == 10).astype(np.int64), first) if n else first
        paragraph = broken & (feeds > 1)
        key = np.where(broken, np.where(paragraph, np.uint64(2), np.uint64(1)), key)
        single = codes[first] if n else codes
        stop = paragraph | np.isin(single, _STOPS)
        self.first, self.length, self.gap = first[kept], length[kept], gap[kept]
        self.kind, self.of = kind[first][kept], of[first][kept]
        self.start, self.end = where[self.first], where[self.first + self.length - 1] + 1
        self.key, self.codes = key[kept], codes
        # the cue that a Chinese character completes with the one before it
        lead = codes[self.first].astype(np.uint64)
        pair = np.zeros(len(lead), np.uint64)
        if len(lead) > 1:
            pair[1:] = np.where((self.kind[1:] == HAN) & (self.kind[:-1] == HAN) & (self.of[1:] == self.of[:-1]), lead[:-1] << np.uint64(32) | lead[1:], 0)
        near = np.minimum(np.searchsorted(_PAIR, pair), len(_PAIR) - 1)
        self.cue = np.where(_PAIR[near] == pair, _PAIR_CUE[near], 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            self.type = (self.key * np.uint64(2) + self.gap.astype(np.uint64)) * np.uint64(16) + self.cue
        # the sequence of each token: a new one behind a token that ends one, and in each text
        self.stop = stop[kept]
        new = np.zeros(len(self.key), np.int64)
        if len(new) > 1:
            new[1:] = (self.of[1:] != self.of[:-1]) | self.stop[:-1]
        self.seq = np.cumsum(new)

    def word(self, i: int) -> str:
        a = self.first[i]
        return self.codes[a : a + self.length[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


SHAPES = ["none", "line", "Xx", "XX", "X", "x", "x1", "han", "d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8", "d9", "d10", "d11", "d12", "d15-", "d17", "d18", "d19+", ".", ",", "-", "@", "(", ")", "+", "/", ":", "sign", "other"]
_SHAPE = {s: i for i, s in enumerate(SHAPES)}


# Coarse shapes, of which four neighbours make one feature.
_KINDS = {"none": 0, "line": 1, "Xx": 2, "XX": 3, "X": 4, "x": 5, "x1": 5, "han": 6, ".": 8, ",": 9, "-": 10}
_COARSE = np.array([_KINDS.get(s, 7 if s[0] == "d" and s[1:2].isdigit() else 11) for s in SHAPES], np.int64)
FOUR = 12**4


def neighbours(shape: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each token the numbers of four features: its shape with the one before and with the one behind, and its coarse shape
    with those of four neighbours around it, beginning two or one before it. Beyond its text a shape is 0."""
    n = len(shape)

    def at(d: int, values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        a, b = max(0, -d), n - max(0, d)
        if a < b:
            out[a:b] = np.where(of[a:b] == of[a + d : b + d], values[a + d : b + d], 0)
        return out

    coarse, pair = _COARSE[shape], len(SHAPES) ** 2
    back, ahead = at(-1, shape), at(1, shape)
    four = [((at(d, coarse) * 12 + at(d + 1, coarse)) * 12 + at(d + 2, coarse)) * 12 + at(d + 3, coarse) for d in (-2, -1)]
    return np.stack([back * len(SHAPES) + shape, pair + shape * len(SHAPES) + ahead, 2 * pair + four[0], 2 * pair + FOUR + four[1]])


def shape_of(word: str, kind: int) -> int:
    if kind == LINE:
        return _SHAPE["line"]
    if kind == HAN:
        return _SHAPE["han"]
    if kind == DIGIT:
        n = len(word)
        return _SHAPE[f"d{n}" if n < 13 or n in (17, 18) else "d15-" if n < 17 else "d19+"]
    if kind == LETTER:
        if word.isupper():
            return _SHAPE["X" if len(word) == 1 else "XX"]
        return _SHAPE["Xx" if word[:1].isupper() else "x1" if len(word) == 1 else "x"]
    return _SHAPE.get(word, _SHAPE["sign"])


def word_features(word: str, kind: int, gap: bool, cue: int = 0) -> list[str]:
    low = ("\n\n" if word.count("\n") > 1 else "\n") if kind == LINE else word.lower()
    s = SHAPES[shape_of(word, kind)]
    out = [f"s={s}", f"g={s}{int(gap)}"]
    if kind != DIGIT:
        out.append(f"w={low}")
    else:
        out.append(f"d={word[0]}{min(len(word), 19)}")
        if len(word) == 4 and word[:2] in ("19", "20"):
            out.append("year")
        if len(word) in (17, 18) and word[6:8] in ("19", "20") and word[10:12] <= "12" and word[12:14] <= "31":
            out.append("dated")
    if cue or low in _CUES:
        out.append(f"c={CUE_NAMES[cue] if cue else _CUES[low]}")
    if kind == LETTER and len(word) > 3:
        out += [f"e={low[-3:]}", f"f={low[-2:]}", f"b={low[:2]}", f"n={min(len(word), 9)}"]
        if not word.isascii():
            out.append("marked")
    elif kind == HAN:
        out.append("family" if word in _HAN_FAMILY else "ideograph")
    return out


class Model:
    """Feature weights by distance, weights of neighbouring shapes, and transitions."""

    def __init__(self, features: dict[str, int], rng: int = 0):
        n, k = len(features), len(LABELS)
        self.features = features
        self.w = np.zeros((2 * REACH + 1, n, k), np.float32)
        self.pair = np.zeros((2 * len(SHAPES) ** 2 + 2 * FOUR, k), np.float32)
        self.move = np.zeros((k, k), np.float32)
        for a, x in enumerate(LABELS):
            for b, y in enumerate(LABELS):
                if y[0] == "I" and x[1:] != y[1:]:
                    self.move[a, b] = -1e4
        self.lean = 0.0
        self.memo: dict[tuple[int, bool], tuple[np.ndarray, int]] = {}

    def rows(self, tok: Tokens) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
        """The number of each token's type, the features of each type, and the shape of each token."""
        _, some, inverse = np.unique(tok.type, return_index=True, return_inverse=True)
        feats, shapes = [], np.zeros(len(some), np.int64)
        for u, i in enumerate(some):
            word, kind = tok.word(i), int(tok.kind[i])
            feats.append([self.features[f] for f in word_features(word, kind, bool(tok.gap[i]), int(tok.cue[i])) if f in self.features])
            shapes[u] = shape_of(word, kind)
        return inverse, feats, shapes[inverse]

    def scores(self, tok: Tokens) -> np.ndarray:
        """The label scores of every token."""
        n, k = len(tok.key), len(LABELS)
        out = np.zeros((n, k), np.float32)
        if not n:
            return out
        kinds, some, inverse = np.unique(tok.type, return_index=True, return_inverse=True)
        table, shapes = np.zeros((2 * REACH + 1, len(some), k), np.float32), np.zeros(len(some), np.int64)
        for u, i in enumerate(some):
            known = self.memo.get(int(kinds[u]))
            if known is None:
                word, kind = tok.word(i), int(tok.kind[i])
                ids = [self.features[f] for f in word_features(word, kind, bool(tok.gap[i]), int(tok.cue[i])) if f in self.features]
                known = self.w[:, ids].sum(axis=1), shape_of(word, kind)
                if len(self.memo) < 300_000:
                    self.memo[int(kinds[u])] = known
            table[:, u], shapes[u] = known
        shape = shapes[inverse]
        for d in range(-REACH, REACH + 1):
            a, b = max(0, -d), n - max(0, d)
            if a < b:
                here = tok.of[a:b] == tok.of[a + d : b + d]
                out[a:b] += table[d + REACH][inverse[a + d : b + d]] * here[:, None]
        for near in neighbours(shape, tok.of):
            out += self.pair[near]
        out[:, 0] -= self.lean
        out[tok.stop, 1:] = -1e4
        return out


def _steps(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sequence's tokens begin and how many there are, longest first."""
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    count = np.diff(np.append(begin, len(of)))
    order = np.argsort(-count, kind="stable")
    return begin[order], count[order]


def viterbi(scores: np.ndarray, of: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of all sequences; one step handles the n-th token of every sequence that has one."""
    n, k = scores.shape
    labels = np.zeros(n, np.int8)
    if not n:
        return labels
    begin, count = _steps(of)
    back = np.zeros((n, k), np.int8)
    state = scores[begin] + _START
    finals = np.zeros((len(begin), k), np.float32)
    for t in range(1, int(count[0]) + 1):
        live = np.searchsorted(-count, -t, side="left")  # texts with more than t tokens
        finals[live : len(state)] = state[live:]
        if not live:
            break
        both = state[:live, :, None] + move
        at = begin[:live] + t
        from_ = both.argmax(axis=1)
        back[at] = from_
        state = np.take_along_axis(both, from_[:, None, :], axis=1)[:, 0] + scores[at]
    last = begin + count - 1
    now = finals.argmax(axis=1)
    labels[last] = now
    for t in range(int(count[0]) - 1, 0, -1):
        live = np.searchsorted(-count, -t, side="left")
        at = begin[:live] + t
        now[:live] = back[at, now[:live]]
        labels[at - 1] = now[:live]
    return labels


def _targets(tok: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    y = np.zeros(len(tok.key), np.int64)
    for i, own in enumerate(spans):
        at = np.flatnonzero(tok.of == i) if own else []
        for a, b, kind in own:
            inside = at[(tok.start[at] >= a) & (tok.end[at] <= b)]
            y[inside] = LABELS.index("I" + kind)
            y[inside[:1]] = LABELS.index("B" + kind)
    return y


class _Sums:
    """Sums of rows by their number."""

    def __init__(self, of: np.ndarray, size: int):
        self.order, self.size = np.argsort(of, kind="stable"), size
        self.some, self.begin = np.unique(of[self.order], return_index=True)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, rows.shape[1]), np.float32)
        out[self.some] = np.add.reduceat(rows[self.order], self.begin, axis=0)
        return out


class _Part:
    """A share of the labelled table, with what one step of the fit over it needs."""

    def __init__(self, model: Model, tok: Tokens, y: np.ndarray, hidden: np.ndarray):
        k, n = len(LABELS), len(y)
        self.tok, self.y, self.n = tok, y, n
        inverse, feats, shape = model.rows(tok)
        # a share of the words is known by its form only, so that the model also learns from what it can't know by heart
        spelled = {i for f, i in model.features.items() if f[:2] in ("w=", "e=", "f=", "b=")}
        self.inverse = inverse + hidden * len(feats)
        feats = feats + [[f for f in fs if f not in spelled] for fs in feats]
        flat = np.array([f for fs in feats for f in fs])
        self.some, local = np.unique(flat, return_inverse=True)
        self.local, self.owner = local, np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        self.each = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
        self.by_feature, self.by_type = _Sums(local, len(self.some)), _Sums(self.inverse, len(feats))
        self.chained = tok.seq[1:] == tok.seq[:-1]
        self.shapes = neighbours(shape, tok.of)
        self.by_shape = _Sums(self.shapes.ravel(), len(model.pair))
        self.onehot = np.zeros((n, k), np.float32)
        self.onehot[np.arange(n), y] = 1
        self.seen = np.zeros((k, k))
        np.add.at(self.seen, (y[:-1][self.chained], y[1:][self.chained]), 1)
        self.begin, count = _steps(tok.seq)
        self.waves = [self.begin[: np.searchsorted(-count, -t, side="left")] + t for t in range(1, int(count[0]))]

    def windows(self):
        """(distance, tokens, their neighbours, whether both are in one text)"""
        for d in range(-REACH, REACH + 1):
            a, b = max(0, -d), self.n - max(0, d)
            yield d, slice(a, b), slice(a + d, b + d), (self.tok.of[a:b] == self.tok.of[a + d : b + d])[:, None]

    def gradient(self, model: Model) -> list[np.ndarray]:
        """Of the log likelihood by the rows of `w` in use, by `pair` and by `move`: what is seen less what is expected."""
        n, k = self.n, len(LABELS)
        tables = np.add.reduceat(model.w[:, self.some][:, self.local], self.each, axis=1)
        s = model.pair[self.shapes].sum(axis=0)
        for d, here, there, inside in self.windows():
            s[here] += tables[d + REACH][self.inverse[there]] * inside
        s[self.tok.stop, 1:] = -1e4
        e, m = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -30.0)), np.exp(model.move)
        alpha, beta, norm = np.zeros((n, k), np.float32), np.ones((n, k), np.float32), np.ones((n, 1), np.float32)
        a = e[self.begin] * np.exp(_START)
        norm[self.begin] = a.sum(axis=1, keepdims=True) + 1e-30
        alpha[self.begin] = a / norm[self.begin]
        for at in self.waves:
            a = (alpha[at - 1] @ m) * e[at]
            norm[at] = a.sum(axis=1, keepdims=True) + 1e-30
            alpha[at] = a / norm[at]
        for at in self.waves[::-1]:
            beta[at - 1] = ((beta[at] * e[at]) @ m.T) / norm[at]
        error = self.onehot - alpha * beta
        both = self.chained
        g_move = self.seen - m * (alpha[:-1][both].T @ (e * beta / norm)[1:][both])
        g_w = np.zeros((2 * REACH + 1, len(self.some), k), np.float32)
        for d, here, there, inside in self.windows():
            moved = np.zeros_like(error)
            moved[there] = error[here] * inside
            g_w[d + REACH] = self.by_feature(self.by_type(moved)[self.owner])
        return [g_w, self.by_shape(np.tile(error, (4, 1))), g_move]


@lru_cache(maxsize=2)
def fit(size: int = TABLE, seed: int = SEED, rounds: int = ROUNDS, step: float = STEP, keep: tuple[int, ...] = (0,), parts: int = 1, penalty: float = PENALTY) -> Model:
    """Weights that maximize the conditional likelihood of the labelled table, with a quadratic penalty; the table goes by in
    SHARES a round. `keep` and `parts` choose the lines and names of the table, to hold some out."""
    rows, r = labelled(size, seed, keep, parts), np.random.default_rng(seed)
    names: dict[str, int] = {}
    shares = []
    for i in range(SHARES):
        own = rows[i::SHARES]
        tok = Tokens([t for t, _ in own])
        shares.append((tok, _targets(tok, [s for _, s in own])))
        for i in np.unique(tok.type, return_index=True)[1]:
            for f in word_features(tok.word(i), int(tok.kind[i]), bool(tok.gap[i]), int(tok.cue[i])):
                names.setdefault(f, len(names))
    model = Model(names)
    hide = lambda tok: r.random(len(tok.key)) < np.where(tok.kind == LETTER, HIDDEN, HIDDEN / 2) * ((tok.kind == LETTER) | (tok.kind == HAN))
    own = [_Part(model, tok, y, hide(tok)) for tok, y in shares]
    fixed = model.move < -1e3
    params = [model.w, model.pair, model.move]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = rounds * SHARES
    for it in range(1, steps + 1):
        part = own[(it - 1) % SHARES]
        rate = step * (1 - 0.9 * it / steps)
        for j, g in enumerate(part.gradient(model)):
            at = (slice(None), part.some) if j == 0 else ...  # of the word weights only those in use
            p = params[j][at]
            g = (g - penalty / SHARES * np.where(np.abs(p) < 1e3, p, 0)).astype(np.float32)
            a, b = 0.9 * m1[j][at] + 0.1 * g, 0.99 * m2[j][at] + 0.01 * g * g
            m1[j][at], m2[j][at] = a, b
            params[j][at] = p + rate / (1 - 0.9**it) * a / (np.sqrt(b / (1 - 0.99**it)) + 1e-2)
        model.move[fixed] = -1e4
    model.lean = LEAN
    return model


_NO_WIDTH = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff"
_PARTICLES = {w for p in PARTICLES for w in p.split()} | {"al", "la", "y", "e", "da", "dos", "zu", "der"}
_GLUE = set(CUES["glue"].split()) - {"may", "will", "an", "le", "la", "so", "see", "do", "in", "on", "des"}
_TITLE = re.compile(r"(?:(?:" + "|".join(CUES["title"].split()) + r")\b\.?\s+)+", re.I)
# How mail addresses write their sign and their dots, and what names a road in Chinese.
_PART = "[\\w.+\\-\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+"
_DOT = r"(?:\s*(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s*)"
_SIGN = r"(?:@|＠|\(at\)|\[at\]|\{at\}|【at】|\[@\]|\(@\)|\(a\)|&#64;|\bat\b)"
_MAIL = re.compile(rf"{_PART}(?:{_DOT}{_PART})*\s*{_SIGN}\s*(?:{_PART}{_DOT}{_PART}|[\w\-]+\.[\w\-])", re.I)
_ROAD = re.compile(r"(路|街|道|巷|胡同|弄|里|村|园|号)\s*\d|\d\s*(号|弄|栋|室)")
_DATE = re.compile(r"(19|20)\d\d[-./]\d\d?[-./]\d\d?(?!\d)")
_STREET = re.compile(r"\d.*[^\W\d_]{2}|[^\W\d_]{2}.*\d", re.S)


def _sound(kind: str, span: str) -> bool:
    """The exact check that follows: what no value of its kind can be."""
    digits = sum(c.isdigit() for c in span)
    if kind == "email":
        return bool(_MAIL.search(span))
    if kind == "phone":
        return 7 <= digits <= 18 and not _DATE.match(span)
    if kind == "id_number":
        return 6 <= digits <= 18
    if kind == "address":
        return digits > 0 and len(span) > 5 and bool((_ROAD if re.search("[㐀-鿿]", span) else _STREET).search(span))
    return not digits and _is_name(span)


def _is_name(span: str) -> bool:
    """A Chinese name of a family name and one or two characters, none of them a function word; or at least two parts, of which one is a word with a
    capital, and each a word with a capital, an initial with a point, or a particle."""
    if re.search("[㐀-鿿]", span):
        own = re.sub(r"[\W_]", "", span)
        return bool(re.fullmatch("[㐀-鿿]{2,5}", own)) and not set(own) & set("的了是在和与及或被把让向从不也都")
    parts = [p for p in re.split(r"[\s,]+", re.sub(f"[{_NO_WIDTH}]", "", span)) if p]
    words = [p for p in parts if re.fullmatch(r"[^\W\d_]+(?:['’\-.][^\W\d_]+)*", p) and p[0].isupper() and len(p) > 1]
    initials = [p for p in parts if re.fullmatch(r"(?:[^\W\d_a-z]\.-?)+", p)]
    rest = [p for p in parts if p not in words and p not in initials]
    plain = any(p.lower() in _GLUE or p.lower().rstrip(".") in _CUES and len(parts) < 3 and _CUES[p.lower().rstrip(".")] == "title" for p in words)
    return bool(words) and len(words) + len(initials) >= 2 and len(parts) < 7 and all(p.lower() in _PARTICLES or p.islower() and len(p) < 4 for p in rest) and not plain and not re.search(r"-[^\W\d_]$", span)


def tag(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each value in each text, in code points."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    tok = Tokens(texts)
    labels = viterbi(model.scores(tok), tok.seq, model.move)
    begins = np.array([x[0] == "B" for x in LABELS])[labels]
    inner = np.array([x[0] == "I" for x in LABELS])[labels]
    at = np.flatnonzero(begins)
    stop = np.append(np.flatnonzero(~inner), len(labels))
    ends = stop[np.searchsorted(stop, at, side="right")] - 1 if len(at) else at
    for i, j in zip(at.tolist(), ends.tolist()):
        t = int(tok.of[i])
        a, b = int(tok.start[i]), int(tok.end[j])
        kind = LABELS[labels[i]][1:]
        if kind == "phone":  # a number starts at its plus sign or bracket, and goes on to its last digit
            while b > a and not texts[t][b - 1].isdigit():
                b -= 1
            while a and (texts[t][a - 1].isdigit() or a > 1 and texts[t][a - 1] in ".-/" and texts[t][a - 2].isdigit()):
                a -= 1
            while a and texts[t][a - 1] in "+(（＋":
                a -= 1
        if kind == "email" and (m := _MAIL.search(texts[t], a, b)):
            a = m.start()
            letter = lambda c: c.isalnum() and c < "\u2e80"
            while a and (letter(texts[t][a - 1]) or a > 1 and texts[t][a - 1] in "._+-" and letter(texts[t][a - 2])):
                a -= 1
        if kind == "name":  # a title isn't part of it, the first half of a double name is
            text = texts[t]
            a += re.match(r"[\s.,:;)]*", text[a:b]).end()
            if m := _TITLE.match(text, a, b):
                a = m.end()
            if a > 1 and text[a - 1] in "-’'" and text[a - 2].isalpha():
                a -= 1
                while a and text[a - 1].isalpha():
                    a -= 1
        elif kind in ("address", "id_number"):
            a += re.match(r"[\s.,:;)：，]*", texts[t][a:b]).end()
        if _sound(kind, texts[t][a:b]):
            out[t].append((a, b, kind))
    return out


def tag_all(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """`tag`, with few long texts at once."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            out += tag(texts[at : i + 1], model)
            at, size = i + 1, 0
    return out


def _shared(df: DataFrame, size: int, seed: int):
    return df.sparkSession.sparkContext.broadcast(fit(size, seed))  # a few MB: bounded by the labelled table


def found_values(documents: DataFrame, size: int = TABLE, seed: int = SEED) -> DataFrame:
    """(doc_id, kind, start_pos): one row for each value; start_pos in code points from 0. Null and empty texts have none;
    rows repeated under one id give their values once. Texts are tagged whole, of any length."""
    model = _shared(documents, size, seed)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, k, a) for d, spans in zip(p["doc_id"], tag_all(p["text"].tolist(), model.value)) for a, _, k in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos"]).astype({"start_pos": "int32"})

    return documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0").mapInPandas(run, f"doc_id {kind}, kind string, start_pos int").distinct()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, size: int = TABLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, n_values): texts with typed placeholders such as [EMAIL] for values; everything else is kept. A null
    text stays null with no values."""
    model = _shared(documents, size, seed)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = [t if isinstance(t, str) else "" for t in p["text"]]
            spans = tag_all(texts, model.value)
            yield pd.DataFrame({"doc_id": p["doc_id"], "text": [redact(t, s) if isinstance(o, str) else None for o, t, s in zip(p["text"], texts, spans)], "n_values": np.array([len(s) for s in spans], np.int32)})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string, n_values int")
