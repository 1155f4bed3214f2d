"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel compares two strings by the letter triples they share in order, gaps allowed: a triple that spans s
characters weighs DECAY ** s. Inserted characters so only lengthen spans, and what isn't a letter matches
nothing. It is normalised by both self-kernels. A few landmark strings L stand for all others: a string x has the
features k(x, L) K(L, L)^(-1/2), on which a linear support vector machine is trained. Since k(x, l) is linear in the
triples of x, the trained machine folds into one table of 27 ** 3 weights, and a string is scored by looking
up its triples.

A text is a list of sentences. The strings of a sentence are its words, runs of single characters between blanks joined
to one word, and windows of two neighbouring words of at most WINDOW_PART characters, joined, neither of which is
common in harmless texts: an insult of two words, or one that a blank cuts, so is one string. Words beyond MAX_WORD characters are seen in
overlapping pieces. A text scores by its TOP worst distinct words and its worst window, through a logistic curve fitted on texts. Letters are a to z and
the EXTRA other ones that harmless texts use most; a string begins and ends with a sign of its own.

Training is on labelled sentences, which take the label of their text: as most sentences of a toxic text are
harmless, each round keeps as positive only the strings that mark toxic texts, first by document frequencies, then
the worst strings of the worst sentences by the machine itself, and takes harmless strings that come close to them as
further negatives. Positive strings are also learnt in disguise: with a letter, digit or mark put in, or marks between all letters.
Every size of the training sets is a parameter (`Sizes`), among labelled texts with the smallest hashes of doc_id. Only the
strings of the sample come to the driver, at most Sizes.strings for a text. Scoring is one scan without a shuffle.

Defined cases: null and empty texts score as harmless; repeated rows each give a row; without labelled rows of
both classes every text scores 0; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import gc
import pickle
import re
import string
import unicodedata
from collections import Counter
from dataclasses import dataclass
from heapq import nlargest
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import give_back, id_text, record_batch, table, text_blocks, written

DECAY = 0.6
MAX_WORD, WINDOW_PART, TOP = 24, 7, 3
THRESHOLD = 0.7
#: Words whose margins a Python worker remembers.
CACHE = 250_000


@dataclass(frozen=True)
class Sizes:
    """Bounds of what is learnt from. All concern labelled texts only."""

    toxic_texts: int = 1_200
    clean_texts: int = 2_500
    #: Code points of a labelled text; longer ones are not learnt from.
    chars: int = 200_000
    landmarks: int = 384
    rounds: int = 3
    #: Positive strings, and of these the ones that are learnt in disguise, too.
    positive: int = 2_000
    masked: int = 600
    #: Negative strings: the most frequent, drawn ones, and the closest ones of so many drawn each round.
    common: int = 3_000
    drawn: int = 6_000
    hard: int = 5_000
    hard_of: int = 200_000


#: How the weights of the curve are held back.
HELD = 0.3
#: What a toxic text without all but its worst word counts when the curve is fitted.
ALONE = 0.3
#: What an error of the machine costs against the length of its weights.
COST = 4.0
#: Share of harmless texts from which on a word is common.
COMMON = 0.005
#: What a disguised form of a word counts in training, against the word itself.
MASKED = 0.3

_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s|\n")
_MARKS = string.punctuation
#: A string begins and ends with a sign that counts as a letter, so that a whole word differs from a part of one.
BOUNDED = True
#: Letters that count beside a to z: the most frequent ones of the labelled harmless texts. All others lose their accents.
EXTRA = 9
_LETTERS = 28 + EXTRA
_OWN = 0xE000
_CODES = np.arange(_LETTERS**3)
#: Codes of triples with something that isn't a letter.
NONE = (_CODES < _LETTERS**2) | (_CODES // _LETTERS % _LETTERS == 0) | (_CODES % _LETTERS == 0)


def strings(text: str, common=frozenset()) -> tuple[set[str], set[str]]:
    """The distinct words of a text, and its windows of two words within a sentence."""
    low = text.lower()
    lines = [line.split() for line in low.split("\n")]
    every = set().union(*lines)
    own = {w.strip(_MARKS) for w in every}
    own.discard("")
    if sum(len(w) == 1 for w in every) > 1:
        own.update("".join(m[0].split()) for m in _SPACED.finditer(low))
    rare = {w for w in every if len(w) <= WINDOW_PART and w not in common}
    opens = {w for w in rare if w[-1] not in ".!?"}
    windows = {a + b for words in lines for a, b in zip(words, words[1:]) if a in opens and b in rare}
    if long := [w for w in own if len(w) > MAX_WORD]:
        own.difference_update(long)
        for w in long:
            own.update(w[i : i + MAX_WORD] for i in range(0, len(w) - MAX_WORD // 2, MAX_WORD // 2))
    return own, windows


def sentences(text: str, common=frozenset()) -> list[tuple[set[str], set[str]]]:
    """The strings of each sentence of a text."""
    return [strings(part, common) for part in _SENTENCE.split(text) if part and not part.isspace()]


def letters(words: list[str], extra: str = "", bounded: bool = False) -> np.ndarray:
    """Words as rows of letter numbers: a to z are 1 to 26, those of `extra` follow, other letters lose their accents, all else is 0.

    bounded: with the last number before and after each word."""
    edge = int(bounded)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max(initial=0)) + 2 * edge), np.int64)
    joined = "".join(words)
    if not joined.isascii():
        own = {ord(c): chr(_OWN + i) for i, c in enumerate(extra[:EXTRA])}
        other = {ord(c): unicodedata.normalize("NFKD", c)[:1] for c in set(joined) if c > "\x7f"}
        joined = joined.translate({_OWN + i: "?" for i in range(EXTRA)} | other | own)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where((codes >= 97) & (codes <= 122), codes - 96, np.where((codes >= _OWN) & (codes < _OWN + EXTRA), codes - _OWN + 27, 0))
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + edge] = codes
    if bounded:
        out[:, 0] = _LETTERS - 1
        out[np.arange(len(words)), sizes + 1] = _LETTERS - 1
    return out


def by_length(words: list[str], most: int = 20_000, extra: str = "", bounded: bool = False):
    """(positions, letters) of words of about one length, in parts."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        end = at + most
        longest = len(words[order[min(end, len(order)) - 1]])
        if longest > 2 * max(1, len(words[order[at]])):
            end = at + max(1, int(np.searchsorted([len(words[i]) for i in order[at:end]], 2 * max(1, len(words[order[at]])), "right")))
        part = order[at:end]
        yield part, letters([words[i] for i in part], extra, bounded)
        at = end


def triples(rows: np.ndarray):
    """(weight, codes) for each pair of distances: the triple that begins at each place. Codes outside NONE are letters only."""
    length = rows.shape[1]
    rows = rows.astype(np.int32)
    for d1 in range(1, length - 1):
        for d2 in range(1, length - d1):
            n = length - d1 - d2
            a, b, c = rows[:, :n], rows[:, d1 : d1 + n], rows[:, d1 + d2 :]
            yield DECAY ** (d1 + d2 + 1), (a * _LETTERS + b) * _LETTERS + c


def compact(words: list[str], extra: str = "", bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(column of each triple, 0 for those that no word has; the weighted triples of each word as a row of length 1)."""
    own, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for part, rows in by_length(words, extra=extra, bounded=bounded):
        for weight, code in triples(rows):
            keys = (part[:, None] * _LETTERS**3 + code).ravel()
            keys = keys[~NONE[code.ravel()]]
            own.append(keys)
            weights.append(np.full(len(keys), weight))
    used, at = np.unique(np.concatenate(own), return_inverse=True)
    codes, column = np.unique(used % _LETTERS**3, return_inverse=True)
    phi = np.zeros((len(words), len(codes) + 1), np.float32)
    phi[used // _LETTERS**3, column + 1] = np.bincount(at, np.concatenate(weights), minlength=len(used))
    place = np.zeros(_LETTERS**3, np.int32)
    place[codes] = np.arange(1, len(codes) + 1)
    return place, phi / np.maximum(np.linalg.norm(phi, axis=1, keepdims=True), 1e-9)


def embed(words: list[str], extra: str = "", bounded: bool = False) -> np.ndarray:
    """The weighted triples of each word as a dense row, of length 1."""
    place, phi = compact(words, extra, bounded)
    return phi[:, place]


def self_kernel(rows: np.ndarray) -> np.ndarray:
    """k(x, x) before normalising, by the usual recursion over prefixes, for all rows at once."""
    n, length = rows.shape
    same = (rows[:, :, None] == rows[:, None, :]) & (rows[:, :, None] > 0)
    inner = np.ones((n, length + 1, length + 1), np.float32)
    for step in range(3):
        if step == 2:
            return (same * inner[:, :-1, :-1]).sum((1, 2)) * DECAY**2
        new = np.zeros_like(inner)
        for i in range(1, length + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, length + 1):
                run = DECAY * run + DECAY**2 * same[:, i - 1, j - 1] * inner[:, i - 1, j - 1]
                new[:, i, j] = DECAY * new[:, i - 1, j] + run
        inner = new
    return np.zeros(n, np.float32)


def against(words: list[str], weights: np.ndarray, extra: str = "", bounded: bool = False, place: np.ndarray | None = None) -> np.ndarray:
    """Normalised kernels of words with the columns of `weights` (a row for each triple, or for each place of one); by looking
    triples up."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for part, rows in by_length(words, 20_000 if weights.shape[1] == 1 else 500, extra, bounded):
        if rows.shape[1] < 3:
            continue
        total = np.zeros((len(part), weights.shape[1]), np.float32)
        for weight, code in triples(rows):
            code = code if place is None else place[code]
            total += weight * (weights[:, 0][code].sum(1)[:, None] if weights.shape[1] == 1 else weights[code].sum(1))
        own = np.concatenate([self_kernel(x) for x in np.array_split(rows, len(rows) // 2_000 + 1)])
        out[part] = total / np.sqrt(np.maximum(own, 1e-9))[:, None]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost=1.0, wanted=1.0, steps: int = 40) -> np.ndarray:
    """A linear machine under squared hinge loss, classes weighed alike, by Newton steps; the last weight is the bias.

    wanted: the margin from which on a row costs nothing."""
    wanted = np.broadcast_to(wanted, len(y))
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    before = None
    for _ in range(steps):
        inside = y * (x @ w) < wanted
        if before is not None and (inside == before).all():
            break
        before = inside
        left, right = ridge.copy(), np.zeros(x.shape[1])
        for part in np.array_split(np.flatnonzero(inside), len(x) // 2_000 + 1):
            xa = x[part].astype(np.float64)
            weighed = xa * weight[part, None]
            left += weighed.T @ xa
            right += weighed.T @ (y * wanted)[part]
        w = np.linalg.solve(left, right)
    return w


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights and, last, the offset of a logistic curve; no weight is under 0. Weights are held back, that of the last feature, which
    is enough by itself, the most: where several tell the classes apart, all are used."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), HELD)
    ridge[-2:] = 10 * HELD, 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        used = (w > 0) | (slope > 0)
        used[-1] = True
        own = x[:, used]
        step = np.linalg.solve((own * (weight * p * (1 - p) + 1e-9)[:, None]).T @ own + np.diag(ridge[used]), slope[used])
        w[used] += np.clip(step, -1, 1)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def spread(phi: np.ndarray, most: int) -> np.ndarray:
    """Rows of phi that stand for all others: each next one is the least similar to those taken."""
    taken, nearest = [0], phi @ phi[0]
    while len(taken) < min(most, len(phi)):
        taken.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, phi @ phi[taken[-1]])
    return np.array(taken)


def disguised(word: str, rng) -> list[str]:
    """The word with a letter, and with a mark or digit put in, and with marks between all letters."""
    at, also = rng.integers(1, len(word), 2).tolist()
    letter, mark = chr(97 + int(rng.integers(26))), "*.-_0173"[int(rng.integers(8))]
    return [word[:at] + letter + word[at:], word[:also] + mark + word[also:], mark.join(word)]


def marking(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Strings of toxic texts alone, of each document frequency at which chance explains a fifth of them at most.

    toxic, clean: numbers of texts of either label with each string."""
    share = n_toxic / (n_toxic + n_clean)
    totals = np.bincount(toxic + clean)
    pure = (toxic > 0) & (clean * n_toxic < 0.05 * toxic * n_clean)
    seen = np.bincount(toxic[pure], minlength=2)
    often = np.array([c > 1 and n and totals[c] * share**c <= 0.2 * n for c, n in enumerate(seen)])
    found = np.flatnonzero(pure & often[np.minimum(toxic, len(often) - 1)])
    return found if len(found) else np.flatnonzero(pure)[np.argsort(-toxic[pure], kind="stable")][:5]


def evidence(margin: np.ndarray) -> np.ndarray:
    """What the curve weighs, nothing below 0: sums of the first margins, so that the worst word never counts less than the next; the worst window;
    and by how much the worst word is beyond doubt, which alone can be enough."""
    beyond = np.maximum(margin[:, :TOP:TOP] - 1, 0) ** 2
    return np.column_stack([np.cumsum(margin[:, :TOP], axis=1), margin[:, TOP:], beyond])


class Model:
    """The folded machine: a weight for each triple, a bias, the words common in harmless texts, and the curve of texts."""

    def __init__(self, table=None, bias: float = 0.0, common=frozenset(), curve=None, extra: str = ""):
        self.table = np.zeros((_LETTERS**3, 1), np.float32) if table is None else table
        self.bias, self.common, self.extra = bias, common, extra
        self.curve = np.array([0.0] * (TOP + 2) + [-40.0]) if curve is None else curve
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.table, self.bias, self.common, self.curve, self.extra)

    def forget(self) -> None:
        """Drops remembered words: a worker outlives its task."""
        self.known, self.older = {}, {}
        give_back()

    def margins(self, words: list[str]) -> np.ndarray:
        return against(words, self.table, self.extra, BOUNDED)[:, 0] + self.bias

    def text_margins(self, texts: list[tuple[set[str], set[str]]]) -> np.ndarray:
        """The margins of the TOP worst words of each text and of its worst window; what isn't there shares nothing."""
        every = set().union(*(own for both in texts for own in both))
        if len(self.known) + len(every) > CACHE:  # the older half goes
            self.known, self.older = {}, self.known
        new = every.difference(self.known)
        self.known.update((w, self.older[w]) for w in new & self.older.keys())
        new = list(new.difference(self.known))
        self.known.update(zip(new, self.margins(new).tolist()))
        get, out = self.known.__getitem__, np.full((len(texts), TOP + 1), self.bias)
        for row, (words, windows) in enumerate(texts):
            worst = nlargest(TOP, map(get, words))
            out[row, : len(worst)] = worst
            out[row, TOP] = max(map(get, windows), default=self.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = evidence(self.text_margins([strings(t, self.common) for t in texts])) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def machine(good: dict[str, int], negative: dict[str, int], hard: list[str], extra: str, rng, sizes: Sizes) -> Model:
    """Landmarks of both kinds, the machine on their features, and the table that both fold into.

    good, negative: strings and the number of texts that they mark or stand in, by whose root they count."""
    words, others, half = list(good), list(negative), sizes.landmarks // 2
    drawn = rng.permutation(others)[: half // 2].tolist()
    picked = [words[i] for i in spread(compact(words[:500], extra, BOUNDED)[1], half)]
    close = [hard[i] for i in spread(compact(hard[:500], extra, BOUNDED)[1], half - half // 2)] if hard else others[: half - half // 2]
    place, phi = compact(list(dict.fromkeys([*picked, *close, *drawn])), extra, BOUNDED)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    root = (vectors @ np.diag(np.where(values > 1e-6, values, np.inf) ** -0.5) @ vectors.T).astype(np.float32)
    shown = [w for w in words[: sizes.masked] if len(w) > 3]
    masked = [x for w in shown for x in disguised(w, rng)]
    label = np.array([1.0] * (len(words) + len(masked)) + [-1.0] * len(others))
    cost = np.concatenate((np.sqrt([*good.values()]), MASKED * np.repeat(np.sqrt([good[w] for w in shown]), 3), np.sqrt([*negative.values()])))
    features = against(words + masked + others, np.ascontiguousarray(phi.T), extra, BOUNDED, place) @ root
    # the more texts a string marks, the surer it is
    wanted = np.ones(len(label))
    wanted[: len(words)] += np.log10([*good.values()])
    w = fit_svm(features, label, COST * cost, wanted)
    return Model((phi.T @ (root @ w[:-1]))[place][:, None].astype(np.float32), float(w[-1]), extra=extra)


def fit(rows: list[tuple[str, int]], clean_weight: float = 1.0, seed: int = 7, sizes: Sizes = Sizes()) -> Model:
    """rows: (text, 0 or 1)."""
    seen = Counter(w for text, label in rows if not label for w in set(text.lower().split()))
    common = frequent(seen.items(), sum(1 - label for _, label in rows))
    return fit_strings(((sentences(text, common), label) for text, label in rows), common, clean_weight, seed, sizes)


def frequent(counts, n_clean: int) -> frozenset[str]:
    """Of (word, number of harmless texts with it) those in COMMON of the texts or more, two texts at least."""
    return frozenset(w for w, n in counts if n >= max(2, COMMON * n_clean) and len(w) <= WINDOW_PART)


def fit_strings(rows, common: frozenset[str], clean_weight: float = 1.0, seed: int = 7, sizes: Sizes = Sizes()) -> Model:
    """rows: (words and windows of each sentence, 0 or 1), read once."""
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    texts, parts, labels = [], [], []  # of each text the strings of its sentences, and (words, windows) of it all
    for text, label in rows:
        own = [[np.array([numbers.setdefault(w, len(numbers)) for w in sorted(x)], np.int32) for x in both] for both in text]
        texts.append([x for x in map(np.concatenate, own) if len(x)])
        parts.append([np.unique(np.concatenate([both[k] for both in own] or [np.zeros(0, np.int32)])) for k in (0, 1)])
        labels.append(label)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model()
    words = np.array(list(numbers), object)
    del numbers
    toxic, clean = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for own, label in zip(parts, y):
        (toxic if label else clean)[np.concatenate(own)] += 1
    n_toxic, n_clean = int(y.sum()), int((1 - y).sum())
    letters_ = np.array([len(w) for w in words])
    positive = {int(i): int(toxic[i]) for i in marking(np.where(letters_ > 2, toxic, 0), clean, n_toxic, n_clean)}  # with the number of texts that they mark
    harmless = np.flatnonzero(clean)
    often = harmless[np.argsort(-clean[harmless], kind="stable")][: sizes.common]
    negative = list(dict.fromkeys([*often.tolist(), *rng.permutation(harmless)[: sizes.drawn].tolist()]))
    kept = len(negative)
    used = Counter()
    for i in often.tolist():
        used.update(dict.fromkeys((c for c in words[i] if c > "\x7f" and c.isalpha()), int(clean[i])))
    extra = "".join(sorted(c for c, _ in sorted(used.items(), key=lambda x: (-x[1], x[0]))[:EXTRA]))
    model, hard = Model(), []
    for round_ in range(sizes.rounds):
        good = sorted(positive, key=lambda i: (-positive[i], words[i]))[: sizes.positive]
        harmful = {words[i]: max(1, positive[i]) for i in good}
        model = machine(harmful, {words[i]: max(1, int(clean[i])) for i in negative if i not in positive}, words[hard].tolist(), extra, rng, sizes)
        if round_ + 1 == sizes.rounds:
            break
        # of each toxic text the worst strings of its worst sentences
        seen = np.unique(np.concatenate([x for text, label in zip(texts, y) if label for x in text] or [[]])).astype(np.int64)
        margin = np.full(len(words), -np.inf)
        margin[seen] = model.margins(words[seen].tolist())
        worst = Counter()
        for text, label in zip(texts, y):
            if label:
                for own in sorted((x for x in text if len(x)), key=lambda x: -margin[x].max())[:TOP]:
                    own = own[np.argsort(-margin[own], kind="stable")][:TOP]
                    worst.update({int(i) for i in own if margin[i] > 0 and clean[i] * n_toxic <= 0.05 * toxic[i] * n_clean})
        # one that marks one text alone is taken only where nothing else marks that text, which chance makes rare
        positive = {i: n for i, n in worst.items() if toxic[i] > 1 or margin[i] > 0.5} or positive
        near = rng.permutation(harmless)[: sizes.hard_of]
        margins = model.margins(words[near].tolist())
        order = np.argsort(-margins, kind="stable")[: sizes.hard]
        hard = [int(i) for i, m in zip(near[order], margins[order]) if m > -0.7 and int(i) not in positive]
        negative = list(dict.fromkeys(negative[:kept] + hard))
    model.common = common
    each = np.concatenate([model.margins(words[i : i + 50_000].tolist()) for i in range(0, len(words), 50_000)])
    margin = np.full((len(y), TOP + 1), model.bias)
    for row, (own, windows) in enumerate(parts):
        worst = -np.sort(-each[own])[:TOP]
        margin[row, : len(worst)] = worst
        margin[row, TOP] = each[windows].max(initial=-np.inf) if len(windows) else model.bias
    weight = np.where(y == 1, margin[:, 0] > 0, clean_weight).astype(np.float64)
    # one whose worst word is beyond those of harmless texts would be toxic with that word alone
    sure = (y == 1) & (margin[:, 0] > np.quantile(margin[y == 0, 0], 0.999))
    alone = np.full_like(margin[sure], model.bias)
    alone[:, 0] = margin[sure, 0]
    seen = np.concatenate((margin, alone))
    model.curve = curve = fit_curve(evidence(seen), np.concatenate((y, np.ones(len(alone)))), np.concatenate((weight, ALONE * weight[sure])))
    return model if curve[:-1].max() > 0 else Model()


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _strings(common):
    """(doc_id, text, toxic) -> words and windows of its sentences, and the label."""

    def run(batches):
        for part, texts in text_blocks(batches, 4 << 20):
            found = [[{"words": sorted(w), "windows": sorted(p)} for w, p in sentences(text, common.value)] for text in texts]
            yield record_batch({
                "doc_id": part.column(0), "toxic": part.column(2),
                "sentences": pa.array(found, pa.list_(pa.struct([("words", pa.list_(pa.string())), ("windows", pa.list_(pa.string()))]))),
            })

    return run


def _fit(common, clean_weight: float, sizes: Sizes):
    """Rows of one task, in order -> the model of all of them, as bytes."""

    def run(batches):
        def read():
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield [(x["words"], x["windows"]) for x in row["sentences"]], row["toxic"]

        model = fit_strings(read(), common.value, clean_weight, sizes=sizes)
        yield record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})
        del model
        gc.collect()
        give_back()

    return run


def train(docs: DataFrame, labels: DataFrame, sizes: Sizes = Sizes()) -> Model:
    """A model from a bounded sample of labelled texts whose crc32(doc_id) mod 3 is not 1."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = known.where("toxic = 1").orderBy(*order).limit(sizes.toxic_texts).unionAll(known.where("toxic = 0").orderBy(*order).limit(sizes.clean_texts))
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spark = docs.sparkSession
    short = id_text(docs).where(F.length("text") <= sizes.chars)
    texts = written(short.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "sample")  # at most toxic_texts + clean_texts ids
    clean = texts.where("toxic = 0")
    seen = clean.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).groupBy("w").count().where(F.length("w") <= WINDOW_PART)
    n_clean = clean.count()
    common = frequent(seen.where(F.col("count") >= max(2, COMMON * n_clean)).collect(), n_clean)
    shared = spark.sparkContext.broadcast(common)
    rows = texts.mapInArrow(_strings(shared), "doc_id long, toxic int, sentences array<struct<words:array<string>,windows:array<string>>>")
    rows = written(rows, "strings")
    taken = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    share = lambda k: taken.get(k, 0) / max(1, counts.get(k, 0))
    weight = min(10.0, share(1) / max(share(0), 1e-9))
    # one task learns from the sample, which the bounds of `sizes` hold small; the driver gets the model alone
    one = rows.orderBy("doc_id", "toxic", F.xxhash64("sentences")).coalesce(1).select("toxic", "sentences")
    found = one.mapInArrow(_fit(shared, weight, sizes), "model binary").collect()
    shared.destroy()
    return pickle.loads(found[0].model) if found else Model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model: Model = shared.value
        try:
            for part, texts in text_blocks(batches, 6 << 20):
                yield record_batch({"doc_id": part.column(0), "score": pa.array(model.scores(texts), pa.float64())})
        finally:
            model.forget()

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        model: Model = shared.value
        try:
            for texts in parts:
                own = [t or "" for t in texts]
                # a batch may be long; scores are found some hundred texts at a time
                yield pd.Series([x for i in range(0, len(own), 1_000) for x in model.scores(own[i : i + 1_000])], dtype="float64")
        finally:
            model.forget()

    return docs.where(scored("text") < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
