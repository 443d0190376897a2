"""A two-state linear-chain CRF over words, and what it is trained from.

States: clean and toxic.  A word's evidence for toxic is a sum of weights of its
features (itself, its first 3 to 6 characters, its last 3, its shape, and the
words beside it); two transition weights tie neighbours.  With two states,
forward and backward messages are one number each, the log odds of toxic, so
many chains advance together in numpy.  Chains are pieces of 64 words of a text.
"""

from __future__ import annotations

import string
from array import array
from collections import Counter

import numpy as np

CHAIN = 64
PREFIXES = (3, 4, 5, 6)
_STEPS, _RATE, _DECAY = 50, 0.25, 2e-4
_MOST = 30.0  # of a weight's size where odds are taken
_RARE = 3  # a feature must occur in so many words' uses
MEMO_WORDS = 150_000


def normal(word: str) -> str:
    return word.strip(string.punctuation).lower()


def features(word: str) -> list[str]:
    """Of one raw word; names start with their kind."""
    w = normal(word)
    kinds = ["w" + w, *("p" + w[:k] for k in PREFIXES if len(w) >= k), "s" + w[-3:]]
    if not w.isalpha() and any(map(str.isdigit, w)):
        kinds.append("#")
    if word.isupper() and len(w) > 1:
        kinds.append("A")
    return kinds


def chains(evidence: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, one after another, as a table with a column per chain; (table, place, chain)."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    at = np.arange(len(evidence)) - np.repeat(starts, sizes)
    per_text = -(-sizes // CHAIN)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(np.int64)
    chain = np.repeat(first, sizes) + at // CHAIN
    place = at % CHAIN
    table = np.zeros((CHAIN, int(per_text.sum())))
    table[place, chain] = evidence
    return table, place, chain


def marginals(table: np.ndarray, lengths: np.ndarray, stay: float, enter: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of toxic at each place, and expected numbers of toxic-toxic and clean-toxic steps.

    Transition weights: ``stay`` (toxic to toxic), ``enter`` (clean to toxic), 0
    otherwise.  Messages are odds, so a step is a few products and one quotient.
    """
    odds = np.exp(np.clip(table, -_MOST, _MOST))
    s, e = np.exp(np.clip([stay, enter], -_MOST, _MOST))
    ahead, behind = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = odds[0]
    for t in range(1, len(odds)):
        ahead[t] = odds[t] * (ahead[t - 1] * s + e) / (ahead[t - 1] + 1.0)
    for t in range(len(odds) - 2, -1, -1):
        follow = odds[t + 1] * behind[t + 1]
        behind[t] = np.where(t + 1 < lengths, (follow * s + 1.0) / (follow * e + 1.0), 1.0)
    inside = np.arange(1, len(odds))[:, None] < lengths[None, :]
    follow, before = odds[1:] * behind[1:], ahead[:-1]
    both, entered = before * follow * s, follow * e
    total = both + entered + before + 1.0
    return np.log(ahead * behind), (both / total)[inside].sum(), (entered / total)[inside].sum()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def toxic_keys(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words and word starts that occur in toxic texts more often than chance allows.

    Counts are of texts.  The test is a likelihood ratio against the share of
    toxic texts, beyond the logarithm of the number of keys tried.  Toxic texts
    that hold none of the keys found are tested again by themselves, so that
    words of rarer kinds show; this ends when no text gets its first key.
    """
    def keys_of(words: list[str]) -> set[str]:
        return {k for w in set(map(normal, words)) if len(w) > 2 for k in ["w" + w, *("p" + w[:n] for n in PREFIXES[1:] if len(w) >= n)]}

    clean: Counter = Counter()
    for words, y in zip(texts, toxic, strict=True):
        if not y:
            clean.update(keys_of(words))
    open_texts = [words for words, y in zip(texts, toxic, strict=True) if y]
    found: set[str] = set()
    while open_texts:
        found |= _beyond_chance(Counter(k for words in open_texts for k in keys_of(words)), clean, len(open_texts), len(texts) - int(toxic.sum()))
        rest = [words for words in open_texts if not keys_of(words) & found]
        if len(rest) == len(open_texts):
            break
        open_texts = rest
    return found


def _beyond_chance(t: Counter, c: Counter, n_toxic: int, n_clean: int) -> set[str]:
    share = n_toxic / (n_toxic + n_clean)
    limit = np.log(len(t) + len(c) + 1) + 1.0
    found = set()
    for key, a in t.items():
        n = a + c[key]
        rate = a / n
        if rate <= max(0.6, share):
            continue
        ratio = a * np.log(rate / share) + (c[key] * np.log((1 - rate) / (1 - share)) if c[key] else 0.0)
        if ratio > limit:
            found.add(key)
    return found


class Model:
    """Weights, and document scores from marginals."""

    def __init__(self, own: dict[str, float], before: dict[str, float], after: dict[str, float], base: float, stay: float, enter: float):
        self.own, self.before, self.after = own, before, after
        self.base, self.stay, self.enter = base, stay, enter
        self.scale = np.zeros(4)
        self.forget()

    def forget(self) -> None:
        """Drop what was looked up; it is found again when needed."""
        self.memo: dict[str, int] = {}
        self.parts = np.zeros((1024, 3))
        self.kinds = {k: {f[1:]: v for f, v in self.own.items() if f[0] == k} for k in "wps#A"}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "parts", "kinds")}

    def _own(self, word: str, w: str) -> float:
        """The sum of weights of ``features(word)``, without making their names."""
        kinds, n = self.kinds, len(w)
        start = kinds["p"].get
        total = self.base + kinds["w"].get(w, 0.0) + kinds["s"].get(w[-3:], 0.0)
        for k in PREFIXES:
            if n < k:
                break
            total += start(w[:k], 0.0)
        if not w.isalpha() and any(map(str.isdigit, w)):
            total += kinds["#"].get("", 0.0)
        if n > 1 and word.isupper():
            total += kinds["A"].get("", 0.0)
        return total

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _look_up(self, words: list[str]) -> list[int]:
        memo, before, after = self.memo, self.before.get, self.after.get
        for w in dict.fromkeys(words):
            if w not in memo:
                k = memo[w] = len(memo)
                if k >= len(self.parts):
                    self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
                name = normal(w)
                self.parts[k] = self._own(w, name), before(name, 0.0), after(name, 0.0)
        return list(map(memo.__getitem__, words))

    def word_odds(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Log odds of toxic for each word of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.array([k for t in texts for k in self._look_up(t)], np.int64)
        if not len(ids):
            return [np.zeros(0) for _ in texts]
        ends = np.cumsum(sizes)
        evidence = self.parts[ids, 0]
        inner = np.ones(len(ids), bool)
        inner[ends[sizes > 0] - 1] = False  # last words have none after them
        evidence[1:] += np.where(inner[:-1], self.parts[ids[:-1], 1], 0.0)
        evidence[:-1] += np.where(inner[:-1], self.parts[ids[1:], 2], 0.0)
        table, place, chain = chains(evidence, sizes)
        odds, _, _ = marginals(table, np.bincount(chain), self.stay, self.enter)
        return np.split(odds[place, chain], ends[:-1])

    @staticmethod
    def summary(odds: np.ndarray) -> tuple[float, float, float]:
        """Of a text: log(1 + expected toxic words), the largest and the second largest marginal."""
        if not len(odds):
            return 0.0, 0.0, 0.0
        p = sigmoid(odds)
        top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
        return float(np.log1p(p.sum())), float(top[1]), float(top[0])

    def score(self, odds: np.ndarray) -> float:
        return float(sigmoid(self.scale[0] + self.scale[1:] @ np.array(self.summary(odds))))


class _Adam:
    def __init__(self, *arrays: np.ndarray):
        self.arrays, self.t = arrays, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, *slopes: np.ndarray) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a += _RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def train(texts: list[str], toxic: np.ndarray, fit: np.ndarray, weights: np.ndarray) -> Model:
    """``fit`` marks texts the chain is fitted to; all are used to find labelled words and to scale scores.

    Labelled words: in a toxic text, those with a key of ``toxic_keys``.
    """
    shared: dict[str, str] = {}
    texts = [[shared.setdefault(w, w) for w in t.split()] for t in texts]  # one object a word
    keys = toxic_keys(texts, toxic)
    chosen = [(t, y) for t, y, f in zip(texts, toxic, fit, strict=True) if f and t]
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for t, _ in chosen for w in t], np.int64)
    sizes = np.array([len(t) for t, _ in chosen], np.int64)
    words = list(names)
    uses = np.bincount(ids, minlength=len(words))
    every: dict[str, int] = {}
    word_of, feature_of, listed = array("i"), array("i"), np.zeros(len(words), bool)
    for i, w in enumerate(words):
        for f in features(w):
            word_of.append(i)
            feature_of.append(every.setdefault(f, len(every)))
            listed[i] |= f in keys
    word_of, feature_of = (np.frombuffer(x, np.int32) for x in (word_of, feature_of))
    often = np.bincount(feature_of, uses[word_of], len(every)) >= _RARE
    number = np.cumsum(often) - 1
    known = {f: int(number[k]) for f, k in every.items() if often[k]}
    word_of, feature_of = word_of[often[feature_of]], number[feature_of[often[feature_of]]]
    del every
    label = listed[ids] & np.repeat(np.array([y for _, y in chosen], bool), sizes)
    normals: dict[str, int] = {}
    normal_of = np.array([normals.setdefault(normal(w), len(normals)) for w in words], np.int64)
    beside = np.bincount(normal_of[ids], minlength=len(normals)) >= 20  # words that count as neighbours
    near = normal_of[ids]

    ends = np.cumsum(sizes)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    inner = inner[:-1]
    own, before, after = np.zeros(len(known)), np.zeros(len(normals)), np.zeros(len(normals))
    rest = np.array([-3.0, 0.0, 0.0])  # base, stay, enter
    _, place, chain = chains(np.zeros(len(ids)), sizes)
    lengths = np.bincount(chain)
    chained = inner & (chain[1:] == chain[:-1])
    seen_stay = float((label[1:] & label[:-1])[chained].sum())
    seen_enter = float((label[1:] & ~label[:-1])[chained].sum())
    adam, n = _Adam(own, before, after, rest), len(ids)
    for _ in range(_STEPS):
        evidence = (rest[0] + np.bincount(word_of, own[feature_of], len(words)))[ids]
        evidence[1:] += np.where(inner, before[near[:-1]], 0.0)
        evidence[:-1] += np.where(inner, after[near[1:]], 0.0)
        table, _, _ = chains(evidence, sizes)
        odds, stayed, entered = marginals(table, lengths, rest[1], rest[2])
        error = label - sigmoid(odds[place, chain])
        by_word = np.bincount(ids, error, len(words))
        slope_own = np.bincount(feature_of, by_word[word_of], len(known)) / n - _DECAY * own / len(known) ** 0.5
        slope_before = np.bincount(near[:-1], np.where(inner, error[1:], 0.0), len(normals)) * beside / n - _DECAY * before / len(known) ** 0.5
        slope_after = np.bincount(near[1:], np.where(inner, error[:-1], 0.0), len(normals)) * beside / n - _DECAY * after / len(known) ** 0.5
        adam.step(slope_own, slope_before, slope_after, np.array([error.sum(), seen_stay - stayed, seen_enter - entered]) / n)
    keep = lambda names, w: {k: float(w[i]) for k, i in names.items() if abs(w[i]) > 0.01}
    model = Model(keep(known, own), keep(normals, before * beside), keep(normals, after * beside), *map(float, rest))
    model.scale = _scale(np.array([Model.summary(o) for o in model.word_odds(texts)]), toxic, weights)
    return model


def _scale(seen: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on the texts' summaries, lightly held back, by Newton's steps."""
    x = np.column_stack([np.ones(len(seen)), seen])
    w, hold = np.zeros(4), np.diag([1e-3, 0.5, 0.5, 0.5])
    for _ in range(40):
        p = sigmoid(x @ w)
        slope = x.T @ (weights * (toxic - p)) - hold @ w
        bend = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + hold
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w
