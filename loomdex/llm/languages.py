"""Languages of documents and of their stretches by error-correcting output codes.

Each language, and text in none, has a codeword of ``BITS`` signs. For each bit a linear
classifier over the n-grams of words gives the log-odds of the side on which a text lies;
decoding weighs the bits by how reliable they are and takes the language whose codeword
has the least loss. A stretch whose best codeword isn't clearly the best is ambiguous and
gets no language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ship, spread

#: Bits of a codeword, hashed n-gram columns, longest n-gram.
BITS, COLUMNS, LONGEST = 31, 1 << 15, 5
#: Documents and their longest text for which the least numbers below were set; they bound nothing.
DOCUMENTS_MOST, DOCUMENT_LENGTH = 3_000, 2_000
#: N-grams of all languages that each language's own are mixed with.
SMOOTHING = 200.0
#: Parts of the samples that are held out in turn, the longest window of them in words, and the scales tried.
FOLDS, LONGEST_WINDOW = 4, 6
SCALES = tuple(0.02 * 1.25**i for i in range(20))
#: Rows of a word, and its least share of them at an end of a sentence, for it to be one that stands there.
INNER_LEAST, INNER_SHARE = 10, 0.02
#: Rows of a word that belongs to a language.
OWN_LEAST = 3
#: The share of its language that tells such a word from few rows, as words like "with" are common; rows that tell of any word.
INNER_COMMON, INNER_SURE = 5e-3, 150
#: What these rows must be at least of all rows of the language, so that what a word is doesn't change with the size of the corpus.
INNER_OF_ALL, OWN_OF_ALL = 1e-4, 1e-4
#: Documents that a word must have to be gone by, their least share of all, and votes that a kind of sentence must have.
KIND_DOCUMENTS, KIND_OF_ALL, KIND_VOTES = 5, 4e-3, 3
#: Characters of text that are worked on at once.
TEXT_AT_ONCE = 400_000
#: Units of texts, or words to be counted, that a Python worker remembers.
UNITS_KEPT = 200_000
SEED = 20_190_107
#: The class of text in no language.
NONE = ""
#: Least plain words of a sentence, and of one that may be a phrase of its neighbour.
SENTENCE_WORDS, LINKED_WORDS = 4, 8
#: The same in signs of a script without spaces, and the least different ones among them.
SENTENCE_SIGNS, LINKED_SIGNS, DIFFERENT_SIGNS = 8, 14, 6
#: How many plain words make up for one other token between them.
OTHER_COST = 1.5
#: What a change of language in a run costs, as log-odds: one in some 150 words.
CHANGE_COST = 5.0
#: Least confidence of a stretch that isn't ambiguous.
SURE = 0.8

#: Letters whose plain form isn't their decomposition.
PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})
#: Three-letter codes, terminological and bibliographic, of two-letter ones.
LONG_CODES = {
    "deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "jpn": "ja",
    "nld": "nl", "dut": "nl", "pol": "pl", "por": "pt", "rus": "ru", "swe": "sv", "zho": "zh", "chi": "zh",
}
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SIGN = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_UNSPACED = regex.compile(rf"[{_SIGN}]+|[^{_SIGN}]+")
_IS_UNSPACED = regex.compile(rf"[{_SIGN}]")


def plain(word: str) -> str:
    """A word without case, accents and compatibility forms."""
    if word.isascii():
        return word.lower()
    apart = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).casefold())
    return "".join(c for c in apart if unicodedata.category(c) != "Mn").translate(PLAIN)


def words_of(text: str) -> list[str]:
    """Words of a text; a run of a script without spaces gives its overlapping pairs."""
    out = []
    for word in _WORD.findall(text):
        if word.isascii() or not _IS_UNSPACED.search(word):
            out.append(word)
            continue
        for run in _UNSPACED.findall(word):
            if _IS_UNSPACED.match(run) and len(run) > 1:
                out.extend(run[i : i + 2] for i in range(len(run) - 1))
            else:
                out.append(run)
    return out


def _parts(text: str) -> list[str]:
    """Plain words of a text; signs of a script without spaces stand alone."""
    out: list[str] = []
    for word in _WORD.findall(text):
        for part in [word] if word.isascii() else _UNSPACED.findall(word):
            out += part if _IS_UNSPACED.match(part) else [plain(part)]
    return out


def columns_of(word: str) -> list[int]:
    """Hashed columns of a word: its n-grams with ends marked, and itself."""
    marked = f" {plain(word)} "
    n = len(marked)
    grams = [marked[i : i + k] for k in range(1, LONGEST + 1) for i in range(n - k + 1)]
    return [zlib.crc32(g.encode()) % COLUMNS for g in (*grams, "=" + marked)]


def codebook(classes: int, bits: int = BITS, tries: int = 2_000, seed: int = SEED) -> np.ndarray:
    """Signs (classes, bits): of many random balanced books the one whose closest rows lie furthest apart."""
    draw, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(tries):
        book = np.where(draw.permuted(np.arange(bits * classes).reshape(bits, classes) % 2, axis=1), 1, -1).T
        apart = ((bits - book @ book.T) // 2)[~np.eye(classes, dtype=bool)].min() if classes > 1 else bits
        if apart > distance:
            best, distance = book, apart
    return best.astype(np.float32)


@dataclass
class Model:
    """Fitted classifiers: class names, their codewords, log-odds per column and bit, and the weight of each bit.

    ``scale`` tells how much of the log-odds of overlapping n-grams counts; the weights
    include it. ``inner_last`` and ``inner_first`` are the words of each language that
    hardly ever end or begin a sentence, ``often`` all but its rarest words.
    """

    names: list[str]
    book: np.ndarray
    weights: np.ndarray
    reliable: np.ndarray
    scale: float = 1.0
    inner_last: dict[str, frozenset[str]] = field(default_factory=dict)
    inner_first: dict[str, frozenset[str]] = field(default_factory=dict)
    often: dict[str, frozenset[str]] = field(default_factory=dict)
    units: Units | None = None

    def losses(self, odds: np.ndarray) -> np.ndarray:
        """Weighted loss (rows, classes) of bit log-odds (rows, bits): logistic loss against each codeword.

        The two losses of a bit, for either sign, differ by its log-odds.
        """
        odds = np.clip(odds, -1_000, 1_000)
        positive = np.log1p(np.exp(-np.abs(odds))) + np.maximum(-odds, 0)
        return (positive @ self.reliable)[:, None] + (odds * self.reliable) @ ((1 - self.book) / 2).T

    def __getstate__(self) -> dict:
        return self.__dict__ | {"units": None}

    def known(self) -> Units:
        """What is remembered of the units of texts, from call to call."""
        if self.units is None or len(self.units.rows) > UNITS_KEPT:
            self.units = Units(self)
        return self.units


class _Words:
    """The distinct words of some texts with their columns, for counting by numbers."""

    def __init__(self, texts: Sequence[Sequence[str]]) -> None:
        words = {w: i for i, w in enumerate(dict.fromkeys(w for some in texts for w in some))}
        self.texts = [np.array([words[w] for w in some], np.int64) for some in texts]
        columns = [columns_of(w) for w in words]
        self.columns = np.array([c for some in columns for c in some], np.int64)
        self.starts = np.cumsum([0, *map(len, columns)])

    def counts(self, which: Iterable[int]) -> np.ndarray:
        """How often each column occurs in some of the texts."""
        chosen = [self.texts[i] for i in which]
        times = np.bincount(np.concatenate(chosen) if chosen else np.zeros(0, np.int64), minlength=len(self.starts) - 1)
        return np.bincount(self.columns, np.repeat(times, np.diff(self.starts)), COLUMNS)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Bit scores of every word."""
        return np.array([weights[self.columns[a:b]].sum(axis=0) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)])


def _log_odds(seen: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Log-odds (columns, bits) that an n-gram is of a language on the positive side of a bit.

    ``seen`` has the counts (classes, columns). Each language counts alike. Its n-gram
    shares are smoothed towards those of all languages; an n-gram that isn't in any text
    says nothing.
    """
    sizes = seen.sum(axis=1, keepdims=True)
    common = (seen / np.maximum(1, sizes)).sum(axis=0) / max(1, (sizes > 0).sum())
    shares = (seen + SMOOTHING * common) / (sizes + SMOOTHING)
    weights = np.zeros((COLUMNS, book.shape[1]), np.float32)
    used = common > 0
    for bit, side in enumerate(book.T > 0):
        weights[used, bit] = np.log(shares[side][:, used].mean(axis=0) / shares[~side][:, used].mean(axis=0))
    return weights


def _inner_least(total: int) -> float:
    """Rows that tell whether a word ends or begins sentences, of a language of ``total`` rows."""
    return min(max(INNER_LEAST, INNER_COMMON * total), max(INNER_SURE, INNER_OF_ALL * total))


def _inner_words(texts: Sequence[str], labels: Sequence[str]) -> list[dict[str, frozenset[str]]]:
    """Words of each language that hardly ever stand last in a sentence, those that hardly ever stand first, and all but the rarest."""
    every, last, first = ({name: Counter() for name in set(labels)} for _ in range(3))
    for text, label in zip(texts, labels, strict=True):
        parts = _parts(text)
        every[label].update(parts)
        last[label].update(parts[-1:])
        first[label].update(parts[:1])
    often = {name: [w for w, n in some.items() if n >= _inner_least(some.total())] for name, some in every.items()}
    rare = [{name: frozenset(w for w in some if at[name][w] < INNER_SHARE * every[name][w]) for name, some in often.items()} for at in (last, first)]
    return [*rare, {name: frozenset(w for w, n in some.items() if n >= max(OWN_LEAST, OWN_OF_ALL * some.total())) for name, some in every.items()}]


def fit(texts: Sequence[str], labels: Sequence[str], measured: Model | None = None, uncut: int | None = None, seed: int = SEED) -> Model:
    """Fit one n-gram classifier for each bit, by the log-odds of n-grams on its two sides.

    N-grams overlap, so their log-odds add up to too much. By how much, and how reliable
    each bit is, is measured on windows of one to six words held out in ``FOLDS`` parts,
    or taken over from a model that was measured. The first ``uncut`` texts tell how
    sentences begin and end; all if not given. ``fit_rows`` gives the same from a table.
    """
    names = sorted(set(labels))
    book = codebook(len(names), seed=seed)
    rows = np.array([names.index(label) for label in labels])
    words = _Words([words_of(t) for t in texts])
    classes = range(len(names))
    part = np.array([zlib.crc32(t.encode()) % FOLDS for t in texts])
    odds, truth = [], []
    for fold in range(FOLDS if measured is None and len(names) > 1 else 0):
        weights = _log_odds(np.array([words.counts(np.flatnonzero((part != fold) & (rows == c))) for c in classes]), book)
        scores = words.scores(weights)
        for i in np.flatnonzero(part == fold):
            some = _windows(words.texts[i], scores)
            odds += some
            truth += [rows[i]] * len(some)
    weights = _log_odds(np.array([words.counts(np.flatnonzero(rows == c)) for c in classes]), book) if len(names) > 1 else np.zeros((COLUMNS, BITS))
    model = Model(names, book, weights, np.ones(book.shape[1], np.float32))
    model.inner_last, model.inner_first, model.often = _inner_words(texts[:uncut], labels[:uncut])
    if measured is not None:
        model.reliable, model.scale = measured.reliable, measured.scale
    elif odds:
        odds, truth = np.array(odds), np.array(truth)
        model.reliable = _reliable((np.sign(odds) != book[truth]).mean(axis=0))
        # The scale under which held-out windows are the most likely.
        model.scale = min(SCALES, key=lambda s: _surprise(model, odds * s, truth))
    model.weights = (model.weights * model.scale).astype(np.float32)
    return model


def _windows(words: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
    """Bit log-odds of windows of one to six words of a text in turn."""
    out, at, length = [], 0, 0
    while at < len(words):
        length = length % LONGEST_WINDOW + 1
        out.append(scores[words[at : at + length]].sum(axis=0))
        at += length
    return out


def _reliable(wrong: np.ndarray) -> np.ndarray:
    """Weights of the bits by the share of windows on which each is wrong."""
    wrong = np.clip(wrong, 0.01, 0.49)
    reliable = np.log((1 - wrong) / wrong)
    return (reliable / reliable.mean()).astype(np.float32)


def _surprise(model: Model, odds: np.ndarray, truth: np.ndarray) -> float:
    shares = confidences(model.losses(odds))
    return float(-np.log(np.maximum(shares[np.arange(len(truth)), truth], 1e-6)).mean())


def confidences(losses: np.ndarray) -> np.ndarray:
    """Share of each class (rows, classes): a codeword's likelihood by its mean loss, in units of one bit's distance."""
    apart = BITS / 2
    z = np.exp(np.clip((losses.min(axis=1, keepdims=True) - losses) / apart, -50, 0))
    return z / z.sum(axis=1, keepdims=True)


#: Units: what stands between blanks, with the blanks after it; signs of a script without spaces one by one.
_UNIT = re.compile(r"\S+\s*")
_SIGN_UNIT = regex.compile(rf"(?:[{_SIGN}]|[^\s{_SIGN}。！？；]*[。！？；]|[^\s{_SIGN}。！？；]+)\s*")
_ENDS = regex.compile(r"[.!?;…:]['\"»”’)]*\Z|[。！？；]\Z")
_LINE_END = regex.compile(r"[\r\n\v\f\x1c-\x1e\x85\u2028\u2029]")
_PLAIN = regex.compile(
    r"[\"'«»“”„(¿¡‘’\[]*(?:[\p{L}\p{M}]+(?:['’ʼ\-][\p{L}\p{M}]+)*|\p{L}{4,}\d{1,3})[\"'»”“’)\].,;:!?…\u200b\ufeff]*"
)
#: Quotes that open.
QUOTES = frozenset("\"'«»“„‘‹「『")
#: Kinds of units: a plain word, another token, a sign of a script without spaces.
WORD, OTHER, SIGN = 1, 0, 2


def units_of(text: str) -> tuple[list[str], list[str]]:
    """(units, keys): the units of a text that has no blanks before the first, and what they stand for.

    The key of a sign includes the sign after it, as pairs of signs tell the language.
    """
    if text.isascii() or not _IS_UNSPACED.search(text):
        units = _UNIT.findall(text)
        return units, units
    units = _SIGN_UNIT.findall(text)
    keys = units[:]
    signs = [c in _SIGNS or _is_sign(c) for c in (u[0] for u in units)]
    for i in range(len(units) - 1):
        if signs[i] and signs[i + 1] and len(units[i]) == 1:
            keys[i] = units[i] + units[i + 1][0]
    return units, keys


#: Signs met so far.
_SIGNS: set[str] = set()


def _is_sign(c: str) -> bool:
    if _IS_UNSPACED.match(c):
        _SIGNS.add(c)
        return True
    return False


class Units:
    """What is known of units, by row: bit scores, number of n-grams, kind, letters, length without blanks, whether a run ends there."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rows: dict[str, int] = {}
        self.words: dict[str, int] = {}
        # The first word stands for none.
        self.word_scores = np.zeros((1, model.book.shape[1]), np.float32)
        self.word_grams = np.zeros(1, np.int32)
        self.scores = np.zeros((0, model.book.shape[1]), np.float32)
        self.facts = np.zeros((0, 5), np.int32)

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            columns = [columns_of(w) for w in new]
            self.words.update(zip(new, range(len(self.word_grams), len(self.word_grams) + len(new)), strict=True))
            self.word_scores = np.concatenate([self.word_scores, np.array([self.model.weights[c].sum(axis=0) for c in columns], np.float32)])
            self.word_grams = np.concatenate([self.word_grams, np.array([len(c) for c in columns], np.int32)])

    def add(self, keys: Sequence[str]) -> None:
        """Learn keys that aren't known yet."""
        facts, words = [], []
        for key in keys:
            token = key.rstrip() or key
            length = len(token)
            line = key[length:] not in ("", " ") and bool(_LINE_END.search(key, length))
            if token.isascii() and token.isalpha():
                words.append([token])
                facts.append((WORD, length, length, line))
                continue
            words.append(words_of(token))
            if _is_sign(token[0]):
                facts.append((SIGN, 1, 1, line))
                continue
            kind = WORD if words[-1] and _PLAIN.fullmatch(token) else OTHER
            ends = not token[-1].isalnum() and bool(_ENDS.search(token)) and (len(key) > length or token[-1] in "。！？；")
            facts.append((kind, length, length, line or ends))
        self._learn(w for some in words for w in some)
        counts = np.array([max(1, len(some)) for some in words])
        at = np.array([self.words[w] if w else 0 for some in words for w in (some or ("",))])
        starts = np.cumsum(counts) - counts
        scores = np.add.reduceat(self.word_scores[at], starts, axis=0)
        grams = np.add.reduceat(self.word_grams[at], starts)
        self.rows.update(zip(keys, range(len(self.facts), len(self.facts) + len(keys)), strict=True))
        self.scores = np.concatenate([self.scores, scores])
        self.facts = np.concatenate([self.facts, np.column_stack([grams, np.array(facts, np.int32)])])


def _upto(values: np.ndarray) -> np.ndarray:
    """Running sums with a 0 before the first."""
    out = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=out[1:])
    return out


def _lowest(sums: np.ndarray, first: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Least of running sums (n + 1) from the start of each row's part up to it.

    Parts are kept apart by a shift that is larger than any difference of sums.
    """
    shift = float(sums.max() - sums.min()) + 1
    shifts = (part * shift).reshape(-1, *[1] * (sums.ndim - 1))
    return np.minimum(np.minimum.accumulate(sums[1:] - shifts, axis=0) + shifts, sums[first][part])


def phrases_of(text: str, cuts: Sequence[int], names: Sequence[str], model: Model) -> tuple[list[bool], list[tuple[int, int]]]:
    """Which stretches between the ``cuts`` of a run may be no more than a phrase of their neighbour, and what they part.

    ``names`` are the languages of the stretches. A stretch beside another language may be
    a phrase, such as a name, if the sentence before it can't end there or the one after it
    can't begin there, by the words that hardly ever end or begin a sentence of their
    language; if it holds such a word of its neighbour's that isn't one of its own
    language, or an opening quote sets it off; if it doesn't end as a sentence does; or if it
    stands between two parts of the same language that aren't both sentences by themselves.
    Also given are the pairs of parts that a phrase stands between.
    """
    known = [j for j, name in enumerate(names) if name != NONE]
    words = {j: _parts(text[cuts[j] : cuts[j + 1]]) for j in known}
    linked, parted = [False] * len(names), []
    around = {}
    for at, j in enumerate(known):
        left, right = known[at - 1] if at else None, known[at + 1] if at + 1 < len(known) else None
        around[j] = left, right
        sides = [k for k in (left, right) if k is not None and names[k] != names[j]]
        own = model.often.get(names[j], frozenset())
        for k in sides:
            # One word alone is a name itself.
            if len(words[k]) > 1:
                inner = (model.inner_last if k < j else model.inner_first).get(names[k], frozenset())
                linked[j] |= words[k][-1 if k < j else 0] in inner
                linked[j] |= any(w in inner and w not in own for w in words[j])
        linked[j] |= left in sides and text[cuts[j]] in QUOTES
        if len(sides) == 2 and names[left] == names[right]:
            linked[j] |= not all(whole_sentence(text[cuts[k] : cuts[k + 1]]) for k in sides)
    for j in known:
        left, right = around[j]
        last = j == len(names) - 1 or right == j + 1 and not linked[right]
        if left is not None and names[left] != names[j] and last:
            linked[j] |= words[j][-1] in model.inner_last.get(names[j], ())
    for j in known:
        left, right = around[j]
        if linked[j] and None not in (left, right) and names[left] == names[right] != names[j]:
            parted.append((left, right))
    return linked, parted


def _varied(text: str, signs: bool) -> bool:
    """Whether a sentence has enough different signs or words; one word over and over is none."""
    if signs:
        return len({*_IS_UNSPACED.findall(text)}) >= DIFFERENT_SIGNS
    return len({plain(t) for t in text.split() if _PLAIN.fullmatch(t)}) >= SENTENCE_WORDS


def whole_sentence(text: str, linked: bool = False) -> bool:
    """Whether a stretch has the shape of a sentence: enough words in a row, with few other tokens between.

    A ``linked`` stretch may be a phrase in a sentence of another language and takes more.
    """
    signs = _IS_UNSPACED.findall(text)
    if len(signs) >= (LINKED_SIGNS if linked else SENTENCE_SIGNS):
        return _varied(text, True)
    kinds, letters = [], []
    for unit in units_of(text.strip())[0]:
        token = unit.rstrip()
        kinds.append(SIGN if _IS_UNSPACED.match(token) else WORD if _PLAIN.fullmatch(token) else OTHER)
        letters.append(len(token))
    if not kinds:
        return False
    zero = np.zeros(1, np.int64)
    most = sentence_words(np.array(kinds), np.array(letters), zero, np.zeros(len(kinds), np.int64))[0]
    return bool(most >= (LINKED_WORDS if linked else SENTENCE_WORDS)) and _varied(text, False)


def best_paths(scores: np.ndarray, first: np.ndarray, length: np.ndarray, cost: float = CHANGE_COST) -> np.ndarray:
    """Class of every row of some runs: most support in total, less ``cost`` for each change.

    Runs are given by their first row and their length; they are worked on side by side,
    the longest first. Rows of no run get class 0.
    """
    path = np.zeros(len(scores), np.int16)
    if not len(first):
        return path
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    running = np.searchsorted(-length, -np.arange(length[0]), side="left")
    total = scores[first].astype(np.float64)
    stay = np.arange(scores.shape[1], dtype=np.int8)
    came: list[np.ndarray] = []
    for i in range(1, len(running)):
        k = running[i]
        top = total[:k].argmax(axis=1)
        change = (total[np.arange(k), top] - cost)[:, None]
        came.append(np.where(total[:k] >= change, stay, top.astype(np.int8)[:, None]))
        total[:k] = np.maximum(total[:k], change) + scores[first[:k] + i]
    at = total.argmax(axis=1)
    for i in range(len(running) - 1, -1, -1):
        k = running[i]
        path[first[:k] + i] = at[:k]
        if i:
            at[:k] = came[i - 1][np.arange(k), at[:k]]
    return path


def _cuts(new: np.ndarray, path: np.ndarray, none: int) -> np.ndarray:
    """Where stretches begin: at new runs and changes of class.

    A few units in no language between two of the same language are a name in its sentence.
    """
    cut = new.copy()
    cut[1:] |= path[1:] != path[:-1]
    first = np.flatnonzero(cut)
    size = np.diff(np.r_[first, len(path)])
    kind = path[first]
    inner = np.flatnonzero((kind[1:-1] == none) & (kind[:-2] == kind[2:]) & (size[1:-1] < SENTENCE_WORDS) & ~new[first[1:-1]] & ~new[first[2:]]) + 1
    cut[first[inner]] = cut[first[inner + 1]] = False
    return cut


def sentence_words(kind: np.ndarray, letters: np.ndarray, first: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Most plain words in a row of each part, with few other tokens between and of more than 2.5 letters on average."""
    steps = np.array([-OTHER_COST, 1.0, 0.0])[kind]
    sums = _upto(steps)
    lowest = _lowest(sums, first, part)
    before = np.r_[0.0, lowest[:-1]]
    before[first] = sums[first]
    # Where the balance falls below 0, counting starts anew.
    rows = np.arange(len(kind))
    since = np.maximum.accumulate(np.maximum(np.where(sums[1:] < before, rows + 1, 0), first[part]))
    plain_words, plain_letters = _upto(kind == WORD), _upto(np.where(kind == WORD, letters, 0))
    count = plain_words[1:] - plain_words[since]
    enough = (kind == WORD) & (plain_letters[1:] - plain_letters[since] > 2.5 * count)
    return np.maximum.reduceat(np.where(enough, count, 0), first)


@dataclass
class Stretches:
    """Stretches of some texts as columns: text, place, class, confidence, whether each is of a known language,

    a whole sentence of it, of the shape of one, and a whole run.
    """

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    kind: np.ndarray
    confidence: np.ndarray
    known: np.ndarray
    whole: np.ndarray
    shaped: np.ndarray
    uncut: np.ndarray


def find_stretches(texts: Sequence[str], model: Model) -> Stretches:
    """Stretches of one language of each text, in its order.

    A text is cut at line ends and ends of sentences, and these runs, however short or
    long, where a best path over their units changes the language. Runs of one language
    that follow each other are left apart. Runs without a letter are left out.
    """
    keys: list[str] = []
    lengths: list[int] = []
    counts, offsets = [], []
    for text in texts:
        bare = text.lstrip()
        units, some = units_of(bare)
        counts.append(len(units))
        offsets.append(len(text) - len(bare))
        lengths += map(len, units)
        keys += some
    nothing = np.zeros(0, np.int64)
    empty = Stretches(nothing, nothing, nothing, nothing, np.zeros(0), *[np.zeros(0, bool)] * 4)
    if not keys or len(model.names) < 2:
        return empty
    units = model.known()
    rows = list(map(units.rows.get, keys))
    if None in rows:
        units.add(list(dict.fromkeys(key for key, row in zip(keys, rows, strict=True) if row is None)))
        rows = list(map(units.rows.get, keys))
    rows = np.array(rows)
    grams, kind, letters, length, ends = units.facts[rows].T
    text = np.repeat(np.arange(len(texts)), counts)
    upto = _upto(np.array(lengths)).astype(np.int64)
    begins = np.r_[0, np.cumsum(counts)[:-1]]
    place = upto[:-1] - np.repeat(upto[begins] - np.array(offsets), counts)

    new = np.r_[True, (ends[:-1] > 0) | (text[1:] != text[:-1])]
    run_first = np.flatnonzero(new)
    lettered = np.add.reduceat(grams, run_first) > 0
    if not lettered.all():
        kept = np.repeat(lettered, np.diff(np.r_[run_first, len(rows)]))
        rows, grams, kind, letters, length, text, place, new = (x[kept] for x in (rows, grams, kind, letters, length, text, place, new))
        run_first = np.flatnonzero(new)
    if not len(rows):
        return empty
    scores = units.scores[rows]
    run = np.cumsum(new) - 1
    run_length = np.diff(np.r_[run_first, len(rows)])
    support = (scores * model.reliable) @ (model.book.T / model.book.shape[1])
    # If no other class gains half the cost on any part of a run, no change can pay.
    alone = np.add.reduceat(support, run_first, axis=0).argmax(axis=1)
    sums = _upto(support - np.take_along_axis(support, alone[run][:, None], axis=1))
    gain = np.maximum.reduceat((sums[1:] - _lowest(sums, run_first, run)).max(axis=1), run_first)
    searched = np.flatnonzero((gain > CHANGE_COST / 2) & (run_length > 1))
    path = best_paths(support, run_first[searched], run_length[searched])
    none = model.names.index(NONE) if NONE in model.names else -1
    cut = _cuts(new, path, none)
    first = np.flatnonzero(cut)
    part = np.cumsum(cut) - 1
    last = np.r_[first[1:], len(rows)] - 1

    losses = model.losses(np.add.reduceat(scores, first, axis=0))
    top = losses.argmin(axis=1)
    confidence = confidences(losses)[np.arange(len(top)), top]
    known = (top != none) & (confidence >= SURE)
    start, stop = place[first], place[last] + length[last]

    words = sentence_words(kind, letters, first, part)
    signs = np.add.reduceat(kind == SIGN, first)
    least, least_signs = np.full(len(first), SENTENCE_WORDS), np.full(len(first), SENTENCE_SIGNS)
    of_run, number = run[first], text[first]
    in_run = np.bincount(of_run)
    # Only runs with more than one language can hold a phrase of another.
    of_known = np.flatnonzero(known)
    several = np.zeros(len(in_run), bool)
    mixed = (of_run[of_known][1:] == of_run[of_known][:-1]) & (top[of_known][1:] != top[of_known][:-1])
    several[of_run[of_known][1:][mixed]] = True
    several = np.flatnonzero(several)
    joined: dict[int, int] = {}
    run_piece = np.searchsorted(of_run, several)
    for at, n in zip(run_piece.tolist(), in_run[several].tolist(), strict=True):
        cuts = [*start[at : at + n].tolist(), int(stop[at + n - 1])]
        names = [model.names[c] if k else NONE for c, k in zip(top[at : at + n].tolist(), known[at : at + n].tolist(), strict=True)]
        linked, parted = phrases_of(texts[number[at]], cuts, names, model)
        for i in np.flatnonzero(linked).tolist():
            least[at + i], least_signs[at + i] = LINKED_WORDS, LINKED_SIGNS
        for left, right in parted:
            words[at + right] += words[at + left]
            signs[at + right] += signs[at + left]
            least[at + right], least_signs[at + right] = SENTENCE_WORDS, SENTENCE_SIGNS
            joined[at + right] = joined.get(at + left, start[at + left])
    whole = (signs >= least_signs) | (words >= least)
    for i in np.flatnonzero(whole & ((signs >= least_signs) | (words < 2 * SENTENCE_WORDS))).tolist():
        whole[i] = _varied(texts[number[i]][joined.get(i, start[i]) : stop[i]], signs[i] >= least_signs[i])
    return Stretches(number, start, stop, top, confidence, known, whole & known, whole, in_run[of_run] == 1)


def stretches_of(texts: Sequence[str], model: Model) -> list[list[tuple[int, int, str | None, float, bool]]]:
    """Stretches of each text: (start, stop, language or null, confidence, whether it holds a whole sentence).

    Null: no language, or an ambiguous one.
    """
    result: list[list[tuple[int, int, str | None, float, bool]]] = [[] for _ in texts]
    s = find_stretches(texts, model)
    columns = (s.text, s.start, s.stop, s.kind, s.confidence, s.known, s.whole)
    for text, start, stop, kind, confidence, known, whole in zip(*(c.tolist() for c in columns), strict=True):
        result[text].append((start, stop, model.names[kind] if known else None, confidence, whole))
    return result


def label_code(label: Column) -> Column:
    """Two-letter code of a label read without regard to case and region; null if it is none."""
    found = F.regexp_extract(F.lower(F.trim(label)), r"\A([a-z]{2,3})([-_].*)?\z", 1)
    long = F.create_map(*[F.lit(x) for pair in LONG_CODES.items() for x in pair])
    return F.when(F.length(found) == 2, found).otherwise(F.try_element_at(long, found))


def first_documents(documents: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct texts, however many copies there are; with ``most`` the first so many by a hash of the text.

    For the first ones only hashes are made distinct over all rows; texts are then moved up
    to the last hash that is needed.
    """
    if most is None:
        return documents.select("text").distinct()
    hashed = documents.select("text", F.xxhash64("text").alias("_hash"))
    # Texts with the same hash can only make this bound higher than needed.
    last = hashed.select("_hash").distinct().orderBy("_hash").limit(most).agg(F.max("_hash")).first()[0]
    needed = hashed.where(F.col("_hash") <= F.lit(last)).distinct()
    return needed.orderBy("_hash", "text").limit(most).select("text")


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with the texts in their first column, of a bounded length."""
    for batch in batches:
        first = size = 0
        texts: list[str] = []
        for at, text in enumerate(batch.column(0)):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= TEXT_AT_ONCE or at == batch.num_rows - 1:
                yield batch.slice(first, at + 1 - first), texts
                texts, first, size = [], at + 1, 0


class _Plain(dict):
    """Plain forms of words, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) > UNITS_KEPT:
            self.clear()
        self[word] = found = plain(word)
        return found


#: What a row of ``_contexts`` is: a sentence, a line in no language, a word and its documents, or a number of documents.
SENTENCE, LINE, SEEN, ALL = range(4)
_CONTEXT = pa.schema([("what", pa.int32()), ("text", pa.string()), ("name", pa.string()), ("around", pa.string()), ("uncut", pa.bool_()), ("n", pa.int64())])


def _context(what: int, rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array([what] * len(rows), pa.int32()), *(pa.array(c, f.type) for c, f in zip(columns, list(_CONTEXT)[1:], strict=True))], schema=_CONTEXT)


def _contexts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Sentences of texts with the language of most of the other text around each, other lines, and in how many texts words are."""
    seen: Counter[str] = Counter()
    forms, documents = _Plain(), 0
    for _, texts in _at_once(batches):
        found = find_stretches(texts, model)
        spans: defaultdict[int, list[tuple[str, str, int, bool]]] = defaultdict(list)
        lines = set()
        columns = (found.text, found.start, found.stop, found.kind, found.known, found.shaped, found.uncut)
        for text, start, stop, kind, known, shaped, uncut in zip(*(c.tolist() for c in columns), strict=True):
            part = texts[text][start:stop]
            if shaped:
                spans[text].append((part, model.names[kind] if known else NONE, stop - start if known else 0, uncut))
            else:
                # Lines that differ only in numbers teach nothing new.
                lines.add(regex.sub(r"\d+", "0", part))
        sentences = []
        for some in spans.values():
            weight: Counter[str] = Counter()
            for _, name, size, _ in some:
                weight[name] += size
            for part, name, size, uncut in some:
                rest = weight.copy()
                rest[name] -= size
                around, most = max(rest.items(), key=lambda x: (x[1], x[0]))
                if most * 3 < rest.total() * 2 or not most:
                    around = NONE
                sentences.append((part, name, around, uncut, 1))
        yield _context(SENTENCE, sentences)
        yield _context(LINE, [(line, NONE, NONE, False, 1) for line in lines])
        documents += len(texts)
        for text in texts:
            seen.update({forms[w] for w in set(words_of(text))})
        if len(seen) > UNITS_KEPT:
            yield _context(SEEN, [(w, NONE, NONE, False, n) for w, n in seen.items()])
            seen.clear()
    yield _context(SEEN, [(w, NONE, NONE, False, n) for w, n in seen.items()])
    yield _context(ALL, [("", NONE, NONE, False, documents)])


def _kinds(batches: Iterator[pa.RecordBatch], often: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Add to sentences their kind: the words that are in several documents; what else they hold is left out."""
    forms = _Plain()
    for batch, texts in _at_once(batches):
        kinds = [" ".join(w for w in map(forms.__getitem__, words_of(t)) if w in often) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string())], [*batch.schema.names, "kind"])


def context_sentences(documents: DataFrame, model: Model) -> DataFrame:
    """(text, lang, uncut) of the sentences of all documents, by what stands around them.

    A sentence's class is that of most of the other text of its document, by the majority of
    the documents that have a sentence of its kind; so a kind of sentence that the model
    takes for a neighbouring language still gets the right one. A sentence whose kind
    stands alone has to bear out its document. Lines that don't have the shape of a sentence
    are text in no language. No label of a document is used; copies of a text count once.
    ``uncut`` are those that begin and end as their authors made them.
    """
    ship(documents.sparkSession)
    texts = first_documents(documents.where(F.col("text").isNotNull()))
    schema = "what int, text string, name string, around string, uncut boolean, n bigint"
    found = cut(spread(texts).mapInArrow(partial(_contexts, model=model), schema))
    whole = found.where(F.col("what") == ALL).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(KIND_DOCUMENTS, KIND_OF_ALL * whole)
    # A share of the documents bounds how many words there can be.
    seen = found.where(F.col("what") == SEEN).groupBy("text").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("text")
    often = frozenset(r["text"] for r in seen.collect())
    sentences = spread(found.where(F.col("what") == SENTENCE).select("text", "name", "around", "uncut"))
    parts = sentences.mapInArrow(partial(_kinds, often=often), "text string, name string, around string, uncut boolean, kind string").withColumn("kind", F.xxhash64("kind"))
    votes = parts.where(F.col("around") != NONE).groupBy("kind", "around").agg(F.count(F.lit(1)).alias("n"))
    clear = votes.groupBy("kind").agg(F.sum("n").alias("all"), F.max(F.struct("n", "around")).alias("top")).where(
        (F.col("top.n") >= KIND_VOTES) & (F.col("top.n") * 3 >= F.col("all") * 2)
    ).select("kind", F.col("top.around").alias("_top"))
    alone = F.when(F.col("name") == F.col("around"), F.col("name")).otherwise(F.lit(NONE))
    chosen = parts.join(clear, "kind", "left").select("text", F.coalesce("_top", alone).alias("lang"), "uncut").where(F.col("lang") != NONE)
    lines = found.where(F.col("what") == LINE).select("text").distinct()
    return chosen.unionByName(lines.select("text", F.lit(NONE).alias("lang"), F.lit(False).alias("uncut")))


_COUNTED = pa.schema([("inner", pa.bool_()), ("key", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int64()), ("first", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Words of texts (text, lang, uncut) by class and held-out part, and plain words by class with their places."""
    at = {name: i for i, name in enumerate(names)}
    words: Counter[tuple[int, str]] = Counter()
    places: tuple[Counter[tuple[int, str]], ...] = (Counter(), Counter(), Counter())

    def rows() -> pa.RecordBatch:
        some = [(False, key, word, n, 0, 0) for (key, word), n in words.items()]
        some += [(True, *k, n, places[1][k], places[2][k]) for k, n in places[0].items()]
        columns = list(zip(*some, strict=True)) or [[]] * 6
        words.clear()
        for p in places:
            p.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)

    for batch, texts in _at_once(batches):
        for text, name, uncut in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kind = at[name]
            key = kind * FOLDS + zlib.crc32(text.encode()) % FOLDS
            words.update([(key, w) for w in words_of(text)])
            if uncut:
                parts = [(kind, w) for w in _parts(text)]
                places[0].update(parts)
                places[1].update(parts[-1:])
                places[2].update(parts[:1])
        if len(words) + len(places[0]) > UNITS_KEPT:
            yield rows()
    yield rows()


def _count_columns(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Counts (key, column, n) of the n-grams of counted words (key, word, n)."""
    seen = np.zeros((classes * FOLDS, COLUMNS), np.int64)
    for batch in batches:
        for key, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            np.add.at(seen[key], columns_of(word), n)
    keys, columns = np.nonzero(seen)
    step = 100_000
    for i in range(0, len(keys), step):
        k, c = keys[i : i + step], columns[i : i + step]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(seen[k, c])], ["key", "column", "n"])


def _measure(batches: Iterator[pa.RecordBatch], model: Model, folds: list[np.ndarray], surprise: bool) -> Iterator[pa.RecordBatch]:
    """One row of sums over held-out windows: their number, and how often each bit is wrong or their surprise at each scale."""
    total, sums = 0, np.zeros(len(SCALES) if surprise else model.book.shape[1])
    for batch, texts in _at_once(batches):
        words = _Words([words_of(t) for t in texts])
        part = np.array([zlib.crc32(t.encode()) % FOLDS for t in texts])
        rows = [model.names.index(name) for name in batch.column(1).to_pylist()]
        for fold, weights in enumerate(folds):
            scores = words.scores(weights)
            for i in np.flatnonzero(part == fold):
                odds = np.array(_windows(words.texts[i], scores))
                if len(odds):
                    truth = np.full(len(odds), rows[i])
                    total += len(odds)
                    sums += [_surprise(model, odds * s, truth) * len(odds) for s in SCALES] if surprise else (np.sign(odds) != model.book[truth]).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["total", "sums"])


def fit_rows(rows: DataFrame, names: Sequence[str], measured: Model | None = None, seed: int = SEED) -> Model:
    """``fit`` on every row of a table (text, lang, uncut), whose lang is one of the ``names``.

    Words are counted where they are read and the counts summed up by a shuffle. The driver
    gets counts by class and n-gram column, sums over windows, and the words that make up a
    share of their language, however many rows there are.
    """
    names = sorted(names)
    classes, book = len(names), codebook(len(names), seed=seed)
    ship(rows.sparkSession)
    rows = spread(rows.select("text", "lang", "uncut"))
    kinds = "inner boolean, key int, word string, n bigint, last bigint, first bigint"
    counted = rows.mapInArrow(partial(_count_words, names=names), kinds).groupBy("inner", "key", "word")
    counted = cut(counted.agg(*[F.sum(c).alias(c) for c in ("n", "last", "first")]))
    columns = counted.where(~F.col("inner")).select("key", "word", "n").mapInArrow(partial(_count_columns, classes=classes), "key int, column int, n bigint")
    sums = columns.groupBy("key", "column").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((classes, FOLDS, COLUMNS))
    key = sums["key"].to_numpy()
    seen[key // FOLDS, key % FOLDS, sums["column"].to_numpy()] = sums["n"].to_numpy()
    model = Model(names, book, _log_odds(seen.sum(axis=1), book), np.ones(book.shape[1], np.float32))

    inner = counted.where("inner")
    totals = dict.fromkeys(range(classes), 0) | {r["key"]: r["n"] for r in inner.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    least = {c: max(OWN_LEAST, OWN_OF_ALL * n) for c, n in totals.items()}
    some = inner.where(F.col("n") >= F.get(F.array(*[F.lit(float(least[c])) for c in range(classes)]), F.col("key"))).collect()
    own: dict[str, list] = {name: [] for name in names}
    for r in some:
        own[names[r["key"]]].append(r)
    rare = lambda at: {name: frozenset(r["word"] for r in x if r["n"] >= _inner_least(totals[r["key"]]) and r[at] < INNER_SHARE * r["n"]) for name, x in own.items()}
    model.inner_last, model.inner_first = rare("last"), rare("first")
    model.often = {name: frozenset(r["word"] for r in x) for name, x in own.items()}

    if measured is not None:
        model.reliable, model.scale = measured.reliable, measured.scale
    else:
        folds = [_log_odds(seen.sum(axis=1) - seen[:, fold], book) for fold in range(FOLDS)]
        plan = Model(names, book, np.zeros(0), model.reliable)
        for surprise in (False, True):
            parts = rows.mapInArrow(partial(_measure, model=plan, folds=folds, surprise=surprise), "total bigint, sums array<double>").collect()
            total, sums = sum(r["total"] for r in parts), np.sum([r["sums"] for r in parts], axis=0)
            if not total:
                break
            if surprise:
                model.scale = SCALES[int(np.argmin(sums))]
            else:
                plan.reliable = model.reliable = _reliable(sums / total)
    model.weights = (model.weights * model.scale).astype(np.float32)
    return model


def language_model(samples: DataFrame, documents: DataFrame) -> Model:
    """Fit the classifiers on labelled sentences.

    First on all samples, then again with the sentences of all documents (repeated ones
    once), whose language is told by what stands around them; the documents' own labels
    aren't used. Nothing is sampled: counts are summed up over every row.
    """
    known = samples.select("text", label_code(F.col("lang")).alias("lang"), F.lit(True).alias("uncut")).dropna()
    names = [r["lang"] for r in known.select("lang").distinct().collect()]
    if not names:
        return fit(["0"], [NONE])
    names.append(NONE)
    model = fit_rows(known, names)
    return fit_rows(known.unionByName(context_sentences(documents, model)), names, model)


_RESULT = (
    "languages array<struct<lang:string,confidence:double>>, "
    "stretches array<struct<start:int,stop:int,lang:string,confidence:double,sentence:boolean>>"
)
_LANGUAGE = pa.struct([("lang", pa.string()), ("confidence", pa.float64())])
_STRETCH = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentence", pa.bool_())])


def _lists(kind: pa.StructType, counts: np.ndarray, columns: Sequence[pa.Array]) -> pa.ListArray:
    values = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def _identify(batches: Iterator[pa.RecordBatch], model: Model, spans: bool) -> Iterator[pa.RecordBatch]:
    names = pa.array(model.names, pa.string())

    def rows(texts: list[str], first: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        s = find_stretches(texts, model)
        n, classes = len(texts), len(model.names)
        # Mean confidence of each language of a text, by the length of its whole sentences.
        cell = (s.text * classes + s.kind)[s.whole]
        size = (s.stop - s.start)[s.whole]
        weight = np.bincount(cell, size, n * classes)
        sure = np.bincount(cell, size * s.confidence[s.whole], n * classes)
        cells = np.flatnonzero(weight)
        counts = np.bincount(cells // classes, minlength=n)
        columns = [names.take(pa.array(cells % classes)), pa.array(sure[cells] / weight[cells])]
        arrays = [*(batch.column(i).slice(first, n) for i in (0, 1)), _lists(_LANGUAGE, counts, columns)]
        if spans:
            lang = names.take(pa.array(s.kind, mask=~s.known))
            columns = [pa.array(s.start), pa.array(s.stop), lang, pa.array(s.confidence), pa.array(s.whole)]
            arrays.append(_lists(_STRETCH, np.bincount(s.text, minlength=n), columns))
        else:
            arrays.append(pa.nulls(n, pa.list_(_STRETCH)))
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:2], "languages", "stretches"])

    for batch in batches:
        texts: list[str] = []
        first = size = 0
        for at, text in enumerate(batch.column(2)):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= TEXT_AT_ONCE or at == batch.num_rows - 1:
                yield rows(texts, first, batch)
                texts, first, size = [], at + 1, 0


def identify_languages(documents: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, label, languages, stretches) of every document, worked out where it is read.

    ``label`` is the two-letter code of the document's lang, null if it has none. Each
    stretch has its place in the text (from 0, stop excluded), its language or null for
    none, a confidence from 0 to 1, and whether it holds a whole sentence; without
    ``spans`` stretches are null. A document's languages are those of its whole sentences,
    with the mean confidence by length. A null, empty or blank text has neither. Texts are
    read to the end, whatever their length; repeated rows stay; other columns are ignored.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", label_code(F.col("lang")).alias("label"), "text")
    return spread(rows).mapInArrow(partial(_identify, model=model, spans=spans), f"doc_id {kind}, label string, {_RESULT}")


def mislabelled(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang): each language of the documents whose languages aren't exactly their label."""
    found = identify_languages(documents, language_model(samples, documents), spans=False)
    right = (F.size("languages") == 1) & F.get("languages", F.lit(0))["lang"].eqNullSafe(F.col("label"))
    return found.where(~right).select("doc_id", F.explode("languages.lang").alias("lang"))
