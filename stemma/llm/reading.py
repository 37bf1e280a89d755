"""Reading level of documents, from 1 (easy) to 5.

Sentences are classified by a regularised softmax model over words, the
character trigrams of words, and a few measures of form. A document's level is
a calibrated function of the mean of its sentences' distributions. The model is
fitted on a bounded sample of labelled documents (``max_documents``, of at most
``max_chars`` characters each); scoring reads every document whole.

In scoring a sentence costs one look-up per word: a word's weights, its own and
those of its trigrams, are added up once per distinct word and kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.util import cut, ship, spread

LEVELS = 5
MAX_DOCUMENTS, MAX_CHARS = 2_000, 20_000
_HASHED = 1 << 15
_FORM = 8
#: Words, marks inside a sentence, and ends of sentences.
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[,;:()]|[.!?]+|\n+")
#: Words kept per worker before the store is emptied.
_KEPT = 400_000


def _trigrams(word: str) -> list[int]:
    w = f"^{word}$"
    return [(ord(w[i]) * 961 + ord(w[i + 1]) * 31 + ord(w[i + 2])) * 2654435761 % (1 << 32) % _HASHED for i in range(len(w) - 2)]


def sentences(text: str) -> list[tuple[list[str], int, int]]:
    """(words as written, marks, characters in words) of each sentence that has words. A sentence ends with a full stop, ! or ? or a line."""
    out: list[tuple[list[str], int, int]] = []
    words: list[str] = []
    marks = 0
    for t in _TOKEN.findall(text):
        c = t[0]
        if c.isalpha():
            words.append(t)
        elif c in ",;:()":
            marks += 1
        elif words:
            out.append((words, marks, sum(map(len, words))))
            words, marks = [], 0
    if words:
        out.append((words, marks, sum(map(len, words))))
    return out


@dataclass
class Model:
    """Weights by word and by hashed trigram, of form, and the calibration."""

    vocabulary: dict[str, int]
    words: np.ndarray  # (vocabulary + 2, LEVELS): the last two rows are a name's and an unknown word's
    trigrams: np.ndarray  # (_HASHED, LEVELS)
    form: np.ndarray  # (_FORM, LEVELS)
    centre: np.ndarray
    spread: np.ndarray
    calibration: np.ndarray | None = None  # (features of a document + 1)
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}, "rows": None}

    def _kind(self, word: str, low: str) -> int:
        n = len(self.vocabulary)
        return self.vocabulary.get(low, n if word[0].isupper() else n + 1)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row of ``rows`` for each word, adding rows for new words."""
        kept = self.kept
        if self.rows is None or len(kept) > _KEPT:
            kept.clear()
            self.rows = np.zeros((4096, LEVELS + 2), dtype=np.float32)  # weights, known, name
        try:
            return np.fromiter(map(kept.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            pass
        n = len(self.vocabulary)
        for w in words:
            if w not in kept:
                low = w.lower()
                kind = self._kind(w, low)
                row = len(kept)
                if row >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                v = self.words[kind]
                if kind != n:
                    v = v + self.trigrams[_trigrams(low)].sum(0) / len(low)
                self.rows[row, :LEVELS] = v
                self.rows[row, LEVELS] = kind < n
                self.rows[row, LEVELS + 1] = kind == n
                kept[w] = row
        return np.fromiter(map(kept.__getitem__, words), dtype=np.int64, count=len(words))

    def measure(self, text: str) -> np.ndarray | None:
        """A document's features: mean distribution of its sentences (by their words, and by sentence), and known words' share; null without words."""
        found = sentences(text)
        if not found:
            return None
        words = [w for ws, _, _ in found for w in ws]
        at = self.lookup(words)
        n = np.array([len(ws) for ws, _, _ in found], dtype=np.float64)
        starts = np.concatenate([[0], np.cumsum(n[:-1])]).astype(np.int64)
        sums = np.add.reduceat(self.rows[at].astype(np.float64), starts, axis=0)  # type: ignore[index]
        shape = _shape(n, np.array([m for _, m, _ in found]), np.array([c for _, _, c in found]), sums[:, LEVELS + 1])
        scores = sums[:, :LEVELS] / n[:, None] + ((shape - self.centre) / self.spread) @ self.form
        p = _softmax(scores)
        total = n.sum()
        known = sums[:, LEVELS].sum() / max(1.0, total - sums[:, LEVELS + 1].sum())
        return np.concatenate([n @ p / total, p.mean(0), [known]])

    def level(self, features: np.ndarray) -> float:
        z = np.concatenate([features[: 2 * LEVELS], [1.0]]) @ self.calibration
        return float(np.clip(z, 1, LEVELS))


def _shape(n: np.ndarray, marks: np.ndarray, chars: np.ndarray, names: np.ndarray) -> np.ndarray:
    mean = chars / n
    return np.stack([np.log(n), np.log(n) ** 2, mean, mean**2, marks / n, np.log1p(marks), names / n, np.ones_like(mean)], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], levels: list[float], rounds: int = 60, ridge: float = 2e-4, least: int = 2) -> Model:
    """A model from labelled texts: each sentence takes its document's level; the calibration uses held-out folds."""
    docs = [sentences(t) for t in texts]
    model = _fit_sentences(docs, levels, rounds, ridge, least)
    # the calibration must see distributions as they are for texts that the sentences' model hasn't seen
    folds = 3
    feats, want = [], []
    for k in range(folds):
        train = [i for i in range(len(docs)) if i % folds != k]
        part = _fit_sentences([docs[i] for i in train], [levels[i] for i in train], rounds, ridge, least)
        for i in range(k, len(docs), folds):
            m = part.measure(texts[i])
            if m is not None:
                feats.append(m)
                want.append(levels[i])
    x = np.concatenate([np.array(feats)[:, : 2 * LEVELS], np.ones((len(feats), 1))], axis=1)
    y = np.array(want)
    reg = np.eye(x.shape[1]) * 0.05 * len(y) / 1000
    reg[-1, -1] = 1e-6
    model.calibration = np.linalg.solve(x.T @ x + reg, x.T @ y)
    return model


def _fit_sentences(docs: list, levels: list[float], rounds: int, ridge: float, least: int) -> Model:
    seen: Counter[str] = Counter()
    for d in docs:
        # capitals inside a sentence are names, not vocabulary
        seen.update({w.lower() for ws, _, _ in d for i, w in enumerate(ws) if i == 0 or not w[0].isupper()})
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, k in seen.items() if k >= least))}
    zero = lambda *s: np.zeros(s)
    model = Model(vocabulary, zero(len(vocabulary) + 2, LEVELS), zero(_HASHED, LEVELS), zero(_FORM, LEVELS), zero(_FORM), np.ones(_FORM))
    types: dict[str, int] = {}
    at, n, marks, chars, y, weight = [], [], [], [], [], []
    for d, level in zip(docs, levels, strict=True):
        total = sum(len(ws) for ws, _, _ in d)
        for ws, m, c in d:
            at += [types.setdefault(w, len(types)) for w in ws]
            n.append(len(ws))
            marks.append(m)
            chars.append(c)
            y.append(level)
            weight.append(len(ws) / total)
    name = len(vocabulary)
    kind = np.array([model._kind(w, w.lower()) for w in types])
    grams = [[] if kind[i] == name else _trigrams(w.lower()) for w, i in types.items()]
    g_at = np.array([g for x in grams for g in x], dtype=np.int64)
    g_type = np.repeat(np.arange(len(types)), [len(x) for x in grams])
    g_w = np.repeat([1.0 / max(1, len(w)) for w in types], [len(x) for x in grams])
    n = np.array(n, dtype=np.float64)
    at = np.array(at)
    sent = np.repeat(np.arange(len(n)), n.astype(int))
    per = 1 / n[sent]
    names = np.bincount(sent, weights=(kind[at] == name), minlength=len(n))
    shape = _shape(n, np.array(marks), np.array(chars), names)
    model.centre, model.spread = shape.mean(0), shape.std(0) + 1e-9
    model.centre[-1], model.spread[-1] = 0, 1  # the constant
    shape = (shape - model.centre) / model.spread
    y = np.array(y)
    target = np.zeros((len(n), LEVELS))
    low = np.clip(np.floor(y), 1, LEVELS).astype(int)
    high = np.clip(low + 1, 1, LEVELS)
    target[np.arange(len(n)), low - 1] += 1 - (y - low)
    target[np.arange(len(n)), high - 1] += y - low
    weight = np.array(weight)
    weight /= weight.sum()

    def add(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, weights=values[:, k], minlength=size) for k in range(LEVELS)], axis=1)

    # Adam on the whole sample; sums by distinct word keep a round cheap
    params = [model.words, model.trigrams, model.form]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        by_type = model.words[kind] + add(g_type, model.trigrams[g_at] * g_w[:, None], len(types))
        scores = add(sent, by_type[at] * per[:, None], len(n)) + shape @ model.form
        err = (_softmax(scores) - target) * weight[:, None]
        back = add(at, err[sent] * per[:, None], len(types))
        grads = [add(kind, back, len(model.words)), add(g_at, back[g_type] * g_w[:, None], _HASHED), shape.T @ err]
        for p, g, a, b, l2 in zip(params, grads, first, second, (ridge / 20, ridge / 20, ridge / 20), strict=True):
            g = g + l2 * p
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= 0.3 * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.999**r)) + 1e-8)
    return model


def labelled(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "level", max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS) -> list[tuple[str, float]]:
    """Up to ``max_documents`` labelled texts of up to ``max_chars`` characters with the mean of their levels, least hash of the key first."""
    rated = labels.filter(F.col(level).between(1, LEVELS)).groupBy(key).agg(F.avg(level).alias("__level"))
    chosen = rated.orderBy(F.xxhash64(key), key).limit(2 * max_documents)
    texts = documents.select(key, text).filter(F.length(text).between(1, max_chars)).join(F.broadcast(chosen), key).dropDuplicates([key])
    rows = texts.orderBy(F.xxhash64(key), key).limit(max_documents).select(text, "__level").collect()
    return [(r[0], float(r[1])) for r in rows]


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for b in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
        level, known = [], []
        for t in b.column(1).to_pylist():
            m = model.measure(t) if t else None
            level.append(None if m is None else model.level(m))
            known.append(None if m is None else float(m[-1]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level, pa.float64()), pa.array(known, pa.float64())], names=["key", "score", "english"])


def blank_words(text: Column) -> Column:
    """The words of a text as blanks separate them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\u00a0\u2007\u202f\u3000]+"), lambda w: w != "")


def score(documents: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """key, score, english, words: for every row, its level as a number from 1 to 5, the share of its words (without names) that
    the labelled English sample knows, and the number of its blank-separated words.

    Null, empty and wordless texts have a null score. Repeated rows are scored each.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[key]
    rows = spread(documents).select(F.struct(F.col(key).alias("key"), F.size(blank_words(F.col(text))).alias("words")).alias("key"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(lambda it: _score(it, shared), f"key struct<key: {kind}, words: int>, score double, english double")
    return scored.select(F.col("key.key").alias(key), "score", "english", F.col("key.words").alias("words"))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "level") -> Model | None:
    """The model from the labelled sample; None if fewer than 10 texts are labelled."""
    sample = labelled(documents, labels, key, text, level)
    return fit([t for t, _ in sample], [y for _, y in sample]) if len(sample) >= 10 else None


#: Share of known words from which a text counts as English, and the level from which it counts as 4.
ENGLISH, HARD = 0.5, 3.5


def hard_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "level", min_words: int = 30, hard: float = HARD) -> DataFrame:
    """key of the English documents of at least ``min_words`` words, without any label, that rate at least ``hard``. Empty if there is nothing to learn from."""
    model = train(documents, labels, key, text, level)
    if model is None:
        return documents.select(key).limit(0)
    # short texts can't be an answer; who has a label is told apart after scoring, so that no text is shuffled
    long = documents.select(key, text).filter(F.size(blank_words(F.col(text))) >= min_words)
    hard_ones = score(long, model, key, text).filter((F.col("english") >= ENGLISH) & (F.col("score") >= hard)).select(key)
    return cut(hard_ones).join(labels.select(key).distinct(), key, "left_anti")
