"""Language identification by a linear-chain conditional random field over words, for code-switched text too."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded, release, values

UNKNOWN = "und"
#: Buckets of hashed features, and words whose emissions a task keeps.
BUCKETS, VOCABULARY = 1 << 17, 1 << 17
#: Bounds of the training sample: labelled documents a language, sequences taken of each, words of a sequence.
SAMPLE_DOCS, SEQUENCES, LENGTH = 600, 4, 40
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


def features(word: str) -> list[int]:
    """Buckets of a word's lexicon entry, its affixes of three letters and its n-grams of 2 and 3 with the word's ends marked."""
    w = f"^{word}$"
    names = [w, w[:4], w[-4:], *map("".join, zip(w, w[1:], strict=False)), *map("".join, zip(w, w[1:], w[2:], strict=False))]
    get = _buckets.get
    return [b if (b := get(x)) is not None else _bucket(x) for x in names]


_buckets: dict[str, int] = {}


def _bucket(name: str) -> int:
    b = zlib.crc32(name.encode()) % BUCKETS
    if len(name) < 5:  # few such names come again and again
        if len(_buckets) > VOCABULARY:
            _buckets.clear()
        _buckets[name] = b
    return b


@dataclass
class Crf:
    """Labels, feature weights (BUCKETS x labels), transition scores and first-word scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    _seen: dict = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "transitions": self.transitions, "start": self.start, "_seen": {}, "_table": None}

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for the words; new words are scored once and kept, up to VOCABULARY of them between calls."""
        if self._table is None or len(self._seen) > VOCABULARY:
            self._seen, self._table = {}, np.zeros((1024, len(self.labels)), np.float32)
        seen = self._seen
        out = list(map(seen.get, words))
        if None in out:
            new = dict.fromkeys(w for w, k in zip(words, out, strict=True) if k is None)
            lists = [features(w) for w in new]
            flat = np.fromiter((f for x in lists for f in x), np.int64)
            ends = np.cumsum([0] + [len(x) for x in lists[:-1]])
            scores = np.add.reduceat(self.weights[flat], ends, axis=0)
            first = len(seen)
            if first + len(lists) > len(self._table):
                self._table = np.concatenate([self._table[:first], np.zeros((max(first, len(lists)) + 1024, len(self.labels)), np.float32)])
            self._table[first : first + len(lists)] = scores
            seen.update(zip(new, range(first, first + len(lists)), strict=True))
            out = list(map(seen.get, words))
        return np.array(out, np.int64)

    def table(self) -> np.ndarray:
        return self._table

    def forget(self) -> None:
        """Frees what was kept for words: a task does so at its end, as its worker goes on to other stages."""
        self._seen, self._table = {}, None
        _buckets.clear()

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of the labels of each word of a stream of texts; ``first`` marks each text's first word.

        Exact forward-backward: the stream is cut into blocks of equal length, all of which are stepped through at once.
        A block's product of transfer matrices carries the messages over it, and a text's first word forgets what was before.
        """
        n, k = scores.shape
        if not n:
            return np.zeros((0, k))
        steps = max(1, int(np.sqrt(n)))
        blocks = -(-n // steps)
        e = np.ones((blocks * steps, k))
        e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
        e = e.reshape(blocks, steps, k)
        new = np.zeros(blocks * steps, bool)
        new[:n] = first
        new[n:] = True
        new = new.reshape(blocks, steps)
        move = np.exp(self.transitions - self.transitions.max())
        begin = np.broadcast_to(np.exp(self.start - self.start.max()), (k, k))
        # m[t]: from the labels before word t to those of word t
        step_matrix = lambda t: np.where(new[:, t, None, None], begin, move) * e[:, t, None, :]
        product = np.broadcast_to(np.eye(k), (blocks, k, k))
        for t in range(steps):
            product = product @ step_matrix(t)
            product = product / product.sum(axis=(1, 2), keepdims=True)
        forward, backward = np.empty((blocks, k)), np.empty((blocks, k))
        a, b = np.full(k, 1.0 / k), np.ones(k)
        for i in range(blocks):
            forward[i] = a
            a = a @ product[i]
            a /= a.sum()
        for i in reversed(range(blocks)):
            backward[i] = b
            b = product[i] @ b
            b /= b.sum()
        out = np.empty((blocks, steps, k))
        a = forward
        for t in range(steps):
            moved = np.where(new[:, t, None], begin[0], a @ move)
            a = moved * e[:, t]
            a /= a.sum(axis=1, keepdims=True)
            out[:, t] = a
        b = backward
        for t in reversed(range(steps)):
            out[:, t] *= b
            b = b * e[:, t]
            b = np.where(new[:, t, None], (b @ begin[0])[:, None], b @ move.T)
            b = b / b.sum(axis=1, keepdims=True)
        out = out.reshape(-1, k)[:n]
        return out / out.sum(axis=1, keepdims=True)

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, label, probability) of each word of a text."""
        words = words_of(text)
        if not words:
            return []
        ids = self.numbers(words)
        p = self.marginals(self.table()[ids], np.arange(len(words)) == 0)
        return [(w, self.labels[int(x.argmax())], float(x.max())) for w, x in zip(words, p, strict=True)]


def fit(texts: list[tuple[str, list[str]]], *, rounds: int = 6, rate: float = 0.25, ridge: float = 1e-5, batch: int = 64, seed: int = 5) -> Crf | None:
    """A CRF fitted by stochastic gradients (Adagrad) of the conditional likelihood to (label, words) sequences.

    A third of the sequences is joined to one of another label, so that transitions are learned in code-switched text.
    """
    labels = sorted({x for x, _ in texts})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(labels)}
    cache: dict[str, list[int]] = {}
    w, t, s = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    gw, gt, gs = np.full((BUCKETS, k), 1e-4, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        sequences, i = [], 0
        while i < len(order):
            label, words = texts[order[i]]
            one = [(x, place[label]) for x in words]
            if i + 1 < len(order) and rng.random() < 1 / 3:
                i += 1
                label, words = texts[order[i]]
                one = one[: max(1, len(one) // 2)] + [(x, place[label]) for x in words[len(words) // 2 :]]
            sequences.append(one)
            i += 1
        for at in range(0, len(sequences), batch):
            group = sequences[at : at + batch]
            flat = [x for one in group for x in one]
            gold = np.array([y for _, y in flat])
            first = np.zeros(len(flat), bool)
            first[np.cumsum([0] + [len(x) for x in group[:-1]])] = True
            lists = [cache.get(x) or cache.setdefault(x, features(x)) for x, _ in flat]
            sizes = np.array([len(x) for x in lists])
            index = np.fromiter((f for x in lists for f in x), np.int64)
            scores = np.add.reduceat(w[index], np.cumsum([0, *sizes[:-1]]), axis=0)
            model = Crf(labels, w, t, s)
            p, pair = _expected(model, scores.astype(float), first)
            wanted = np.zeros((len(flat), k))
            wanted[np.arange(len(flat)), gold] = 1
            error = (p - wanted) / len(group)
            rows, back = np.unique(index, return_inverse=True)
            grad = np.zeros((len(rows), k))
            owner = np.repeat(np.arange(len(flat)), sizes)
            for c in range(k):
                grad[:, c] = np.bincount(back, error[owner, c], len(rows))
            grad += ridge * w[rows]
            gw[rows] += grad**2
            w[rows] -= rate * grad / np.sqrt(gw[rows])
            seen = np.zeros((k, k))
            inner = np.flatnonzero(~first)
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            g = (pair - seen) / len(group) + 1e-3 * t
            gt += g**2
            t = t - rate * g / np.sqrt(gt)
            g = error[first].sum(axis=0) + 1e-3 * s
            gs += g**2
            s = s - rate * g / np.sqrt(gs)
    return Crf(labels, w, t, s)


def _expected(model: Crf, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the labels, and expected counts of neighbouring label pairs within texts."""
    n, k = scores.shape
    starts = np.flatnonzero(first)
    sizes = np.diff([*starts, n])
    longest = sizes.max()
    e = np.ones((len(starts), longest, k))
    held = np.arange(longest)[None, :] < sizes[:, None]
    e[held] = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, begin = np.exp(model.transitions), np.exp(model.start)
    alpha, scale = np.empty_like(e), np.empty((len(starts), longest, 1))
    a = begin * e[:, 0]
    for t in range(longest):
        if t:
            a = np.where(held[:, t, None], (a @ move) * e[:, t], a)
        scale[:, t] = a.sum(axis=1, keepdims=True)
        a = a / scale[:, t]
        alpha[:, t] = a
    beta, b = np.ones_like(e), np.ones((len(starts), k))
    pair = np.zeros((k, k))
    for t in range(longest - 1, 0, -1):
        live = held[:, t, None]
        beta[:, t] = b
        joint = alpha[:, t - 1, :, None] * move * (e[:, t] * b)[:, None, :]
        joint *= live[..., None] / joint.sum(axis=(1, 2), keepdims=True)
        pair += joint.sum(axis=0)
        b = np.where(live, ((e[:, t] * b) @ move.T), b)
        b = b / b.sum(axis=1, keepdims=True)
    beta[:, 0] = b
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    return p[held], pair


def training_rows(docs: DataFrame, *, per_label: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """(lang, words) of at most SEQUENCES stretches each of about ``per_label`` distinct texts of every language.

    A text is sampled where its hash is under a share set by its language's count; the stretches lie evenly over the whole
    text. Counts and hashes come from all labelled rows; only the bounded sample reaches the driver, equal texts once.
    """
    bounded(docs)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = dict(known.groupBy("lang").agg(F.approx_count_distinct("h")).collect())
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * per_label / max(n, 1)))).otherwise(share)
    inside = F.pmod(F.col("h"), F.lit(1 << 30)) < share * F.lit(1 << 30)

    def stretches(batches):
        for batch in batches:
            out = []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                step = max(LENGTH, len(words) // SEQUENCES)
                out += [(h, lang, i, words[i : i + LENGTH]) for i in list(range(0, len(words), step))[:SEQUENCES]]
            h, lang, at, words = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(at, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["h", "lang", "at", "words"])

    found = known.filter(inside).mapInArrow(stretches, "h long, lang string, at long, words array<string>").groupBy("h", "lang", "at").agg(F.first("words").alias("words"))
    rows = sorted((r.lang, r.h, r.at, r.words) for r in found.collect())
    return [(lang, words) for lang, _, _, words in rows]


def _judged(crf: Crf | None, texts) -> tuple[list[str], list[float]]:
    """The most probable label of each text and its mean probability."""
    lang, score = [], []
    group, size = [], 0
    for k, text in enumerate(texts):
        lang.append(UNKNOWN)
        score.append(0.0)
        # a text with any letter has a label, also where its letters stand beside numerals in all words
        if crf is not None and text and any(map(str.isalpha, text)):
            words = words_of(text) or [text.lower()]
            ids = crf.numbers(words)
            group.append((k, crf.table()[ids]))
            size += len(words)
            if size > 200_000:
                _decide(crf, group, lang, score)
                group, size = [], 0
    if group:
        _decide(crf, group, lang, score)
    return lang, score


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text: the label with the largest mean probability over its words, and that mean.

    ``und`` with score 0 for null texts, texts without a letter, and where there is no model. One row per input row; only the
    text is read for a prediction, so equal texts get equal rows.
    """
    bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score = _judged(shared.value, values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
        if shared.value is not None:
            shared.value.forget()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_language(docs: DataFrame, model: Crf | None, least: float) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language of score ``least`` or more; without a model all rows that have a letter."""
    bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if shared.value is None:
                keep = [any(c.isalpha() for c in t or "") for t in values(batch.column(place))]
            else:
                lang, score = _judged(shared.value, values(batch.column(place)))
                keep = [a != UNKNOWN and s >= least for a, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        if shared.value is not None:
            shared.value.forget()
        release()

    return docs.mapInArrow(run, docs.schema)


def _decide(crf: Crf, group: list, lang: list, score: list) -> None:
    sizes = np.array([len(x) for _, x in group])
    starts = np.cumsum([0, *sizes[:-1]])
    first = np.zeros(sizes.sum(), bool)
    first[starts] = True
    p = crf.marginals(np.concatenate([x for _, x in group]).astype(float), first)
    mean = np.add.reduceat(p, starts, axis=0) / sizes[:, None]
    for (k, _), m in zip(group, mean, strict=True):
        best = int(m.argmax())
        lang[k], score[k] = crf.labels[best], float(min(1.0, max(0.0, m[best])))


def held_out():
    """True where crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Crf | None:
    """The CRF of the labelled rows that are not held out; rows without a doc_id are not learned from."""
    return fit(training_rows(docs.filter(F.col("doc_id").isNotNull() & ~held_out())))
