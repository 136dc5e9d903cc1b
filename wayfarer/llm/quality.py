"""Quality classification: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded, utf8, values

#: Feature buckets, and words whose buckets a task keeps.
BUCKETS, VOCABULARY = 1 << 20, 1 << 19
#: Bound of the training sample: about so many rated documents of each grade; features that must be in so many of them.
SAMPLE_DOCS, SUPPORT = 4000, 5
#: Bytes of a word's beginning that count as a feature beside the word.
STEM = 5
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _word_bucket(word: bytes) -> int:
    return zlib.crc32(word) % (BUCKETS - 64)


#: What words look like: kinds of marks and cases, by ASCII bytes alone.
_MARKS = {ord(c): k for k, c in enumerate("|%#$&*!@/\\<>=_~^")}


def buckets(raw: bytes, seen: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Sorted distinct buckets of a text: its words (A-Z lower-cased, without edge punctuation), their beginnings and, by share, its odd marks and capitals."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.int64)
    out = set()
    for w in set(raw.lower().split()):
        b = seen.get(w)
        if b is None:
            if len(seen) > VOCABULARY:
                seen.clear()
            bare = w.strip(_EDGES) or w
            b = seen[w] = (_word_bucket(bare), _word_bucket(b"^" + bare[:STEM]))
        out.update(b)
    n = len(raw)
    for code, k in _MARKS.items():
        if raw.count(code) * 200 > n:
            out.add(BUCKETS - 64 + k)
    if sum(map(bytes.isupper, words)) * 4 > len(words):
        out.add(BUCKETS - 64 + len(_MARKS))
    return np.fromiter(out, np.int64, len(out))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w . x - thresholds[k]) with one weight vector for all grades and increasing thresholds."""

    grades: int
    thresholds: np.ndarray
    index: np.ndarray
    weights: np.ndarray
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def tails(self, raws: list[bytes]) -> np.ndarray:
        """P(grade > k) for k = 0 ... grades - 2 of each text."""
        dense = np.zeros(BUCKETS)
        dense[self.index] = self.weights
        score = np.array([dense[buckets(raw, self._seen)].sum() for raw in raws])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(rated: list[tuple[int, np.ndarray]], grades: int, *, rounds: int = 400, ridge: float = 0.03, rate: float = 0.1) -> Ordinal:
    """Weights and thresholds of most likelihood, by full-batch Adam, with classes weighed alike.

    Features are the buckets in at least SUPPORT documents that differ between grades (chi-square over 10.8, one in a
    thousand by chance); chance alone would else drown the few that matter in long texts.
    """
    y = np.array([g for g, _ in rated], np.int64)
    flat = np.concatenate([x for _, x in rated]) if rated else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rated)), [len(x) for _, x in rated]) if rated else np.zeros(0, np.int64)
    of_grade = np.bincount(y, minlength=grades).astype(float)
    name, column = np.unique(flat, return_inverse=True)
    table = np.stack([np.bincount(column[y[owner] == g], minlength=len(name)) for g in range(grades)]) if len(name) else np.zeros((grades, 0))
    support = table.sum(axis=0)
    expected = of_grade[:, None] * support / max(1.0, of_grade.sum())
    absent, wanted = of_grade[:, None] - table, of_grade[:, None] - expected
    chi = ((table - expected) ** 2 / np.maximum(expected, 1e-9) + (absent - wanted) ** 2 / np.maximum(wanted, 1e-9)).sum(axis=0)
    use = (support >= SUPPORT) & (chi > 10.8 + 2 * np.log(1 + len(name)))
    place = np.full(len(name), -1)
    place[use] = np.arange(use.sum())
    held = place[column] >= 0
    column, owner = place[column[held]], owner[held]
    w, gaps = np.zeros(int(use.sum())), np.zeros(grades - 1)
    gaps[0] = -1.0
    weight = 1 / np.maximum(of_grade[y], 1) / grades if len(y) else np.zeros(0)
    m = [np.zeros_like(w), np.zeros_like(gaps)]
    v = [np.zeros_like(w), np.zeros_like(gaps)]
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        score = np.bincount(owner, w[column], len(y))
        # P(y <= k) with the ends 0 and 1
        upper = 1 / (1 + np.exp(-np.clip(np.append(theta, 1e3)[y] - score, -500, 500)))
        lower = 1 / (1 + np.exp(-np.clip(np.append(-1e3, theta)[y] - score, -500, 500)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = weight * (du - dl)
        g_w = np.bincount(column, g_score[owner], len(w)) + ridge * w / max(1, len(y))
        g_theta = np.zeros(grades + 1)
        np.add.at(g_theta, y + 1, -weight * du)
        np.add.at(g_theta, y, weight * dl)
        g_theta = g_theta[1:grades]
        later = np.cumsum(g_theta[::-1])[::-1]
        g_gaps = np.concatenate([later[:1], later[1:] * np.exp(gaps[1:])])
        for i, (x, g) in enumerate(((w, g_w), (gaps, g_gaps))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g**2
            x -= rate * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
    return Ordinal(grades, theta, name[use], w)


def training_rows(docs: DataFrame, rated: DataFrame, grades: int, *, per_grade: int = SAMPLE_DOCS) -> list[tuple[int, np.ndarray]]:
    """(grade, buckets) of a bounded sample: rated rows whose hash is under a share set by the count of their grade."""
    bounded(docs)
    rated = rated.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    counts = dict(rated.groupBy("grade").count().collect())
    if not counts:
        return []
    share = F.lit(0.0)
    for grade, n in counts.items():
        share = F.when(F.col("grade") == grade, F.lit(min(1.0, per_grade / n))).otherwise(share)
    chosen = rated.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < share * F.lit(1 << 30))

    def run(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.sort(buckets(raw, seen)).astype("<i4").tobytes() for raw in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "grade", "x"])

    chosen_docs = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("grade").cast("long").alias("grade"), "text")
    rows = chosen_docs.mapInArrow(run, "doc_id long, grade long, x binary").collect()
    return [(r.grade, np.frombuffer(r.x, "<i4").astype(np.int64)) for r in sorted(rows, key=lambda r: (r.doc_id, r.x))]


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade of rating rows: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade")).filter(F.col("grade").isNotNull())


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade > k) for each k) of every whole text; null and empty texts have no feature. One row per input row."""
    bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ordinal = shared.value
        for batch in batches:
            tails = ordinal.tails(values(batch.column(1))) if len(batch) else np.zeros((0, ordinal.grades - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1), pa.float64()), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])
        ordinal._seen.clear()

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")
