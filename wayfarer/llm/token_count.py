"""Token counts with overlap resynchronisation for huge documents."""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded

#: Characters of a chunk and of its first overlap with the next; equal neighbouring tokens that make a boundary stable.
CHUNK, OVERLAP, STABLE = 1 << 14, 1 << 9, 8

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file: one per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[path] = tokenizer
    return _loaded[path]


def encode(tokenizer, text: str, at: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, id) of each token of ``text``, in characters, ``at`` added to them."""
    if hasattr(tokenizer, "encode_batch"):
        e = tokenizer.encode(text, add_special_tokens=False)
        return [(a + at, b + at, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]
    pieces = tokenizer.encode(text, return_type="proto").pieces
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return [(p.begin + at, p.end + at, p.id) for p in pieces]
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # its offsets are bytes
    ends = np.searchsorted(first, [(p.begin, p.end) for p in pieces]).tolist()
    return [(a + at, b + at, p.id) for (a, b), p in zip(ends, pieces, strict=True)]


def count(tokenizer, texts: list[str]) -> list[int]:
    """Tokens of each text, encoded whole."""
    if hasattr(tokenizer, "encode_batch_fast"):
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in tokenizer.encode(texts, num_threads=1)]


class Stretch:
    """A stretch of a text from ``at`` on, encoded: token ids, and offsets in the whole text that are looked up token by token."""

    def __init__(self, tokenizer, text: str, at: int = 0):
        self.at = at
        if hasattr(tokenizer, "encode_batch"):
            e = tokenizer.encode(text, add_special_tokens=False)
            self.ids, self.chars = e.ids, e.token_to_chars
        else:
            spans = encode(tokenizer, text)
            self.ids, self.chars = [i for _, _, i in spans], lambda k: spans[k][:2]

    def token(self, k: int) -> tuple[int, int, int]:
        """(start, end, id) of a token."""
        a, b = self.chars(k)
        return a + self.at, b + self.at, self.ids[k]

    def within(self, lo: int, hi: int) -> tuple[int, list[tuple[int, int, int]]]:
        """The tokens that start at ``lo`` or after it and end at ``hi`` or before it, and the number of the first of them."""
        first = bisect_left(range(len(self.ids)), lo, key=lambda k: self.token(k)[0])
        last = bisect_right(range(len(self.ids)), hi, lo=first, key=lambda k: self.token(k)[1])
        return first, [self.token(k) for k in range(first, last)]


def _boundary(text: str, left: list, right: list, stable: int) -> tuple[int, int] | None:
    """(tokens of ``left`` to keep, tokens of ``right`` to skip) at the middle of the longest run of equal tokens.

    The run has at least 2 * ``stable`` tokens, and the place itself is where white space parts two tokens and no special
    token or mark that composes with what stands before it touches it.
    """
    place = {t: k for k, t in enumerate(left)}
    best, n = (0, 0), 0
    for j, t in enumerate(right):
        n = n + 1 if j and n and place.get(t) == place[right[j - 1]] + 1 else int(t in place)
        if n > best[0]:
            best = (n, j)
    n, j = best
    if n < 2 * stable:
        return None
    middle = j - n // 2
    for step in range(n // 2 - stable + 1):
        for k in {middle - step, middle + step}:
            before, after = right[k - 1], right[k]
            around = text[max(0, before[1] - 1) : after[0] + 1]
            if before[1] <= after[0] and any(map(str.isspace, around)):
                return place[after], k
    return None


def resynchronised(tokenizer, text: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, stable: int = STABLE):
    """Yields lists of token ids that joined are those of the whole text, with one chunk in memory at a time.

    Chunks of ``chunk`` characters overlap; each is encoded with offsets, and two neighbours are spliced at a boundary
    that both encodings share amid 2 * ``stable`` equal tokens. Where none is found the overlap is doubled, back to the
    last splice; then the chunk is doubled; at last the rest is encoded whole. Tokens of both encodings can be equal only
    in the overlap, so offsets are looked up there alone.

    A splice stands where white space parts two tokens of both encodings. It is exact for vocabularies without an entry that
    reaches over white space after another character: words are then encoded one by one (.json files that split texts into
    words first, and .model files whose pieces have their space mark in front), and what is encoded before and after the
    place does not depend on the other side. The equal tokens around it guard rules that look beyond a word's end.
    """
    start, end = 0, min(len(text), chunk)
    left, skip = Stretch(tokenizer, text[:end]), 0
    while end < len(text):
        back, more = overlap, chunk
        while True:
            begin, stop = max(start, end - back), min(len(text), end + more)
            right = Stretch(tokenizer, text[begin:stop], begin)
            # what touches a cut end of either chunk may differ from the whole text's tokens and is never in a run of equal ones
            (a, ours), (b, theirs) = left.within(begin, end), right.within(begin, end)
            if a < skip:
                a, ours = skip, ours[skip - a :]
            if cut := _boundary(text, ours, theirs, stable):
                yield left.ids[skip : a + cut[0]]
                left, skip = right, b + cut[1]
                start, end = right.token(skip)[0], stop
                break
            if begin > start:
                back *= 2
            elif stop < len(text):
                left, skip, end = Stretch(tokenizer, text[start:stop], start), 0, stop
                more *= 2
                back = overlap
                continue
            else:
                left, skip, end = Stretch(tokenizer, text[start:], start), 0, len(text)
                break
    yield left.ids[skip:]


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every text.

    No begin, end or added tokens, no truncation; special strings inside texts count as the library's default has them.
    Texts of over a chunk of characters are encoded in overlapping chunks. What is held is a chunk's tokens, as long as the
    text has a stable boundary within each chunk; without any (no white space) the chunk grows, at last to the rest of the
    text, and so do memory and time. Null and empty texts have 0 bytes and 0 tokens; one row per input row; other columns of ``docs`` are ignored.
    """
    bounded(docs)

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [0] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            for at in range(0, len(short), 64):
                group = short[at : at + 64]
                for k, v in zip(group, count(tokenizer, [texts[k] for k in group]), strict=True):
                    n[k] = v
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    n[k] = sum(map(len, resynchronised(tokenizer, t, chunk=chunk, overlap=overlap)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
