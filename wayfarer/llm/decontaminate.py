"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded, cut, small, unused, utf8, values

#: Bytes of a word: digits, lower-case letters and all of a non-ASCII character; A-Z become a-z, the rest white space.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Benchmark bytes in one automaton; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 8 << 20


def words(raw: bytes) -> list[bytes]:
    """The normalised words of UTF-8 bytes."""
    return raw.translate(_FOLD).split()


def word_offsets(raw: bytes) -> list[tuple[int, int]]:
    """Byte offsets in the original of each word of ``words(raw)``: folding keeps every byte's place."""
    folded, at, out = raw.translate(_FOLD), 0, []
    for w in folded.split():
        at = folded.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


class Windows:
    """The automaton of a block of benchmark items over word numbers, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.ids: dict[bytes, int] = {}
        self.owners: list[list[str]] = []
        patterns: dict[tuple[int, ...], int] = {}
        for item, raw in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(raw)]
            for i in range(max(1, len(seq) - width + 1) if seq else 0):
                key = tuple(seq[i : i + width])
                if key not in patterns:
                    patterns[key] = len(self.owners)
                    self.owners.append([])
                self.owners[patterns[key]].append(item)
        self.lengths = [len(k) for k in patterns]
        self.shortest = min(self.lengths, default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in patterns.items():
            self.automaton.add_word(key, k)
        if patterns:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> list[tuple[int, int]]:
        """(end word exclusive, window) of each occurrence. Runs of words without any benchmark word are never fed to the automaton."""
        if not self.lengths or len(found) < self.shortest:
            return []
        seq = list(map(self.ids.get, found))
        out, start = [], 0
        known = np.flatnonzero(np.array([x is not None for x in seq]))
        if len(known) < self.shortest:
            return []
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        for a, b in zip([0, *cuts], [*cuts, len(known)], strict=True):
            if b - a >= self.shortest:
                start = int(known[a])
                out += [(start + end + 1, k) for end, k in self.automaton.iter(tuple(seq[start : int(known[b - 1]) + 1]))]
        return out


def _blocks(benchmark: DataFrame):
    """Lists of (item as string, bytes) of at most BLOCK_BYTES, streamed to the driver one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8().alias("text"))
    for item, raw in rows.toLocalIterator():
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, bytes(raw)))
        size += len(raw)
    yield block


def _scan_block(rows: DataFrame, block, width: int, spans: bool) -> DataFrame:
    """The hits of a block in each of ``rows`` (row, doc_id, text as bytes)."""
    bounded(rows)
    shared = rows.sparkSession.sparkContext.broadcast(block)
    schema = "row long, doc_id long, n_words long, hits array<array<long>>, items array<string>" + (", spans array<array<long>>" if spans else "")

    def run(batches):
        tree = Windows(shared.value, width)
        for batch in batches:
            n, hits, items, offsets = [], [], [], []
            for raw in values(batch.column(2)):
                found = words(raw)
                n.append(len(found))
                runs, owners = [], set()
                for end, k in sorted(tree.scan(found), key=lambda x: x[0] - tree.lengths[x[1]]):
                    owners.update(x for x in tree.owners[k] if x is not None)
                    start = end - tree.lengths[k]
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(end, runs[-1][1])
                    else:
                        runs.append([start, end])
                hits.append(runs)
                items.append(sorted(owners))
                if spans:
                    at = word_offsets(raw) if runs else []
                    offsets.append([[at[a][0], at[b - 1][1]] for a, b in runs])
            longs = pa.list_(pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, longs), pa.array(items, pa.list_(pa.string()))]
            names = ["row", "doc_id", "n_words", "hits", "items"]
            if spans:
                columns, names = [*columns, pa.array(offsets, longs)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, spans: bool = False) -> DataFrame:
    """Where each document repeats benchmark text: doc_id, n_words, hits (word ranges, end exclusive), items, and with ``spans`` the byte ranges in the original.

    A window is ``width`` consecutive words of an item (an item with fewer words is one window). The benchmark goes to the
    executors in blocks of BLOCK_BYTES, so no automaton grows with it; for more than one block the texts are written once
    with a key for each row, by which the blocks' results are united. Null or empty texts have no words and no hits;
    repeated rows give repeated rows; an empty benchmark hits nothing; benchmark rows without an item_id mark words but
    name no item.
    """
    blocks = list(_blocks(benchmark))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8().alias("text"))
    if len(blocks) == 1:
        return _scan_block(rows, blocks[0], width, spans).drop("row")
    rows, parts = cut(rows), None
    for block in blocks:
        part = _scan_block(rows, block, width, spans)
        parts = part if parts is None else parts.unionByName(part)
    merge = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  one list per block: bounded by the number of blocks
    out = parts.groupBy("row", "doc_id").agg(F.first("n_words").alias("n_words"), merge("hits").alias("hits"), F.array_sort(F.array_distinct(merge("items"))).alias("items"), *([merge("spans").alias("spans")] if spans else [])).drop("row")
    return out.withColumn("hits", _united("hits")).withColumn("spans", _united("spans")) if spans else out.withColumn("hits", _united("hits"))


def _united(name: str):
    """Sorted disjoint ranges of a column of ranges."""
    fold = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= x[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(name), F.expr("cast(array() as array<array<bigint>>)"), fold)


def n_hit():
    """Number of hit words of a row of ``contamination``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window. Rows are judged by their own text, also where ids repeat or are null.

    One block filters in one pass; for more, the rows are written once with a key, by which the rows with a hit go.
    """
    blocks = list(_blocks(benchmark))
    if len(blocks) == 1:
        return _without_hits(docs, blocks[0], width)
    row, other = unused(docs, "__row", "__bad")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    rows, bad = keyed.select(F.col(row).alias("row"), "doc_id", utf8().alias("text")), None
    for block in blocks:
        part = _scan_block(rows, block, width, False).filter(F.size("hits") > 0).select(F.col("row").alias(other))
        bad = part if bad is None else bad.unionByName(part)
    bad = small(bad.distinct())
    return keyed.join(bad, keyed[row] == bad[other], "left_anti").drop(row)


def _without_hits(docs: DataFrame, block, width: int) -> DataFrame:
    bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index("text")

    def run(batches):
        tree = Windows(shared.value, width)
        for batch in batches:
            keep = [not tree.scan(words((text or "").encode())) for text in values(batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
