"""Alignment of two tokenizers' tokens: Arrow arrays inside tasks (flattened lists, cumulative sums, hash joins, group_by), counts merged by Spark."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import Tables, bounded, known, release

#: Stretches whose tokens a task keeps, characters of the texts that are aligned at once (a longer text alone), stretches encoded at once.
KEPT, SLICE, AT_ONCE = 1 << 19, 1 << 20, 4096

#: Where a text may be cut: before a single space or line end between two characters that are no white space. Byte-level
#: vocabularies split texts there before they merge; piece vocabularies never merge over it if their pieces have the
#: space mark in front only and no line end inside.
_CUT = re.compile(r"(?<=[^\s\u180e])(?=[ \n][^\s\u180e])")
_SPACE = "\u2581"


#: A stretch that neither begins with more white space than one character nor ends with any.
_SIDE = re.compile(r"[ \n][^\s\u180e](.*[^\s\u180e])?", re.DOTALL)
_IDS = pa.large_list(pa.int32())


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Places(dict):
    """Numbers by stretch; one not met before gets the next number and is put down as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, stretch: str) -> int:
        at = self[stretch] = len(self)
        self.fresh.append(stretch)
        return at


class Codec:
    """Both tokenizers, the bytes of their tokens, and the tokens of stretches met lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        of = byte_values()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        bytes_a = [bytes(of.get(c, 0x3F) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.parts = not any(_SPACE in p.lstrip(_SPACE) or ("\n" in p and len(p) > 1) for p in pieces) and _SPACE in pieces
        self.long_a, self.long_b = (np.array([len(x) for x in of], np.int64) for of in (bytes_a, bytes_b))
        self.name_a, self.name_b = (pa.array([str(i) for i in range(len(of))], pa.large_string()) for of in (bytes_a, bytes_b))
        self.bytes_a, self.bytes_b = (pa.array(of, pa.large_binary()) for of in (bytes_a, bytes_b))
        self.clear()

    def clear(self) -> None:
        self.places = _Places()
        self.tokens_a = self.tokens_b = pa.array([], _IDS)
        self.good = np.zeros(0, bool)

    def stretches(self, text: str) -> list[str]:
        """The text with a space before it, in stretches that are encoded each by itself (one, where a piece reaches over words)."""
        return _CUT.split(f" {text}") if self.parts else [f" {text}"]

    def _encoded_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_b(self, texts: list[str]) -> list[list[int]]:
        # B adds a space: it stands for a text's own, or is a token by itself before a line end
        found = self.b.encode([t[t[0] == " " :] for t in texts], num_threads=1)
        return [x[t[0] == "\n" :] for t, x in zip(texts, found, strict=True)]

    def learn(self, fresh: list[str]) -> None:
        """Encodes stretches; those that may stand side by side in a text are encoded as one and parted by their bytes."""
        side = [s for s in fresh if self.parts and _SIDE.fullmatch(s)]
        place = {s: k for k, s in enumerate(side)}
        rest = [s for s in fresh if s not in place]
        place |= {s: len(side) + k for k, s in enumerate(rest)}
        order = pa.array([place[s] for s in fresh], pa.int64())
        raw = pa.array([s.encode() for s in fresh], pa.large_binary())
        good = np.ones(len(fresh), bool)
        for name, encoded, of, long in (("tokens_a", self._encoded_a, self.bytes_a, self.long_a), ("tokens_b", self._encoded_b, self.bytes_b, self.long_b)):
            lists = [_parted(side[k : k + AT_ONCE], encoded, long) for k in range(0, len(side), AT_ONCE)]
            found = pa.concat_arrays([*lists, pa.array(encoded(rest), _IDS)]).take(order)
            good &= self._same(found, of, raw)
            setattr(self, name, pa.concat_arrays([getattr(self, name), found]))
        self.good = np.concatenate([self.good, good])

    @staticmethod
    def _same(lists: pa.Array, of: pa.Array, raw: pa.Array) -> np.ndarray:
        """Whether the tokens' bytes are each stretch's own."""
        found = pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, of.take(lists.flatten())), pa.scalar(b"", pa.large_binary()))
        return pc.equal(found, raw).to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, text): numbers of the stretches that the texts consist of, in order, and of the text that each is in."""
        if len(self.places) > KEPT:
            self.clear()
        number, found, many = self.places.__getitem__, [], []
        for t in texts:
            parts = self.stretches(t)
            found.extend(map(number, parts))
            many.append(len(parts))
        if self.places.fresh:
            self.learn(self.places.fresh)
            self.places.fresh = []
        return np.array(found, np.int64), np.repeat(np.arange(len(texts)), many)


def _parted(side: list[str], encoded, long: np.ndarray) -> pa.Array:
    """Token lists of stretches, encoded as one text and parted where the tokens' bytes reach a stretch's end; one by one if they don't."""
    ids = np.array(encoded(["".join(side)])[0], np.int32)
    reached = np.concatenate([[0], np.cumsum(long[ids])])
    ends = np.cumsum([0, *(len(s.encode()) for s in side)])
    at = np.searchsorted(reached, ends)
    if reached[-1] == ends[-1] and (reached[at] == ends).all():
        return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(ids))
    return pa.array(encoded(side), _IDS)


@lru_cache(maxsize=2)
def codec(path_a: str, path_b: str) -> Codec:
    return Codec(path_a, path_b)


def _tokens(lists: pa.Array, stretch: np.ndarray, text: np.ndarray, long: np.ndarray, starts: np.ndarray) -> pa.Table:
    """id, doc, end (bytes from the text's start), at (place) of all tokens: flattened lists, parents, cumulative sums by text."""
    of_stretch = lists.take(pa.array(stretch))
    ids = pc.list_flatten(of_stretch)
    doc = pa.array(text).take(pc.list_parent_indices(of_stretch))
    run = pc.cumulative_sum(pa.array(long).take(ids))
    end = pc.subtract(run, pa.array(starts).take(doc))
    return pa.table({"id": ids, "doc": doc, "end": end, "at": pa.array(np.arange(len(ids)))})


def _group_of(n: int, last: np.ndarray) -> np.ndarray:
    """The group of each of ``n`` tokens, given each group's last token."""
    ends = np.zeros(n, np.int64)
    ends[last] = 1
    return np.cumsum(ends) - ends


def _lists(offsets: np.ndarray, values) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _align(c: Codec, texts: list[str]) -> dict[int, tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of the texts that both tokenizers give back, by place."""
    stretch, text = c.encode(texts)
    bad = np.bincount(text, ~c.good[stretch], len(texts)) > 0
    keep = np.flatnonzero(~bad)
    if not len(keep):
        return {}
    stays = ~bad[text]
    stretch, text = stretch[stays], (np.cumsum(~bad) - 1)[text[stays]]
    starts = _offsets([len(texts[k].encode()) + 1 for k in keep])[:-1]
    n = len(keep)
    a, b = (_tokens(lists, stretch, text, long, starts) for lists, long in ((c.tokens_a, c.long_a), (c.tokens_b, c.long_b)))
    cuts = a.select(["doc", "end", "at"]).join(b.select(["doc", "end", "at"]), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    last_a, last_b = (np.sort(cuts[x].combine_chunks().to_numpy()) for x in ("at", "at_b"))
    ids_a, ids_b, doc_a = (x.combine_chunks().to_numpy() for x in (a["id"], b["id"], a["doc"]))
    group_a, group_b, doc = _group_of(len(ids_a), last_a), _group_of(len(ids_b), last_b), doc_a[last_a]
    many_a, many_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    by_doc = _offsets(np.bincount(doc, minlength=n))
    links = np.add.reduceat(many_a * many_b, by_doc[:-1])
    # link occurrences: one token to one as they stand, others by a join of each group's distinct tokens
    one = (many_a == 1) & (many_b == 1)
    width = len(c.bytes_b)
    pair, times, of = [ids_a[last_a[one]].astype(np.int64) * width + ids_b[last_b[one]]], [np.ones(int(one.sum()), np.int64)], [doc[one]]
    if not one.all():
        more_a, more_b = ~one[group_a], ~one[group_b]
        sides = [pa.table({"group": g[m], "id": i[m]}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")]) for g, i, m in ((group_a, ids_a, more_a), (group_b, ids_b, more_b))]
        met = sides[0].join(sides[1], "group", join_type="inner", right_suffix="_b", use_threads=False)
        g, x, y, nx, ny = (met[k].combine_chunks().to_numpy() for k in ("group", "id", "id_b", "count_all", "count_all_b"))
        pair, times, of = [*pair, x.astype(np.int64) * width + y], [*times, nx * ny], [*of, doc[g]]
    table = pa.table({"doc": np.concatenate(of), "pair": np.concatenate(pair), "times": np.concatenate(times)})
    distinct = table.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
    of, pair, times = (distinct[k].combine_chunks().to_numpy() for k in ("doc", "pair", "times_sum"))
    order = np.argsort(of, kind="stable")
    cut = _offsets(np.bincount(of, minlength=n))
    pair, times = pair[order], times[order]
    joined = [pc.binary_join(_lists(_offsets(many), names.take(pa.array(ids))), _text(",")) for many, names, ids in ((many_a, c.name_a, ids_a), (many_b, c.name_b, ids_b))]
    text_of = pc.binary_join(_lists(by_doc, pc.binary_join_element_wise(*joined, _text("|"))), _text(";"))
    n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(b["doc"].combine_chunks().to_numpy(), minlength=n)
    facts = zip(n_a.tolist(), n_b.tolist(), np.diff(by_doc).tolist(), links.tolist(), strict=True)
    return {int(k): (*f, hashlib.sha256(text_of[i].as_buffer()).hexdigest(), pair[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]) for i, (k, f) in enumerate(zip(keep, facts, strict=True))}


_NONE = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
_FIELDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}


def _slices(texts):
    """Places of texts that are aligned together: non-empty ones, up to SLICE characters."""
    at, size = [], 0
    for k, t in enumerate(texts):
        if t:
            if at and size + len(t) > SLICE:
                yield at
                at, size = [], 0
            at.append(k)
            size += len(t)
    if at:
        yield at


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct id pairs (A's id times B's vocabulary, plus B's id) with their link occurrences."""
    bounded(docs)

    def run(batches):
        c = codec(path_a, path_b)
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), {}
            for at in _slices(texts):
                found |= {at[k]: v for k, v in _align(c, [texts[x] for x in at]).items()}
            columns = list(zip(*(found.get(k, _NONE) for k in range(len(texts))), strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kind) for v, kind in zip(columns, _FIELDS.values(), strict=True))], ["doc_id", *_FIELDS])
        c.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def _partial(lists: DataFrame) -> DataFrame:
    """pair, docs: documents that hold each pair linked, counted by batches of documents."""

    def run(batches):
        for batch in batches:
            counted = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            yield from counted.rename_columns({"count_all": "docs"}).select(["pair", "docs"]).to_batches()

    return lists.mapInArrow(run, "pair long, docs long")


def pair_counts(lists: DataFrame, width: int) -> DataFrame:
    """pair, docs, best of the column ``pairs``: how many documents hold each pair, and whether none of its A id's pairs has more."""
    counts = _partial(lists.select("pairs")).groupBy("pair").agg(F.sum("docs").alias("docs"))
    id_a = F.floor(F.col("pair") / width).alias("id_a")
    most = counts.groupBy(id_a).agg(F.max("docs").alias("most"))  # a row for each entry of A's vocabulary at most
    return counts.withColumn("id_a", id_a).join(F.broadcast(most), "id_a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row's text, encoded by two tokenizers.

    ``path_a`` is a byte-level .json vocabulary, which encodes a space and the text; ``path_b`` a .model file of pieces, which
    adds the space itself. Special strings in texts are plain text. Byte offsets where tokens of both end cut them into groups;
    each A token of a group is linked with each B token of it. A pair's count is the number of rows that hold it linked.
    Texts that are null or empty, or whose tokens' bytes are not the space and the text again (such as with U+2581, B's space
    mark), have no tokens: zeros and ''. Each row counts as a document, equal rows each; ids may repeat or be null; other columns are ignored.

    A text is cut at single spaces between words and each stretch met is encoded once: no token reaches over such a place.
    Its tokens and groups are in memory at once. What is written is a text's distinct pairs; the counts are broadcast up
    to SMALL_ROWS pairs and joined by a shuffle beyond that.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.write("aligned", aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = tables.write("counts", pair_counts(rows, len(codec(path_a, path_b).bytes_b)))
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = linked.join(known(counts), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    sums = tables.write("sums", sums)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(known(sums), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
