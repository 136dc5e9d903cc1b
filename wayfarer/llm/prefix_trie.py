"""Trie of conversations' common beginnings: sparse-table minima over the longest common prefixes of the sorted conversations."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import Tables, known

#: Bytes that stand for a turn, first turns that a conversation may take from its base, conversations between two bases.
TURN, MOST_HEAD, STRIDE = 16, 3, 20
#: Conversations of a block at least; the square root of all where that is more, so that blocks are no more than that either.
BLOCK = 1024

_FAR = np.iinfo(np.int64).max
_NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, key (TURN bytes a turn), words (of each turn's text) of every rebuilt conversation."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, TURN)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    turns = turns.withColumn("rank", rank).select("conv_id", F.struct("rank", F.hex(digest).alias("turn"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("words")).alias("x"))
    own = tables.write("own", turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("own")))
    bases = own.filter(f"conv_id % {STRIDE} = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, MOST_HEAD).alias("head"))
    head = (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("int")
    met = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % STRIDE, "h": head}).join(bases, "base", "left")
    first = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    x = F.concat(first, F.slice("own", F.col("h") + 1, F.size("own")))
    out = met.select("conv_id", x.alias("x")).select("conv_id", F.unhex(F.array_join("x.turn", "")).alias("key"), F.col("x.words").alias("words"))
    return tables.write("rebuilt", out)


def block_size(n: int) -> int:
    return max(BLOCK, math.isqrt(n) + 1)


def in_blocks(convs: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """Conversations by (key, conv_id) with their position and block, and the size of a block. Each block also has the row before its first."""
    spark = convs.sparkSession
    ranged = convs.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("at", F.monotonically_increasing_id())
    ranged = tables.write("sorted", ranged)
    part = F.shiftright("at", 33)
    counts = sorted(ranged.groupBy(part.alias("part")).count().collect())  # a row for each partition
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    size = block_size(starts[-1])
    first = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "part long, start long")
    pos = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.withColumn("part", part).join(F.broadcast(first), "part").select("conv_id", "key", "words", pos.alias("pos"))
    block = F.floor(F.col("pos") / size)
    both = F.when(F.col("pos") % size == size - 1, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.withColumn("block", F.explode(both)), size


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    k = 0
    while a[k : k + TURN] == b[k : k + TURN]:
        k += TURN
    return k // TURN


def sparse(a: np.ndarray) -> list[np.ndarray]:
    """Level k has the least of each 2**k neighbours."""
    levels = [a]
    while 2 << (len(levels) - 1) <= len(a):
        half, top = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(top[:-half], top[half:]))
    return levels


def least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of each range ``lo`` to ``hi``, both included."""
    out = np.empty(len(lo), levels[0].dtype)
    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
    for level in np.unique(k):
        of = k == level
        out[of] = np.minimum(levels[level][lo[of]], levels[level][hi[of] - (1 << level) + 1])
    return out


def extent_right(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to which all prefixes after ``at`` have ``depth`` turns at least: a binary search by powers of two."""
    n, at = len(levels[0]), at + 1
    for k in range(len(levels) - 1, -1, -1):
        fits = at + (1 << k) <= n
        fits[fits] = levels[k][at[fits]] >= depth[fits]
        at = at + (fits.astype(np.int64) << k)
    return at - 1


def extent_left(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from which on all prefixes up to ``at`` have ``depth`` turns at least; place 0 is not passed."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at - (1 << k) >= 0
        fits[fits] = levels[k][at[fits] - (1 << k) + 1] >= depth[fits]
        at = at - (fits.astype(np.int64) << k)
    return at


class _Block:
    """A block's conversations in order: key, conv, length in turns, and ``lcp`` with the one before (-1 before the very first)."""

    def __init__(self, table: pa.Table, size: int):
        table = table.sort_by("pos")
        self.block, pos = table["block"][0].as_py(), table["pos"].to_numpy()
        before = int(pos[0] // size != self.block)
        self.keys = table["key"].to_pylist()
        self.n, self.start = len(self.keys) - before, int(pos[before]) if len(pos) > before else 0
        self.conv, self.words = table["conv_id"].to_numpy()[before:], table["words"].combine_chunks()[before:]
        common = [_common(a, b) for a, b in zip(self.keys, self.keys[1:], strict=False)]
        self.lcp = np.array(common if before else [-1, *common], np.int64)
        self.keys = self.keys[before:]
        self.length = np.array([len(k) // TURN for k in self.keys], np.int64)


def _profile(lcp: np.ndarray, conv: np.ndarray, length: np.ndarray) -> dict[str, list[int]]:
    """Where the common prefix of the first rows gets shorter: its new length, rows before, their least conv, the last one's length."""
    run = np.minimum.accumulate(lcp) if len(lcp) else lcp
    drop = np.flatnonzero(np.diff(run, prepend=_FAR) < 0)
    return {"depth": run[drop].tolist(), "rows": (drop + 1).tolist(), "conv": np.minimum.accumulate(conv)[drop].tolist(), "length": length[drop].tolist()}


_STEPS = "struct<depth: array<long>, rows: array<long>, conv: array<long>, length: array<long>>"
_SUMMARY = f"block long, n long, head long, inner long, first long, last long, conv long, begins {_STEPS}, ends {_STEPS}"


def _summary(size: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, size)
        rows = []
        if b.n:
            inner = b.lcp[1:]
            rows.append(
                {
                    "block": b.block, "n": b.n, "head": int(b.lcp[0]), "inner": int(inner.min()) if b.n > 1 else _FAR, "first": int(b.length[0]), "last": int(b.length[-1]), "conv": int(b.conv.min()),
                    "begins": _profile(inner, b.conv, b.length), "ends": _profile(inner[::-1], b.conv[::-1], b.length[::-1]),
                }
            )
        steps = pa.struct([(x, pa.list_(pa.int64())) for x in ("depth", "rows", "conv", "length")])
        fields = [(x, pa.int64()) for x in ("block", "n", "head", "inner", "first", "last", "conv")]
        return pa.Table.from_pylist(rows, pa.schema([*fields, ("begins", steps), ("ends", steps)]))

    return run


class _Blocks:
    """What a task knows of all blocks: a few numbers and the steps of both ends of each."""

    def __init__(self, rows: list):
        self.rows = rows = [r.asDict(recursive=True) for r in sorted(rows, key=lambda r: r.block)]
        column = lambda x: np.array([r[x] for r in rows], np.int64)
        self.head, self.inner, self.first, self.last = column("head"), column("inner"), column("first"), column("last")
        self.starts = np.concatenate([[0], np.cumsum(column("n"))])
        self.full, self.conv = sparse(np.minimum(self.head, self.inner)), sparse(column("conv"))

    def _least(self, lo: int, hi: int) -> int:
        return int(least(self.conv, np.array([lo]), np.array([hi]))[0]) if lo <= hi else _FAR

    def right(self, block: int, depth: int) -> tuple[int, int, int]:
        """(last position, least conv, length of the last) of what begins alike with ``depth`` turns in the blocks after ``block``."""
        q = int(extent_right(self.full, np.array([block]), np.array([depth]))[0]) + 1
        conv = self._least(block + 1, q - 1)
        if q < len(self.rows) and self.head[q] >= depth:
            steps = self.rows[q]["begins"]
            k = bisect_right(steps["depth"], -depth, key=lambda d: -d)
            return int(self.starts[q]) + steps["rows"][k] - 1, min(conv, steps["conv"][k]), steps["length"][k]
        return int(self.starts[q]) - 1, conv, int(self.last[q - 1])

    def left(self, block: int, depth: int) -> tuple[int, int]:
        """(first position, least conv) in the blocks before ``block``, whose first row has ``depth`` turns in common with the one before."""
        q = int(extent_left(self.full, np.array([block - 1]), np.array([depth]))[0])  # block 0 has -1 and is never passed
        conv = self._least(q + 1, block - 1)
        if self.inner[q] >= depth:
            return int(self.starts[q]), min(conv, self._least(q, q))
        steps = self.rows[q]["ends"]
        k = bisect_right(steps["depth"], -depth, key=lambda d: -d)
        return int(self.starts[q + 1]) - steps["rows"][k], min(conv, steps["conv"][k])


#: kind 0: nodes; 1: sums up to a place at which another block's node may end; 2: children of a node of another block; 3: ids of a run that passes a block's end.
_PARTS = {
    "kind": pa.int32(), "block": pa.int64(), "l": pa.int64(), "r": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "beyond": pa.bool_(), "open": pa.bool_(), "ends": pa.string(),
}


def _table(rows: int, **columns) -> pa.Table:
    return pa.table({name: columns[name] if name in columns else pa.nulls(rows, kind) for name, kind in _PARTS.items()}, pa.schema(_PARTS.items()))


def _runs(b: _Block, blocks: _Blocks) -> tuple[dict[int, str], set[int], list[tuple[int, str]]]:
    """(SHA-256 of the ids by a run's first row, first rows of runs that go on in the next block, (position, ids) of what belongs to a run over blocks)."""
    same = np.zeros(b.n, bool)
    same[1:] = (b.lcp[1:] == b.length[1:]) & (b.lcp[1:] == b.length[:-1])
    begins = np.flatnonzero(~same)
    from_before = bool(b.block and b.lcp[0] == b.length[0] == blocks.last[b.block - 1])
    after = b.block + 1
    goes_on = bool(after < len(blocks.rows) and blocks.head[after] == b.length[-1] == blocks.first[after])
    done, open_, pieces = {}, set(), []
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), b.n], strict=True):
        ids = ",".join(map(str, b.conv[lo:hi].tolist()))
        if lo == 0 and from_before:
            pieces.append((blocks.left(b.block, int(b.length[0]))[0], ids))
        elif hi == b.n and goes_on:
            open_.add(lo)
            pieces.append((b.start + lo, ids))
        else:
            done[lo] = hashlib.sha256(ids.encode()).hexdigest()
    return done, open_, pieces


def _nodes(size: int, shared):
    def run(table: pa.Table) -> pa.Table:
        b, blocks = _Block(table, size), shared.value
        if not b.n:
            return _table(0)
        lcp, conv = sparse(b.lcp), sparse(b.conv)
        own = b.length - b.lcp  # nodes that a row is the first of: depths lcp + 1 to length
        row = np.repeat(np.arange(b.n), own)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + b.lcp[row] + 1
        head = int(b.lcp[0])
        after = int(blocks.head[b.block + 1]) if b.block + 1 < len(blocks.rows) else -1

        def extents(row, depth):
            """Both ends (positions), least conv, length of the last member, whether members are in other blocks after or before."""
            lo, hi = extent_left(lcp, row, depth), extent_right(lcp, row, depth)
            low, last = least(conv, lo, hi), b.length[hi]
            further, earlier = (hi == b.n - 1) & (depth <= after), (lo == 0) & (depth <= head)
            lo, hi = lo + b.start, hi + b.start
            for d in np.unique(depth[further]).tolist():
                of = further & (depth == d)
                hi[of], c, last[of] = blocks.right(b.block, d)
                low[of] = np.minimum(low[of], c)
            for d in np.unique(depth[earlier]).tolist():
                of = earlier & (depth == d)
                lo[of], c = blocks.left(b.block, d)
                low[of] = np.minimum(low[of], c)
            return lo, hi, low, last, further, earlier

        left, right, low, last, further, _ = extents(row, depth)
        has_parent = depth > 0
        up_left, _, up_low, _, _, up_earlier = extents(row[has_parent], depth[has_parent] - 1)
        # words of a node's last text; sums of a row's own nodes, from each of them on and of all rows before
        flat, first = b.words.flatten().to_numpy(), np.cumsum(b.length) - b.length
        words = np.zeros(len(row), np.int64)
        words[has_parent] = flat[(first[row] + depth - 1)[has_parent]]
        saved = (right - left) * words
        leaf = (depth == b.length[row]) & (last == depth)
        run_saved, run_leaf = np.cumsum(saved), np.cumsum(leaf)
        last_own = np.cumsum(own) - 1  # may be that of a row before
        upto = lambda run, k: np.where(last_own[k] >= 0, run[np.maximum(last_own[k], 0)], 0) if len(run) else np.zeros(len(k), np.int64)
        inside = np.minimum(right - b.start, b.n - 1)
        sums = [upto(of, inside) - of + of_one for of, of_one in ((run_saved, saved), (run_leaf, leaf))]
        # children: a row's own next node, and rows whose prefix in common is just the node's
        keys = np.sort(((b.lcp << 40) + np.arange(b.n))[1:][own[1:] > 0])
        children = (depth < b.length[row]) + np.searchsorted(keys, (depth << 40) + inside, "right") - np.searchsorted(keys, (depth << 40) + row, "right")
        done, open_, pieces = _runs(b, blocks)
        full = depth == b.length[row]
        ends = [done.get(r, _NOTHING) if f else _NOTHING for r, f in zip(row.tolist(), full.tolist(), strict=True)]
        parent = np.zeros(len(row), np.int64)
        parent[has_parent] = up_low
        out = [
            _table(
                len(row), kind=pa.array(np.zeros(len(row), np.int32)), block=pa.array(np.full(len(row), b.block)), l=pa.array(left), r=pa.array(right), depth=pa.array(depth), conv_id=pa.array(low), parent_conv_id=pa.array(parent, mask=~has_parent),
                n_children=pa.array(children), n_leaves=pa.array(sums[1]), saved_tokens=pa.array(sums[0]), beyond=pa.array(further), open=pa.array([f and r in open_ for r, f in zip(row.tolist(), full.tolist(), strict=True)], pa.bool_()), ends=pa.array(ends, pa.string()),
            )
        ]
        marks = np.array([*(p - 1 for p in blocks.rows[b.block]["begins"]["rows"]), b.n - 1])
        marks = np.unique(marks)
        out.append(_table(len(marks), kind=pa.array(np.ones(len(marks), np.int32)), block=pa.array(np.full(len(marks), b.block)), r=pa.array(marks + b.start), n_leaves=pa.array(upto(run_leaf, marks)), saved_tokens=pa.array(upto(run_saved, marks))))
        # nodes that a node of another block is the parent of: all those of one depth have the same
        d, at, many = np.unique(depth[has_parent][up_earlier], return_index=True, return_counts=True)
        out.append(_table(len(d), kind=pa.array(np.full(len(d), 2, np.int32)), l=pa.array(up_left[up_earlier][at]), depth=pa.array(d - 1), n_children=pa.array(many)))
        out.append(_table(len(pieces), kind=pa.array(np.full(len(pieces), 3, np.int32)), block=pa.array(np.full(len(pieces), b.block)), l=pa.array([p for p, _ in pieces], pa.int64()), ends=pa.array([s for _, s in pieces], pa.string())))
        return pa.concat_tables(out)

    return run


def _hashed(pieces: DataFrame) -> DataFrame:
    """l, hashed: the SHA-256 of each run's pieces, read one after the other in the order of blocks."""

    def run(batches):
        at, h = None, None
        for batch in batches:
            for row, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if row != at:
                    if h:
                        yield pa.RecordBatch.from_pydict({"l": [at], "hashed": [h.hexdigest()]})
                    at, h = row, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.as_buffer())
        if h:
            yield pa.RecordBatch.from_pydict({"l": [at], "hashed": [h.hexdigest()]})

    return pieces.repartition("l").sortWithinPartitions("l", "block").select("l", "ends").mapInArrow(run, "l long, hashed string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn, null first, then by role and text; null roles and texts are empty. It is
    rebuilt from the first turns of the conversation at the last multiple of STRIDE (towards 0, as ``%`` has it) and its own
    later turns. The root (depth 0) has all conversations; conv_id is a node's least member. Rows without conv_id belong to
    no conversation; equal rows are each a turn; other columns are ignored; a table without conversations has no node.

    Conversations are sorted by their turns' digests and cut into blocks. Each block's common prefixes are a sparse
    table, in which the interval of a node, and of its parent, is found by two binary searches; where it reaches a block's
    end, the search goes on in the sparse table over blocks, of which each has a few numbers and the steps at which its
    first and last rows' common prefix gets shorter. Sums over subtrees are differences of running sums. A conversation's
    digests (16 bytes a turn) are one row; blocks' summaries (about the square root of the number of conversations) are
    what the driver and every task hold.
    """
    spark = conversations.sparkSession
    tables = Tables(spark)
    blocked, size = in_blocks(rebuilt(conversations, tables), tables)
    tables.drop("own")
    by_block = blocked.groupBy("block")
    summary = by_block.applyInArrow(_summary(size), _SUMMARY).collect()
    if not summary:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shared = spark.sparkContext.broadcast(_Blocks(summary))
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    parts = tables.write("parts", by_block.applyInArrow(_nodes(size, shared), ", ".join(f"{name} {kinds[kind]}" for name, kind in _PARTS.items())))
    tables.drop("rebuilt", "sorted")
    nodes = parts.filter("kind = 0").drop("kind")
    # running sums over blocks: a few rows a block
    marks = parts.filter("kind = 1").select("block", "r", "n_leaves", "saved_tokens").toPandas().sort_values("r")
    ends = marks.groupby("block", sort=True).last()
    before = ends[["n_leaves", "saved_tokens"]].cumsum().shift(fill_value=0)
    for c in ("n_leaves", "saved_tokens"):
        marks[c] += before[c].reindex(marks["block"]).to_numpy()
        ends[c] += before[c]
    of = lambda found, at, tag: spark.createDataFrame([(int(a), int(x), int(y)) for a, x, y in zip(found[at], found["n_leaves"], found["saved_tokens"], strict=True)], f"{at} long, {tag}_leaves long, {tag}_saved long")
    more = parts.filter("kind = 2").groupBy("l", "depth").agg(F.sum("n_children").alias("more"))
    runs = tables.write("runs", _hashed(parts.filter("kind = 3")))
    found = nodes.join(F.broadcast(of(marks, "r", "to")), "r", "left").join(F.broadcast(of(ends.reset_index(), "block", "from")), "block")
    found = found.join(known(tables.write("more", more)), ["l", "depth"], "left").join(known(runs), "l", "left")
    beyond = lambda c: F.col(c[0]) + F.when(F.col("beyond"), F.col(f"to_{c[1]}") - F.col(f"from_{c[1]}")).otherwise(0)
    return found.select(
        "conv_id", "depth", "parent_conv_id", (F.col("r") - F.col("l") + 1).alias("n_convs"), (F.col("n_children") + F.when(F.col("beyond"), F.coalesce("more", F.lit(0))).otherwise(0)).alias("n_children"),
        beyond(("n_leaves", "leaves")).alias("n_leaves"), beyond(("saved_tokens", "saved")).alias("saved_tokens"), F.when(F.col("open"), F.col("hashed")).otherwise(F.col("ends")).alias("ends_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def oracle() -> str:
    """SQL with the same rows: every beginning of every conversation as a text of its turns' digests."""
    return f"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
                sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_CRC} % {MOST_HEAD + 1} AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, k, x, w FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {STRIDE} AND k <= h
            UNION ALL SELECT c.conv_id, k, x, w FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
        s AS (SELECT c.conv_id, coalesce(list(x ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS s, coalesce(list(w ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS w FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
        p AS (SELECT conv_id, s, w, unnest(range(0, len(s) + 1)) AS depth FROM s),
        n AS (SELECT array_to_string(s[1:depth], '') AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w[depth]), 0) AS w,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '') AS ends FROM p GROUP BY 1, 2),
        kids AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
        e AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (key)),
        sub AS (SELECT left(key, 64 * up) AS key, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT e.*, unnest(range(0, depth + 1)) AS up FROM e) GROUP BY 1)
        SELECT e.conv_id, e.depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
        FROM e JOIN sub USING (key) LEFT JOIN n up ON e.depth > 0 AND up.key = left(e.key, 64 * (e.depth - 1))"""
