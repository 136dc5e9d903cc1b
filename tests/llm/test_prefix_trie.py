"""The conversations' trie against a plain one made of dictionaries, in blocks of few conversations."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    members, whole = defaultdict(list), {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        s = (*own.get(base, [])[:h], *own[c][h:])
        whole[c] = s
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = (len(members[s]) - 1) * words(s) + sum(saved[k] for k in kids[s])
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if whole[c] == s)))
        yield min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()


def same(df, rows):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def some(seed, n):
    """Conversations with few texts, so that many begin alike, some are equal, some within others and some without turns."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 3 * n), n):
        for k in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([k, k, k, None, 0]), r.choice(["user", "user", "user", None]), r.choice(["a b", "a b", "a b", "c\td ", "", None, "é ü"])))
    return rows


@pytest.mark.parametrize(("seed", "n", "size"), [(0, 60, 2), (1, 60, 3), (2, 90, 1), (3, 40, 7), (4, 90, 1024)])
def test_small_blocks(spark, monkeypatch, seed, n, size):
    monkeypatch.setattr(prefix_trie, "block_size", lambda n: size)
    rows = some(seed, n)
    same(prefix_trie.prefix_trie(conversations(spark, rows)), rows)


@pytest.mark.parametrize("size", [4, 1024])
def test_equal_and_long_conversations(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "block_size", lambda n: size)
    rows = [(c, k, "user", "same text here") for c in range(1, 40) for k in range(5)] + [(c, 0, "user", "x") for c in range(60, 70)]
    rows += [(100 + c, k, "user" if k % 2 else "assistant", f"turn {min(k, 250 + c)}") for c in range(3) for k in range(300)]
    rows += [(None, 0, "user", "no conversation"), (100, 0, "assistant", "turn 0"), (None, None, None, None), (7, 9, "user", "word " * 20_000)]
    df = conversations(spark, rows).withColumns({c: F.lit(1) for c in ("block", "pos", "key", "x", "rank", "l", "r", "depth", "words", "base", "h", "head", "own", "part")})
    same(prefix_trie.prefix_trie(df), rows)


def test_no_conversation(spark):
    for rows in ([], [(None, 1, "user", "text")]):
        df = prefix_trie.prefix_trie(conversations(spark, rows))
        assert df.count() == 0
        assert sorted(df.columns) == sorted(COLUMNS)
    same(prefix_trie.prefix_trie(conversations(spark, [(5, None, None, None)])), [(5, None, None, None)])


def test_extents_are_those_of_a_plain_walk():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = r.integers(0, 5, n)
        levels = prefix_trie.sparse(lcp)
        at, depth = r.integers(0, n, 200), r.integers(0, 6, 200)
        for i, d, lo, hi in zip(at, depth, prefix_trie.extent_left(levels, at, depth), prefix_trie.extent_right(levels, at, depth), strict=True):
            a, b = i, i
            while a > 0 and lcp[a] >= d:
                a -= 1
            while b + 1 < n and lcp[b + 1] >= d:
                b += 1
            assert (lo, hi) == (a, b)
        lo, hi = np.sort(r.integers(0, n, (2, 200)), axis=0)
        assert prefix_trie.least(levels, lo, hi).tolist() == [lcp[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(sf_dir, 'conversations')}.parquet'")
    found = db.execute(prefix_trie.oracle())
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()), key=str)
    df = prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str) == want
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert want == sorted(plain(rows), key=str)
