"""The corpus pipeline, stage by stage against brute force, on tables with repeated and null ids and clashing columns."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wayfarer.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "times", "size", "n", "__id", "root"]
ITEM = "the quick brown fox jumps over the lazy dog and then sleeps"
KEY = "password = hunter2secret"


def words(seed, n=60):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))


def rows():
    near = words(1, 200).split()
    near[50] = "changed"
    texts = [
        (1, words(1, 200)), (2, " ".join(near)), (2, words(2)), (2, words(3)), (None, words(4)), (None, words(4)), (None, words(5)),
        (3, f"{words(6)} {ITEM} end"), (3, words(7)), (None, f"{ITEM} and more"), (4, None), (5, ""), (6, "12 34"), (7, f"{words(8)} {KEY} {words(9)}"),
        (8, words(10)), (8, words(10)), (9, words(11, 20_000)),
    ]
    return [(d, t, "en" if k % 2 else None, ["a", "b", None][k % 3], k, k, k, k, k) for k, (d, t) in enumerate(texts)]


def folder(path, found):
    columns = list(zip(*found, strict=True)) if found else [()] * len(COLUMNS)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.int64()] * 5
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=COLUMNS), path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [ITEM, None]}), path / "benchmark.parquet")
    return str(path)


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/after-{k}")
        before, docs = docs, spark.read.parquet(f"{path}/after-{k}")
        yield name, before, docs


def shingle_set(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark, tmp_path):
    path = folder(tmp_path, rows())
    for name, before, docs in stages(spark, path):
        old, new = before.collect(), docs.collect()
        texts = Counter((r.doc_id, r.text) for r in new)
        if name != "mixing":
            assert docs.columns == COLUMNS
        if name == "language":
            assert texts == Counter((r.doc_id, r.text) for r in old if r.text and any(c.isalpha() for c in r.text))
        elif name == "near_duplicates":
            for r in old:  # what went is near to a row that stayed, and rows that stayed are not near to each other
                near = [s for s in new if (a := shingle_set(r.text)) and 100 * len(a & (b := shingle_set(s.text))) >= 80 * len(a | b)]
                assert len(near) == 1
        elif name == "decontamination":
            assert texts == Counter((r.doc_id, r.text) for r in old if ITEM.split()[:10] != r.text.split()[:10] and f" {ITEM} " not in r.text)
            assert (3, words(7)) in texts and (None, words(5)) in texts
        elif name == "secrets":
            assert len(new) == len(old) and all(KEY not in r.text for r in new)
            assert texts[(7, f"{words(8)} [secret] {words(9)}")] == 1
        else:
            assert docs.columns == [*COLUMNS, "_times"]
            sizes = Counter()
            for r in new:
                sizes[r.source] += r._times * len(r.text.split())
                assert 1 <= r._times <= 2
            target = {r.source: r.target for r in mixing.mix(before, carry=("source",)).collect()}
            longest = max(len(r.text.split()) for r in old)
            assert all(abs(sizes[s] - t) <= 2 * longest for s, t in target.items())
            assert all((r.doc_id, r.text) in Counter((x.doc_id, x.text) for x in old) for r in new)


def test_empty_and_null_tables(spark, tmp_path):
    path = folder(tmp_path, [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_columns_of_nulls(spark, tmp_path):
    path = folder(tmp_path, [(None, r[1], None, None, *r[4:]) for r in rows()])
    assert corpus_pipeline.run(spark, path).count() > 5


def test_no_text_at_all(spark, tmp_path):
    path = folder(tmp_path, [(r[0], None, *r[2:]) for r in rows()])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_rows_of_one_id_and_size_keep_their_own_times(spark):
    docs = spark.createDataFrame([(1, f"{k} b c", s) for k, s in enumerate("aaaabbbbcccc")] + [(None, "x", None)] * 3, "doc_id long, text string, source string")
    got = mixing.taken(docs).collect()
    clashing = mixing.taken(docs.withColumn("__row", F.lit("mine")).withColumn("__TAKEN", F.lit("too")).withColumn("times", F.lit(9)))
    assert clashing.columns == [*docs.columns, "__row", "__TAKEN", "times", "_times"] and clashing.count() == len(got)
    assert {(r["__row"], r["__TAKEN"], r.times) for r in clashing.collect()} == {("mine", "too", 9)}
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source_size] += r.taken
    have = Counter()
    size = {"a": 12, "b": 12, "c": 12, None: 3}
    for r in got:
        have[size[r.source]] += r.times * len(r.text.split())
    assert have == +want
