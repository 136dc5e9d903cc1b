import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import decontaminate, jaccard_join, langid, media, mixing, quality, token_count

ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "x", "b"), (4, "x", "b"), (None, "Some words of a text", "b"), (5, "ÀÉ über naïve 𝔘", "a"), (6, "word " * 3000, "a")]


def table(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    """The same rows with columns named like an operator's own."""
    return df.withColumns({c: F.lit(0) for c in ("n", "size", "hits", "items", "key", "gram", "cid", "root", "row", "spans", "score", "h", "bucket", "ends", "__id", "__n", "__k1", "__K2", "__a", "__row", "__bad", "__taken")})


# decontamination


def brute_hits(text, items, width=10):
    fold = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            window = w[i : i + width]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination(spark, monkeypatch):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (12, "Zwei, drei!"), (3, None), (9, "five six seven eight nine ten eleven twelve one two"), (2, "É é")]
    docs = ODD + [(7, "ONE two-three four/five six seven eight nine ten. eleven and zwei DREI", "a"), (8, "one two three four five six seven eight nine", "a"), (9, "x one two three four five six seven eight nine ten eleven twelve one two zwei drei É é", "b")]
    bench = table(spark, items, "item_id long, text string")
    for size in (1 << 20, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = docs if size > 30 else [d for d in docs if d != (4, "x", "b")] + [(4, "x", "b")]
        found = decontaminate.contamination(with_clashes(table(spark, rows)), bench, spans=True)
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.select("*", decontaminate.n_hit().alias("n_hit")).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted(((i, *brute_hits(t, items)) for i, t, _ in rows), key=key)
        texts = {i: (t or "").encode() for i, t, _ in rows}
        for r in found.filter("doc_id = 7").collect():
            assert [texts[7][a:b] for a, b in r.spans] == [b"ONE two-three four/five six seven eight nine ten. eleven", b"zwei DREI"]
    assert decontaminate.contamination(table(spark, docs), bench.limit(0)).filter(F.size("hits") > 0).count() == 0
    assert decontaminate.contamination(table(spark, docs).limit(0), bench).count() == 0
    kept = decontaminate.clean(with_clashes(table(spark, docs)), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _ in docs if not brute_hits(t, items)[1])
    assert kept.columns == with_clashes(table(spark, docs)).columns


def test_contamination_in_blocks(spark, monkeypatch):
    """Rows that repeat an id, or have none, are judged each by its own text however many blocks the benchmark has."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    items = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k}") for k in range(3)]
    docs = [(1, "nothing here", "a"), (1, "x " + items[0][1], "a"), (1, "x " + items[0][1], "a"), (None, None, "a"), (None, items[1][1], "a"), (None, "clean words", "b"), (4, items[2][1] + " " + items[0][1], "b")]
    found = decontaminate.contamination(with_clashes(table(spark, docs)), table(spark, items, "item_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.select("*", decontaminate.n_hit().alias("n_hit")).collect())
    assert got == Counter((i, n, hit, tuple(x)) for i, t, _ in docs for n, hit, x in [brute_hits(t, items)])
    assert found.columns == ["doc_id", "n_words", "hits", "items"]


# media


@pytest.mark.parametrize("kind", range(5))
def test_every_png_filter(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    raw = np.empty((5, 13), np.uint8)
    raw[:, 0] = kind
    for y in range(5):
        for x in range(12):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            raw[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(raw) == image).all()


def test_media(spark):
    rows = [(r.doc_id, r) for r in media.read_back(media.text_images(with_clashes(table(spark, ODD)))).collect()]
    assert Counter(i for i, _ in rows) == Counter(i for i, *_ in ODD)
    texts = Counter((i, (t or "").encode()) for i, t, _ in ODD)
    for (i, raw), n in texts.items():
        size = max(192, -(-len(raw) // 192) * 192)
        payload = raw.ljust(size)
        same = [r for k, r in rows if k == i and r.n_bytes == len(raw)]
        assert len(same) == n
        for r in same:
            assert media.decode_png(bytes(r.media)).tobytes() == payload
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert (r.media_bytes, r.media_sha256, len(r.feature)) == (len(r.media), hashlib.sha256(r.media).hexdigest(), 16)
    assert not media.read_back(media.text_images(table(spark, ODD).limit(0))).count()


def test_broken_images_are_told():
    data = media.encode_png(np.arange(384, dtype=np.uint8).reshape(2, 192))
    for bad in (data[:-1], data[:40], b"x" + data[1:], data[:50] + bytes([data[50] ^ 1]) + data[51:], data[:-12]):
        with pytest.raises(media.PngError):
            media.decode_png(bad)


def test_near_images_have_near_hashes():
    rng = np.random.default_rng(0)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((24, 24))).astype(np.uint8)
    noisy = np.clip(image + rng.normal(0, 4, image.shape), 0, 255).astype(np.uint8)
    other = np.kron(rng.integers(0, 256, (8, 8)), np.ones((24, 24))).astype(np.uint8)
    far = lambda a, b: bin(media.cosine_hash(a) ^ media.cosine_hash(b)).count("1")
    assert far(image, noisy) <= 4 < far(image, other)


# tokens

TOKENIZERS = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_spliced_tokens_equal_whole_ones(name, spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path(name)
    tokenizer = token_count.load(path)
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.length("text").desc()).limit(4).collect()]
    texts = [*docs, "a" * 3000, "x <|endoftext|> y " * 300, "é́ " * 900, " \n\t " * 700, "日本語テキスト" * 300, "don't we'll " * 400]
    for text in texts:
        whole = [i for _, _, i in token_count.encode(tokenizer, text)]
        for chunk, overlap in ((256, 64), (1000, 16)):
            assert [i for part in token_count.resynchronised(tokenizer, text, chunk=chunk, overlap=overlap) for i in part] == whole


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZERS[0])
    tokenizer = token_count.load(path)
    got = token_count.token_counts(with_clashes(table(spark, ODD)), path, limit=100, chunk=512, overlap=64).collect()
    want = [(i, len((t or "").encode()), (n := len(tokenizer.encode(t or "", add_special_tokens=False))), n > 100) for i, t, _ in ODD]
    assert Counter(map(tuple, got)) == Counter(want)
    assert not token_count.token_counts(table(spark, ODD).limit(0), path).count()


def test_long_documents_of_the_tables_are_spliced(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.length("text") > token_count.CHUNK)
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) > 50
    whole = token_count.count(token_count.load(path), [r.text for r in rows])
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, path).collect()} == {r.doc_id: n for r, n in zip(rows, whole, strict=True)}
    letters = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 40_000))
    tokenizer = token_count.load(path)
    assert sum(map(len, token_count.resynchronised(tokenizer, letters + " x"))) == token_count.count(tokenizer, [letters + " x"])[0]



# language


def test_language(spark):
    de, en = "der hund und die katze schlafen im garten".split(), "the dog and the cat sleep in the garden".split()
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(de if k % 2 else en, 12)), "de" if k % 2 else "en") for k in range(200)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.labels == ["de", "en"]
    odd = table(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (4, "the dog"), (5, "die katze " * 30000), (None, "the cat")], "doc_id long, text string")
    got = langid.identify(with_clashes(odd), model).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == 7 and by == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "en")}
    assert all(0 <= r.score <= 1 for r in got)
    words = model.label_words("the dog and the cat der hund und die katze")
    assert [x for _, x, _ in words] == ["en"] * 5 + ["de"] * 5
    assert sorted(r.doc_id or 0 for r in langid.in_language(with_clashes(odd), model, 0.35).collect()) == [0, 4, 4, 5]
    beside = table(spark, [(1, "m² x²"), (2, "2x³"), (3, "² 3 _"), (4, "ª")], "doc_id long, text string")  # letters beside numerals are letters
    assert {r.doc_id: r.lang_pred in ("de", "en") for r in langid.identify(beside, model).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_forward_backward_is_exact():
    from itertools import product

    rng = np.random.default_rng(3)
    model = langid.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = [1, 5, 4, 1, 6]
    scores = rng.normal(size=(sum(lengths), 3))
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    want, at = [], 0
    for n in lengths:
        s, p = scores[at : at + n], np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            weight = np.exp(model.start[path[0]] + sum(s[i, y] for i, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                p[i, y] += weight
        want.append(p / p.sum(axis=1, keepdims=True))
        at += n
    assert np.allclose(model.marginals(scores, first), np.concatenate(want))
    assert np.allclose(langid._expected(model, scores, first)[0], np.concatenate(want))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).withColumn("out", langid.held_out()).filter("out").join(docs.select("doc_id", "lang"), "doc_id")
    right = found.filter("lang = lang_pred").count()
    assert right >= 0.97 * found.count()


# quality


def test_quality(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(900):
        grade = k % 3
        words = list(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 30))
        words += list(rng.choice(["bad", "worse"], 2)) if grade == 0 else ["|"] * 15 if grade == 1 else []
        rows.append((k, " ".join(rng.permutation(words)), "s"))
        labels.append((k, int(grade == 2), int(grade == 0)))
    docs = table(spark, rows + [(10_000, None, "s"), (10_001, "", None), (None, "alpha", "s")])
    rated = quality.grades_of(table(spark, labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    model = quality.fit(quality.training_rows(docs, rated, 3), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.score(with_clashes(docs), model).collect()}
    assert len(got) == 903
    right = sum((sum(t > 0.5 for t in got[k].tails)) == k % 3 for k in range(900))
    assert right > 850
    assert all(0 <= r.expected_grade <= 2 and r.tails[0] >= r.tails[1] for r in got.values())
    none = quality.fit([], 3)
    assert quality.score(docs, none).count() == 903


def test_capitals_are_counted_over_all_words():
    mark = quality.BUCKETS - 64 + len(quality._MARKS)
    for at, many in ((0, False), (1, False), (None, True)):  # every fourth word, or all others
        words = ["WORD" if (k % 4 == at if at is not None else k % 4) else "word" for k in range(1024)]
        assert (mark in quality.buckets(" ".join(words).encode(), {})) == many


# near duplicates


def brute_components(rows, n=3, percent=90):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return Counter((doc, len(s), ids.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed):
    rng = np.random.default_rng(seed)
    rows = [(10, None), (11, ""), (12, " \t"), (13, "one"), (14, "ONE"), (15, "one two"), (16, "one two"), (16, "one two"), (None, "one two"), (17, "a b a b a b"), (None, "unique text here")]
    doc = 100
    for _ in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(20, 160)))]
        for _ in range(int(rng.integers(1, 14))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"v{rng.integers(400)}"
            rows.append((doc, " ".join(words)))
            doc += int(rng.integers(1, 3))
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("seed, common", [(0, 16), (1, 2), (2, 0)])
def test_near_duplicates(spark, monkeypatch, seed, common):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rows = near_rows(seed)
    docs = table(spark, rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.near_duplicates(with_clashes(docs)).collect())) == brute_components(rows)


def test_pairs_of_a_template_meet_once(spark):
    """Texts that share much of a template, but not enough to be near, are met at one n-gram and not at each that they share."""
    rng = np.random.default_rng(5)
    template = [f"w{k}" for k in range(400)]
    texts = [[f"o{d}_{k}" if k in own else w for k, w in enumerate(template)] for d in range(12) for own in [set(rng.choice(400, 12, replace=False).tolist())]]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    join = jaccard_join._Join(docs, 5, 80)
    none = spark.createDataFrame([], "node long, root long")
    least = {r.cid: r.least for r in join.classes.collect()}
    met = [tuple(sorted((least[r.a], least[r.b]))) for r in join.meetings(none).collect()]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = {(a, b) for a in range(12) for b in range(a + 1, 12) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near <= set(met)
    assert len(met) <= 2 * len(set(met)), (len(met), len(set(met)))


def test_one_of_each(spark):
    rows = near_rows(4)
    docs = with_clashes(table(spark, rows, "doc_id long, text string"))
    kept = jaccard_join.one_of_each(docs)
    want = {d for d, _, c in brute_components(rows) if d is not None and d == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.columns == docs.columns
    assert not jaccard_join.near_duplicates(docs.limit(0)).count()


def test_rows_of_one_id_are_judged_by_their_own_text(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    text = lambda k: " ".join(f"t{k}_{i}" for i in range(60))
    docs = [(None, item), (None, "clean"), (7, "x " + item), (7, "also clean"), (8, None)]
    for size in (1 << 20, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        bench = table(spark, [(1, item), (2, "other words of a benchmark")], "item_id long, text string")
        kept = decontaminate.clean(with_clashes(table(spark, docs, "doc_id long, text string")), bench)
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, "clean"), (7, "also clean"), (8, None)])
    rows = [(None, text(0)), (None, text(0)), (None, text(1)), (3, text(1)), (4, text(2)), (4, text(3)), (5, text(4)), (5, text(4)), (6, text(4)), (9, None), (9, ""), (None, text(2) + " more"), (None, " ")]
    docs = with_clashes(table(spark, rows, "doc_id long, text string"))
    kept = jaccard_join.one_of_each(docs)
    want = [(None, text(0)), (3, text(1)), (4, text(2)), (4, text(3)), (5, text(4)), (9, None), (9, ""), (None, " ")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert kept.columns == docs.columns


def test_a_class_read_again_twice_counts_once(spark):
    base = [f"b{k}" for k in range(2000)]
    other = list(base)
    for at in range(10, 1990, 30):  # Jaccard 0.82: no link
        other[at] = f"o{at}"
    rows = [(5, " ".join(base)), (None, " ".join(base)), (None, " ".join(other))]
    assert Counter(map(tuple, jaccard_join.near_duplicates(table(spark, rows, "doc_id long, text string")).collect())) == brute_components(rows)


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    rows = near_rows(5)
    base = [f"x{k}" for k in range(200)]
    for k in range(6):  # one edit in about 40 words: near at 5 words and 0.8, not at 3 and 0.9
        words = list(base)
        for at in rng.choice(200, 5, replace=False) if k else ():
            words[at] = f"y{k}_{at}"
        rows.append((900 + k, " ".join(words)))
    want = {d for d, _, c in brute_components(rows, 5, 80) if d is not None and d == c}
    assert want != {d for d, _, c in brute_components(rows) if d is not None and d == c}
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


# mixing


def water(sizes, weights, budget, repeats=2):
    """Targets by resharing what is above the limits until nothing is."""
    full = {}
    while True:
        open_ = [s for s in sizes if s not in full]
        left = budget - sum(full.values())
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * left / total > repeats * sizes[s] + 1e-9] if total else []
        if not over:
            return full | {s: weights[s] * left / total for s in open_}
        full |= {s: repeats * sizes[s] for s in over}


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 40))), f"s{int(rng.integers(6)) ** 2 % 7}") for k in range(3000)] + [(9000, None, None), (9001, "", "s0"), (9002, "a b c", None), (9003, "d", "empty"), (9003, "d", "empty")]
    docs = table(spark, rows)
    got = mixing.mix(with_clashes(docs)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = water(sizes, weights, 1.5 * sum(sizes.values()))
    source = {}
    for i, _, s in rows:
        source[i] = s
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-3
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 80
    assert not mixing.mix(docs.limit(0)).count()
    assert mixing.mix(table(spark, [(1, None, None)])).collect()[0].taken == 0
