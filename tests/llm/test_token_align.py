"""Alignment of two tokenizers against a plain one, text by text."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import token_align

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n", "   two  spaces ", "a\nb\n\nc\r\nd \n e", "\n\nleading line", "x", "x", "ends with a space ", "tab\tand no-break", "᠎ odd ᠎ space", "mark ▁ here", "▁",
    "<|endoftext|> and <s> </s> <0x0A> <unk>", "naïve ÀÉ über 𝔘 日本語のテキスト 🙂🙂 é", "don't we'll I'M", "word " * 3000, "a" * 4000, "日本" * 500, "1234567890 12,34.5 -- ... !!!", "\x00\x01 \x1c \x85 x", "the the\nthe the\n the",
]


def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = token_align.byte_values()

    def both(text):
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = f" {text}".encode()
        return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else None

    return both


def plain(texts):
    """Rows of the contract, with the tokens of whole texts and plain loops."""
    both, groups = encoders(), []
    for t in texts:
        found = both(t) if t else None
        if not found:
            groups.append([])
            continue
        ids_a, raw_a, ids_b, raw_b = found
        ends = []
        for raw in (raw_a, raw_b):
            at, of = 0, []
            for x in raw:
                at += len(x)
                of.append(at)
            ends.append(of)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        out, lo = [], 0
        for c in cuts:
            out.append(tuple([i for i, e in zip(ids, of, strict=True) if lo < e <= c] for ids, of in ((ids_a, ends[0]), (ids_b, ends[1]))))
            lo = c
        groups.append(out)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for g, c in zip(groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return sorted((tuple(r[c] for c in ["doc_id", *NAMES]) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, monkeypatch, small):
    if small:  # every text alone, what is kept is cleared between them, a shuffle in place of the broadcast
        for name, value in (("KEPT", 3), ("SLICE", 1), ("AT_ONCE", 2)):
            monkeypatch.setattr(token_align, name, value)
        monkeypatch.setattr(token_align, "known", lambda df: df)
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(0) for c in ("row", "pair", "pairs", "times", "docs", "best", "n_a", "id_a", "most", "__id")}).repartition(3)
    got = rows(token_align.alignment(docs, A, B))
    assert got == sorted(((None if k == 3 else k // 2, *r) for k, r in enumerate(plain(ODD))), key=str)
    assert token_align.alignment(docs.limit(0), A, B).count() == 0


def test_texts_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select("doc_id", "text").collect()
    want = plain([r.text for r in texts])
    assert rows(token_align.alignment(docs, A, B)) == sorted(((t.doc_id, *r) for t, r in zip(texts, want, strict=True)), key=str)


def test_a_vocabulary_that_reaches_over_words_is_given_whole_texts(monkeypatch):
    c = token_align.Codec(A, B)
    assert c.stretches("a b\nc") == [" a", " b", "\nc"]
    monkeypatch.setattr(c, "parts", False)
    assert c.stretches("a b\nc") == [" a b\nc"]
    assert token_align._align(c, ["a b\nc <0x0A>"])[0][4] == token_align._align(token_align.Codec(A, B), ["a b\nc <0x0A>"])[0][4]


def test_stretches_encoded_side_by_side_are_parted():
    c = token_align.Codec(A, B)
    side = [" über", "\nline", " 日本", " ▁", " x"]
    for encoded, long in ((c._encoded_a, c.long_a), (c._encoded_b, c.long_b)):
        assert token_align._parted(side, encoded, long).to_pylist() == pa.array(encoded(side), token_align._IDS).to_pylist()
