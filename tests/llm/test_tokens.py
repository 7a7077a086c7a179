from __future__ import annotations

import random

import public_tokenizers
import pytest
from llm.helpers import ODD, documents, prose
from tokenizers import Tokenizer

from loomshed.llm.tokens import Tokens, byte_ranks, count_tokens, query

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ids = lambda t: LIBRARY.encode(t, add_special_tokens=False).ids


def awkward(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|endof", " ", "   ", "\n\n", "\t", "don't", "'re", "12345", "漢字", "é", "🙂", "z" * 40, "...", "word", " Word", " ", "\r\n"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize(("huge", "overlap"), [(64, 4), (64, 32), (257, 16), (1000, 100)])
def test_splices_equal_the_whole(huge, overlap):
    t = Tokens(PATH, huge, overlap)
    for text in [*(awkward(s, 400) for s in range(12)), "a" * 3000, " " * 3000, "ab " * 900, prose(1, 900), "<|endoftext|>" * 150, "x" * 500 + " " + "y" * 900]:
        assert t.spliced(text) == ids(text)


def test_fast_path_agrees_on_every_character_it_takes():
    t = Tokens(PATH)
    for c in map(chr, range(0x300)):
        text = f"a{c}b {c}1{c}{c} {c}\n{c}c'{c}ll.{c} "
        assert t.ids(text) == ids(text), hex(ord(c))


def test_table(spark):
    texts = [*ODD, prose(2, 30), prose(2, 30), "<|endoftext|> x", prose(3, 30000)]
    got = {r.doc_id: r for r in count_tokens(documents(spark, texts).withColumnRenamed("lang", "n_tokens")).collect()}
    for k, t in enumerate(texts):
        n = len(ids(t or ""))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 512)
    assert count_tokens(documents(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    import sentencepiece

    texts = [t for t in ODD if t] + [prose(2, 300)]
    path = public_tokenizers.path(name)
    whole = sentencepiece.SentencePieceProcessor(model_file=path).encode if name.endswith("model") else lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, texts), name).collect()}
    assert got == {k: len(whole(t)) for k, t in enumerate(texts)}


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: len(ids(r.text)) for r in docs}


def test_splicing_is_what_counts_on_real_tables(spark):
    """A good part of the texts is long enough for it, and their counts are the library's."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars > 4096")
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) >= 1000
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    assert got == {r.doc_id: len(ids(r.text)) for r in rows}


def test_ranks_come_from_the_vocabulary_alone():
    import json

    model = json.loads(LIBRARY.to_str())["model"]
    assert byte_ranks(model)[b" the"] == model["vocab"]["Ġthe"]
    a, b = model["merges"][:2]
    assert byte_ranks(model | {"merges": [b, a]}) is None and byte_ranks(model | {"merges": []}) is None and byte_ranks({"vocab": {"a": 0}}) is None
