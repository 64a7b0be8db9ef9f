import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.WordTokenizer(PATH)


def same(text):
    e = LIBRARY.encode(text, add_special_tokens=False)
    ids = OWN.encode(text)
    assert list(memoryview(ids).cast("I") if ids else []) == e.ids
    assert OWN.decode(ids) == LIBRARY.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abeinrsthou 'ΣİÉß<|>!1", max_size=80))
def test_texts_that_merge(text):
    same(text)


@pytest.mark.parametrize("text", ["a" * 5000, "<|endoftext|>x<|startoftext|>", "ΣΑΣ it's WE'LL", "\x1c\x85  end", ""])
def test_special_cases(text):
    same(text)


def test_automaton_against_merging_by_rank():
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("ba", "ba"), ("aab", "aa"), ("b", "b"), ("aa", "aa")]
    vocab = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    automaton = bpe.MergeAutomaton(vocab, merges)

    def plain(word):
        parts = list(word)
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not found:
                return [vocab[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 2**12):
        word = bin(n)[3:].translate({48: "a", 49: "b"})
        if word:
            assert automaton.encode(word) == plain(word), word


def test_edges_in_spark(edges):
    rows = bpe.tokenized(edges.withColumn("tokens", F.lit(1)), PATH).select("doc_id", "text", "tokens.*").collect()
    assert len(rows) == 10
    for r in rows:
        e = LIBRARY.encode(r["text"] or "", add_special_tokens=False)
        assert list(memoryview(bytes(r["ids"])).cast("I") if r["ids"] else []) == e.ids
        assert hashlib.sha256(r["decoded"].encode()).digest() == hashlib.sha256(LIBRARY.decode(e.ids, skip_special_tokens=False).encode()).digest()
    back = bpe.tokenized(edges, PATH).select("tokens.decoded", bpe.decoded(F.col("tokens.ids"), PATH).alias("again")).collect()
    assert all(r["decoded"] == r["again"] for r in back)
