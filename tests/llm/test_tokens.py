"""Token counts and byte BPE against the libraries."""

import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from fraudstream.llm import byte_bpe, token_counts
from fraudstream.llm.queries import BYTE_BPE, WORD_BPE

RANKS = public_tokenizers.path(BYTE_BPE)


def test_token_counts(docs, docs_rows, empty):
    path = public_tokenizers.path(WORD_BPE)
    library = Tokenizer.from_file(path)
    want = sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs_rows
    )
    for table in (token_counts.TABLE, 1):
        rows = token_counts.count_tokens(docs, path, table=table, sample_rows=5).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_other_tokenizer_files_are_encoded_whole(docs, docs_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in docs_rows)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(docs, path).collect()) == want


def test_worker_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    with open(public_tokenizers.path(WORD_BPE), encoding="utf-8") as file:
        lengths = token_counts.Lengths(file.read(), {"the": 1})
    texts = ["the quick brown fox", "jumps over the lazy dog", "quick brown"]
    assert [lengths.count([t])[0] for t in texts] == lengths.encode(texts)
    assert len(lengths.known.cache) <= 5


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(docs, docs_rows, empty, library):
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    key = lambda x: (str(x[0]), x[1])
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in docs_rows), key=key)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in rows), key=key) == want
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_merges_of_long_and_odd_pieces(library):
    ranks = byte_bpe.read_ranks(RANKS)
    rng = random.Random(1)
    pieces = ["a" * 5000, "ab" * 700, "é" * 99, "".join(rng.choice("abcdefgh") for _ in range(3000)), "\U0010ffff"]
    bpe = byte_bpe.ByteBPE(ranks, r".+")
    assert bpe.encode(pieces) == [library._encode_single_piece(p) for p in pieces]


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)]
    found = byte_bpe.PerfectHash(keys)
    assert sorted(found.slots.tolist()) == list(range(5000))
    assert found.lookup(keys).tolist() == list(range(5000))
    assert byte_bpe.PerfectHash([]).lookup([b"x"]).tolist() == [-1]
    assert byte_bpe.PerfectHash([b"x"]).lookup([b"x"]).tolist() == [0]


def test_texts_beyond_latin_are_looked_up_too(monkeypatch):
    path = public_tokenizers.path(WORD_BPE)
    with open(path, encoding="utf-8") as file:
        lengths = token_counts.Lengths(file.read(), {"the": 1})
    texts = ["It\u2019s \u201cthe\u201d end \u2013 20\u20ac", "a\xa0no-break space", "\U0001f600\U0001f3fd the \u2764\ufe0f'S", "\u041f\u0440\u0418\u0432\u0415\u0442 \u4f60\u597d",
             "\u039f\u0394\u039f\u03a3 \u0130I\u0307\u0323 \u1e9e\ufb01", "e\u0301 o\u0323\u0302 \u1100\u1161\u11a8 \u212b\u2126", "\u0e2a\u0e27\u0e31 \u0661\u0662 \u2028 \u3000x\x1c\x85y\u200b z"]
    texts += ["".join(chr(c) for c in range(i, i + 512) if not 0xD800 <= c < 0xE000) for i in range(0, 0x20000, 512)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    whole = []
    monkeypatch.setattr(lengths, "encode", lambda texts: whole.extend(texts) or [-1] * len(texts))
    assert lengths.count(texts) == want and not whole
