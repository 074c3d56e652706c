"""Token alignment against plain loops over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fraudstream.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sides():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute_one(text, a, b, symbols):
    """(A spans, B spans), or None where the bytes differ."""
    if not text:
        return None
    left = [(i, bytes(symbols[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return None
    return spans(left), spans(right)


def brute(rows):
    """The result's rows, in order."""
    a, b = sides()
    symbols = alignment.byte_symbols()
    found, held = [], Counter()
    for doc_id, text in rows:
        both = brute_one(text, a, b, symbols)
        links, groups = [], []
        if both:
            ga, gb = [], []
            ends = {e for _, _, e in both[0]} & {e for _, _, e in both[1]}
            j = 0
            for i, s, e in both[0]:
                ga.append(i)
                k = j
                while k < len(both[1]) and both[1][k][1] < e:
                    if both[1][k][2] > s:
                        links.append((i, both[1][k][0]))
                    k += 1
                while j < len(both[1]) and both[1][j][2] <= e:
                    gb.append(both[1][j][0])
                    j += 1
                if e in ends:
                    groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                    ga, gb = [], []
        held.update(set(links))
        found.append((doc_id, both, links, groups))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, both, links, groups in found:
        out.append((
            doc_id,
            len(both[0]) if both else 0,
            len(both[1]) if both else 0,
            len(groups),
            len(links),
            sum(held[p] == top[p[0]] for p in links),
            sum(held[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if both else "",
        ))
    return out


def key(row):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in row)


@pytest.mark.parametrize("table", [alignment.TABLE, 50, 0])
def test_alignment_equals_brute_force(spark, docs, docs_rows, table):
    odd = [(60, "a▁b"), (61, "  two  spaces "), (62, "<|endoftext|> <s> <unk>"), (63, "\x00 nul"), (64, " ")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(more)
    got = sorted(map(tuple, alignment.align(whole, A_FILE, B_FILE, table=table).collect()), key=key)
    want = sorted(brute(docs_rows + odd), key=key)
    assert got == want
    assert next(r for r in got if r[0] == 60)[1:] == (0, 0, 0, 0, 0, 0, "")  # U+2581 is read back as a space
    assert sum(r[0] == 43 for r in got) == 2  # repeated rows stay


def test_alignment_of_an_empty_table(spark, empty):
    got = alignment.align(empty, A_FILE, B_FILE)
    assert got.collect() == []
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_keeps_text_ids_and_reads_clashing_columns(spark):
    rows = [("x", "same words", 1, "p"), ("x", "same words", 2, "q"), (None, None, 3, None)]
    docs = spark.createDataFrame(rows, "`doc.id` string, text string, row long, pairs string")
    got = alignment.align(docs, A_FILE, B_FILE, id_col="doc.id").collect()
    assert sorted(r[0] or "" for r in got) == ["", "x", "x"]
    assert len({tuple(r) for r in got if r[0] == "x"}) == 1


def test_pairs_round_trip():
    import numpy as np

    a, b = alignment.Tokens([b"a"] * 50000), alignment.Tokens([b"b"] * 40000)
    made = alignment.Aligner(a, b)
    codes = np.array([7, 7, 3, a.size * b.size - 1, 5])
    packed = made._pairs(np.array([0, 0, 0, 0, 1]), codes, 2)
    assert [x.tolist() for x in alignment.unpack(packed[0], made.narrow)] == [[3, 7, a.size * b.size - 1], [1, 2, 1]]
    assert [x.tolist() for x in alignment.unpack(packed[1], made.narrow)] == [[5], [1]]
