"""Alignment of two tokenizers against their libraries on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from mistgrove.llm.alignment import align, align_documents, byte_alphabet
from mistgrove.llm.common import documents

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def brute(rows):
    """Per row (key, n_a, n_b, n_groups, n_links, n_best, count_sum, digest), from the libraries on whole texts."""
    one, two = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    alphabet = byte_alphabet()
    found, corpus = [], Counter()
    for key, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((key, 0, 0, [], None))
            continue
        ea, eb = ends(bytes_a), ends(bytes_b)
        groups, ia, ib = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            na, nb = sum(e <= cut for e in ea[ia : ia + 400]), sum(e <= cut for e in eb[ib : ib + 400])
            assert na < 400 and nb < 400
            groups.append((a[ia : ia + na], b[ib : ib + nb]))
            ia, ib = ia + na, ib + nb
        links, j = [], 0
        for i, end in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(eb) and (eb[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        corpus.update(links)
        found.append((key, len(a), len(b), links, groups))
    most = Counter()
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    for key, na, nb, links, groups in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        yield (key, na, nb, len(groups or []), len(links), sum(corpus[x] == most[x[1]] for x in links), sum(corpus[x] for x in links),
               "" if groups is None else hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    made = random.Random(3)
    texts = [None, "", " ", "   ", "a ", "\n", "a  b \n\tc  ", "<|endoftext|> and <s> </s>", "<0x0A>", "U+2581 ▁ here", "▁", "ﬁ ½ Å é", "é", "東京 タワー 🙂🙂", " x y",
             "don't we'll I'M", "123456 7890.5", "\r\n\r\n", "\x00\x07", "x" * 3000, "ab" * 2000, "Ωμέγα, привет мир", "﻿bom", "​zero"]
    alphabet = "abcde  ..,\n\téß'0123▁漢🙂A "
    texts += ["".join(made.choices(alphabet, k=made.randint(1, 120))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(9, "twice"), (9, "twice"), (None, "no id")]


@pytest.mark.parametrize("frequent", [1 << 19, 5, 0])
def test_small_tables(spark, rows, frequent):
    docs = spark.createDataFrame([(k, t, 1, 2, "s") for k, t in rows], "doc_id long, text string, row long, pair long, sha string").repartition(3)
    assert Counter(map(tuple, align_documents(docs, *PATHS, frequent=frequent).collect())) == Counter(brute(rows))
    assert align_documents(docs.limit(0), *PATHS).count() == 0


def test_a_table_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, align_documents(docs, *PATHS).collect())) == Counter(brute(rows))


def test_align_against_sets():
    made = random.Random(1)
    for _ in range(300):
        n = made.randint(1, 60)
        a, b = (sorted({*made.sample(range(1, n + 1), made.randint(0, n)), n}) for _ in range(2))
        last_a, last_b, link_a, link_b = align(np.array(a), np.array(b))
        assert [x for x, end in zip(a, last_a) if end] == [x for x, end in zip(b, last_b) if end] == sorted(set(a) & set(b))
        overlap = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(([0] + a)[i], ([0] + b)[j]) < min(a[i], b[j])]
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == overlap
