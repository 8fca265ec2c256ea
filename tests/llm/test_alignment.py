"""Alignment of two tokenizers against a brute-force version that asks the libraries, with texts that they can't spell."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import alignment
from barloom.llm.packing import byte_letters, encoder

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def brute(rows):
    own_a = Tokenizer.from_file(A)
    own_a.encode_special_tokens = True
    own_b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, vocab = byte_letters(), {i: p for p, i in own_a.get_vocab().items()}
    spell_b = lambda i: bytes([int(own_b.id_to_piece(i)[3:5], 16)]) if own_b.is_byte(i) else own_b.id_to_piece(i).replace("▁", " ").encode()
    told, counts = [], Counter()
    for doc_id, text in rows:
        a = own_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own_b.encode(text) if text else []
        spelled_a, spelled_b = [bytes(letters[c] for c in vocab[i]) for i in a], [spell_b(i) for i in b]
        want = b" " + (text or "").encode()
        if not text or b"".join(spelled_a) != want or b"".join(spelled_b) != want:
            told.append((doc_id, 0, 0, 0, [], ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
        common = sorted(set(end_a) & set(end_b))
        groups, links = [], []
        for low, high in zip([0, *common], common, strict=False):
            xs = [k for k, e in enumerate(end_a) if low < e <= high]
            ys = [k for k, e in enumerate(end_b) if low < e <= high]
            groups.append(",".join(str(a[k]) for k in xs) + "|" + ",".join(str(b[k]) for k in ys))
            links += [(a[i], b[j]) for i in xs for j in ys if end_a[i] - len(spelled_a[i]) < end_b[j] and end_b[j] - len(spelled_b[j]) < end_a[i]]
        counts.update(links)
        told.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((i, a, b, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), s) for i, a, b, g, ls, s in told), key=str)


def rows_of(seed=4):
    rng = random.Random(seed)
    words = "the of Übermut déjà naïve hello Hello aaa aaaa aa 1234 2024-01-02 e.g. don't I'll www.example.com/x?y=1 日本語 русский 🙂 ﬁ   \t \n  x̂ <|endoftext|> <s> </s> <unk> <0x41> supercalifragilistic".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   lead"), (104, "a▁b"), (105, "▁"), (106, "\0\x01"), (107, "aaaaaaaaaaaaaaaaaaaaaaaa"), (108, "\r\n\r\n"), (109, "trail "), (None, "no id"), (5, rows[5][1]), (5, "another"), (110, rows[7][1])]
    return rows + [(200 + i, "aa a aaa a" * i) for i in range(12)]


@pytest.mark.parametrize(("most", "task_pairs"), [(1 << 18, 1 << 20), (0, 8), (40, 100)])
def test_alignment_against_brute_force(spark, monkeypatch, most, task_pairs):
    monkeypatch.setattr(alignment, "SLICE", 2000)
    rows = rows_of()
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, row long, pairs string, kind int").repartition(3)
    got = alignment.align(frame, A, B, most, task_pairs)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_long_texts(spark):
    rows = [(1, " " * 1_000_000), (2, "ab " * 200_000), (3, "\n" * 700_000 + "end")]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    library = Tokenizer.from_file(A)
    for i, t in rows:
        assert got[i].n_a == len(library.encode(" " + t, add_special_tokens=False).ids)
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups


def test_nothing_to_align(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    got = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_identities_never_enter_the_pairs(spark):
    frame = spark.createDataFrame([(1, "the of and"), (2, "the of and")], "doc_id long, text string").coalesce(1)
    first = alignment._encode(frame, A, B, 100)
    assert first.where("kind = 2").count() == 0
    assert first.where("kind = 1").select(F.explode("counts").alias("n")).agg(F.sum("n")).first()[0] == 6


def test_special_strings_are_plain_text():
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    text = "x<|endoftext|> y"
    assert encoder(A, plain_text=True)(text) == own.encode(text, add_special_tokens=False).ids
    assert 50256 not in encoder(A, plain_text=True)(text)
    assert 50256 in encoder(A)(text)


@pytest.mark.parametrize("run", [" ", "\n", "a", " \t", "　"])
def test_long_runs_are_encoded_like_the_library(run):
    text = "x " + run * 700_000 + "y<|endoftext|>"
    for plain in (True, False):
        own = Tokenizer.from_file(A)
        own.encode_special_tokens = plain
        assert encoder(A, plain_text=plain)(text) == own.encode(text, add_special_tokens=False).ids
