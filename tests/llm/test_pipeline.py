"""The pipeline against a brute-force version of what each stage decides, and with hostile rows."""

import itertools
import os
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import WORDS, brute_components, brute_fingerprint, brute_similar, text

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark):
    """Documents with toxic ones, copies and personal data planted, and labels of half of them."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        t = text(rng, rng.randint(20, 200))
        if i % 6 == 0:
            t += " " + " ".join(rng.choice(["vilest", "nasty"]) for _ in range(3))
        if i % 7 == 0:
            t += f" mail x{i}@y.org or 10.0.0.{i}"
        rows.append((i, t, "en", "s", len(t)))
        if i < 120:
            labels.append((i, 1, int(i % 6 == 0)))
    rows.append((290, "blank" + " " * 1_000_000 + "s", "en", "s", 1_000_006))
    rows += [(300 + k, rows[k][1], "en", "s", rows[k][4]) for k in range(1, 20, 3)] + [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "no id " + " ".join(WORDS), "en", "s", 5), rows[1]]
    out = tempfile.mkdtemp(prefix="barloom-pipe-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(out, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(out, "labels.parquet"))
    return out, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        to = tempfile.mkdtemp(prefix="barloom-stage-") + "/t"
        stage(spark, docs, path).write.parquet(to)
        docs = spark.read.parquet(to)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    civil = [r for r in rows if not ("vilest" in (r[1] or "") or "nasty" in (r[1] or ""))]
    assert sorted(str(r.doc_id) for r in seen["toxicity"]) == sorted(str(r[0]) for r in civil)
    linked = brute_components([(r[0], brute_fingerprint(r[1])) for r in civil])
    assert sorted(str(r.doc_id) for r in seen["simhash_near_dedup"]) == sorted({str(c) for c in linked})
    assert len(seen["pii"]) == len(seen["simhash_near_dedup"])
    assert not any("@y.org" in (r.text or "") or "10.0.0." in (r.text or "") for r in seen["pii"])
    assert {str(r.doc_id) for r in seen["packing"]} == {str(r.doc_id) for r in seen["pii"]}
    for _, pieces in itertools.groupby(sorted(seen["packing"], key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        assert sum(p.length for p in pieces) <= 2048


def test_run(spark, folder):
    """The rows of a whole run against the four stages told plainly: words that are toxic, Jaccard similarity, patterns, and the library's ids."""
    path, rows = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert set(got[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    civil = [(r[0], r[1]) for r in rows if not ("vilest" in (r[1] or "") or "nasty" in (r[1] or ""))]
    named = dict(r for r in civil if r[0] is not None)
    kept = {i: named[i] for i in brute_similar(list(named.items()))[1]} | {r[0]: r[1] for r in civil if r[0] is None}
    redacted = {i: re.sub(r"10\.0\.0\.\d+", "[IP]", re.sub(r"x\d+@y\.org", "[EMAIL]", t or "")) for i, t in kept.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in redacted.items()}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i])
            assert p.ids_crc32 == zlib.crc32(np.array(want[i][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(want[i])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
