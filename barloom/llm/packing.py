"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .differencing import partition

CAPACITY = 2048
END_ID = 1
WINDOWS = 64
LARGEST_PIECE = 512
TAIL = (0.8, 0.6)
#: A block of pieces ends where so many tokens a window would stay free, least and most.
SLACK = (4, 12)


@lru_cache(maxsize=4)
def encoder(path: str, plain_text: bool = False):
    """text -> ids of a ``tokenizers`` JSON file, without special tokens of the template: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``. ``plain_text``: strings of special tokens are ordinary text.

    Where the file says that it is a plain byte-level BPE, tiktoken computes the same ids four times as fast. It refuses some texts (very long runs of white space exceed its pattern's stack); these, whole, and all of any other file are left to
    ``tokenizers``.
    """
    import json

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = plain_text
    by_library = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain_byte_level(spec):
        return by_library

    import public_tokenizers
    import tiktoken

    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    allowed = set() if plain_text else "all"

    def encode(text: str) -> list[int]:
        try:  # encode_ordinary would panic, which is no Exception
            return encoding.encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            return by_library(text)

    return encode


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level files: itself where it prints, else the next one from 256 on."""
    points = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in points} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in points)}


def _plain_byte_level(spec: dict) -> bool:
    """Whether a file normalises nothing, cuts by the byte-level pattern, and merges pieces in the order of their ids."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding")
        and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    )
    if not plain:
        return False
    vocab, letters = model["vocab"], byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    if not set("".join(p for p in vocab if p not in special)) <= set(letters):
        return False
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return all(a < b for a, b in zip([0, *made], made, strict=False)) and len(made) + 256 == len(set(vocab) - special)


def windows_of(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece and the number of windows: as few as hold the tokens, one more whenever one overflows."""
    count = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = partition(lengths, count)
        if np.bincount(window, weights=lengths, minlength=count).max() <= capacity:
            return window, count
        count += 1


def cut(total: int, capacity: int, largest: int, tail: tuple[float, ...] = TAIL) -> list[int]:
    """Lengths of a document's pieces: full windows first, the rest in near-equal pieces of at most ``largest``.

    The last piece is cut again by the shares in ``tail``: without some small pieces, differencing can't even out windows.
    """
    rest = total % capacity
    n = -(-rest // largest)
    pieces = [capacity] * (total // capacity) + [rest // n + (i < rest % n) for i in range(n)]
    if rest:
        last = pieces.pop()
        for share in tail:
            if part := int(last * share):
                pieces.append(part)
                last -= part
        pieces.append(last)
    return pieces


def pack_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, windows: int = WINDOWS, largest: int = LARGEST_PIECE, with_ids: bool = False) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its ids and then id 1. Its full windows become sequences of their own; the rest is cut into
    pieces. Pieces meet in blocks of about ``windows`` windows, and each block is differenced into near-equal
    windows. Blocks form within a task, in the order of its rows, so nothing is shuffled and a task that runs again
    gives the same rows. Other columns are left out, very long texts are packed whole. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (unique,
    not gapless), offset (and ids, with ``with_ids``). A null or empty text is the single id 1; repeated rows and
    null doc_ids are documents like any other; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        base, taken = TaskContext.get().partitionId() << 40, 0
        out, pending, held = [], [], 0

        def place(pieces: list) -> None:
            nonlocal taken
            lengths = np.array([p[2] for p in pieces], dtype=np.int64)
            window, count = windows_of(lengths, capacity)
            filled = [0] * count
            for p, w in zip(pieces, window, strict=True):
                out.append((*p, base + taken + int(w), filled[w]))
                filled[w] += p[2]
            taken += count

        def flush() -> pd.DataFrame:
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "sequence_id", "offset"]
            pdf = pd.DataFrame(out, columns=columns)
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            out.clear()
            return pdf

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                ids = np.array([*encode(text), END_ID], dtype="<u4")
                at = 0
                for n in cut(len(ids), capacity, largest):
                    own = ids[at : at + n]
                    piece = (None if pd.isna(doc_id) else int(doc_id), at, n, zlib.crc32(own.tobytes()), len(ids), *([own.tolist()] if with_ids else []))
                    at += n
                    if n == capacity:
                        out.append((*piece, base + taken, 0))
                        taken += 1
                        continue
                    pending.append(piece)
                    held += n
                    count = -(-held // capacity)
                    # a block ends where its windows would be nearly full, or once it is half as large again
                    if count >= windows and (SLACK[0] * count <= count * capacity - held <= SLACK[1] * count or count >= 1.5 * windows):
                        place(pending)
                        pending, held = [], 0
            if len(out) >= 20_000:
                yield flush()
        if pending:
            place(pending)
        if out:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + ("ids array<int>, " if with_ids else "") + "sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token arrays of the sequences of ``pack_tokens(with_ids=True)``: sequence_id, ids, doc_ids. A sequence has at most capacity ids, so groups are bounded."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(pieces.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
