"""Ids and decoded texts against the library's, whole text by whole text."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from reqsieve.llm import chunk_reuse
from reqsieve.llm.encoders import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, row string, body string, ids string, `a.b` string"


def expected(rows, path):
    library = Tokenizer.from_file(path)
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((-1 if i is None else i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(told.encode())))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    got = chunk_reuse.encode_and_decode(df, **options)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return sorted((-1 if x[0] is None else x[0], *x[1:]) for x in got.collect())


def prose(r, n):
    alphabet = "abcdefghijklmnop'é" + "你Ω9.,"
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(n))


def corpus():
    r = random.Random(13)
    shared = [prose(r, 300) for _ in range(6)]
    rows = []
    for i in range(120):
        text = prose(r, r.randint(0, 200))
        if i % 2:
            at = r.randint(0, len(text))
            text = text[:at] + r.choice(["", " ", "\n\n"]) + r.choice(shared) + r.choice(["", " ", "x", "<|end"]) + text[at:]
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, shared[0]), (203, shared[0]), (203, shared[0]), (204, shared[1] * 40),
             (205, "a" * 30_000), (206, "a" * 30_000), (207, shared[2].replace(" ", "<|endoftext|> ")),
             (208, shared[2].replace(" ", "<|endoftext|> ")), (209, "  " * 5000 + shared[3]), (210, shared[3] + "  " * 5000)]
    return rows


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_the_library(spark, name):
    rows, path = corpus(), tokenizer_path(name)
    assert run(spark, rows, tokenizer=path) == expected(rows, path)


def test_full_bitmap_and_no_rows(spark):
    """With one-byte marks all chunks look repeated and travel; the result is the same."""
    rows = corpus()
    assert run(spark, rows, mark_bits=15) == expected(rows, tokenizer_path())
    assert run(spark, []) == []


def test_cuts_follow_content():
    r = random.Random(1)
    same = prose(r, 3000).encode()
    texts = [same, prose(r, 100).encode() + same, b"", b"x", same + b"tail"]
    first, second, *_, last = (list(c) for c in chunk_reuse.chunks_of(texts))
    assert len(first) > 8
    digests = [d for _, _, d in first]
    assert set(digests[1:]) <= {d for _, _, d in second} and digests[:-1] == [d for _, _, d in last][: len(digests) - 1]
    for text, chunks in zip(texts, chunk_reuse.chunks_of(texts)):
        assert b"".join(text[a:b] for a, b, _ in chunks) == text


def test_plan_of_one_text():
    """Chunks come back and are joined to the ids of the whole text."""
    kept = encoder(tokenizer_path(), "<u2")
    ids_of = lambda data: kept.ids(data.decode())
    text = prose(random.Random(3), 2000).encode()
    (chunks,) = chunk_reuse.chunks_of([text])
    reused, gaps, shares = chunk_reuse.plan(text, chunks, lambda d: d[0] % 3 > 0, ids_of)
    assert len(reused) > 4
    cores = [ids_of(c.inner) for *_, c in reused]
    assert chunk_reuse.joined(cores, gaps, shares) == ids_of(text)
    assert chunk_reuse.joined([c[2:] for c in cores], gaps, shares) is None
