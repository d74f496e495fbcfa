"""Collocations against a count of all n-grams."""

import random
import re
from collections import Counter

import pytest

from reqsieve.llm import collocations

SCHEMA = "text string, lang string, words string, block string, n string, `a.b` string"


def brute(rows, longest=5, least=100, keep=2000, covered=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    picked = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for lang in n:
        found = []
        for (own, w), a in picked.items():
            if own != lang or any(
                own2 == lang and len(t) > len(w) and 100 * b >= covered * a
                and any(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))
                for (own2, t), b in picked.items()
            ):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(x) for x in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize("block_words", [30, 1_000_000])
def test_against_brute_force(spark, block_words):
    r = random.Random(block_words)
    rows = []
    for i in range(300):
        words = [r.choice(["a", "b", "C", "é", "dd", "a.b", "x,", "\n", "\t", "y"]) for _ in range(r.randint(0, 40))]
        if i % 3 == 0:
            words[5:5] = ["The", "quick", "brown", "fox", "jumps", "High"]
        rows.append((" ".join(words), r.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), ("  ..\t", "fr"), ("a " * 5000, "en"), ("\x00 \x1f\x85  z", "en")] + [rows[0]] * 40
    for least, keep, covered in ((20, 2000, 100), (9, 7, 60)):
        got = run(spark, rows, min_count=least, keep=keep, covered=covered, block_words=block_words)
        assert got == brute(rows, least=least, keep=keep, covered=covered)


def test_many_languages_and_none(spark):
    rows = [("one two three", f"l{i}") for i in range(50)] * 3
    assert run(spark, rows, min_count=3, block_words=20) == brute(rows, least=3)
    assert run(spark, []) == []


def test_products_beyond_64_bits(spark):
    """A score is exact though its products pass 64 bits."""
    big = 3_000_000_019
    row = spark.sql(f"SELECT 1000 * CAST({big} AS DECIMAL(19, 0)) * CAST({big * 999} AS DECIMAL(19, 0)) div (CAST(7 AS DECIMAL(19, 0)) * CAST({big} AS DECIMAL(19, 0))) AS s")
    assert row.first().s == 1000 * big * big * 999 // (7 * big)


def test_a_block_sends_each_share_one_row(spark):
    """Groups are no rows between blocks and shares, so these do not grow with the frequent groups."""
    r = random.Random(5)
    rows = [(" ".join(str(r.randint(0, 60)) for _ in range(200)), "en") for _ in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    relation = collocations._word_relation(docs, 4_000).cache()
    blocks, shares = relation.count(), 3
    replies = collocations._frequent_words(relation, shares, 2).cache()
    pairs = collocations._next_relation(relation, replies, shares).cache()
    back = collocations._frequent_pairs(pairs, shares, 2).cache()
    groups = pairs.selectExpr("sum(size)").first()[0]
    frequent = back.where("block IS NULL").count()
    assert groups > 100 * blocks * shares and frequent > 3_000
    for sent in (replies.where("block IS NOT NULL"), pairs.selectExpr("inline(packets)"), back.where("block IS NOT NULL")):
        assert 0 < sent.count() <= blocks * shares
    assert back.where("block IS NULL").selectExpr("sum(f)").first()[0] <= 199 * 100
    assert back.where("block IS NULL").selectExpr("count(DISTINCT id)").first()[0] == frequent
    for df in (relation, replies, pairs, back):
        df.unpersist()
    assert run(spark, rows, min_count=5, block_words=4_000, share_words=100) == brute(rows, least=5)
