"""Vocabulary, encoding, decoding."""

import json

import pytest

from reqsieve.operators import tokens
from reqsieve.sources import vocab_io

TEXTS = ["GET /a?x=1", "GET /b?x=2", "", "   ", "GET /a"]


def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def table(df):
    return {r.token: r.id for r in df.collect()}


def test_vocabulary_order_and_size(spark):
    # "/" and "GET " occur three times each, "=", "?", "a" and "x" twice, the rest once.
    vocab = table(tokens.build_vocab(corpus(spark), vocab_size=9))
    assert vocab == {
        "[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "/": 4, "GET ": 5, "=": 6, "?": 7, "a": 8,
    }
    assert len(table(tokens.build_vocab(corpus(spark), vocab_size=1))) == 4


def test_encode_and_decode(spark):
    df = corpus(spark)
    vocab = tokens.build_vocab(df, vocab_size=10)
    enc = {r.id: r for r in tokens.encode(df, vocab, "id", max_length=8).collect()}
    # x is the tenth entry, "1" is unknown and cut off.
    assert enc[0].input_ids == [2, 5, 4, 8, 7, 9, 6, 3]
    assert enc[0].attention_mask == [1] * 8
    assert enc[2].input_ids == [2, 3, 0, 0, 0, 0, 0, 0] == enc[3].input_ids
    assert enc[4].attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    back = {
        r.id: r.text
        for r in tokens.decode(tokens.encode(df, vocab, "id", max_length=8), vocab, "id").collect()
    }
    assert back == {0: "GET /a?x=", 1: "GET /[UNK]?x=", 2: "", 3: "", 4: "GET /a"}


def test_decode_spaces_between_words(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("/", 6)], "token string, id int")
    df = spark.createDataFrame([(1, [2, 4, 5, 6, 4, 99, 5, 3, 0])], "id int, input_ids array<int>")
    # An unknown id is an empty word and still gets its blank.
    assert tokens.decode(df, vocab, "id").first().text == "a b/a  b"


def test_shortest_length(spark):
    df = corpus(spark)
    vocab = tokens.build_vocab(df)
    assert {tuple(r.input_ids) for r in tokens.encode(df, vocab, "id", max_length=2).collect()} == {(2, 3)}
    with pytest.raises(ValueError):
        tokens.encode(df, vocab, "id", max_length=1)


def test_vocab_json(spark, tmp_path):
    vocab = tokens.build_vocab(corpus(spark), vocab_size=12)
    vocab_io.save_vocab(vocab, str(tmp_path / "v"), 12)
    text = spark.read.text(str(tmp_path / "v")).first().value
    assert json.loads(text) == {"token_to_id": table(vocab), "vocab_size": 12}
    assert table(vocab_io.load_vocab(spark, str(tmp_path / "v"))) == table(vocab)


def test_loaded_special_tokens_keep_their_ids(spark):
    df = spark.createDataFrame([('{"token_to_id": {"[PAD]": 9, "a": 4}, "vocab_size": 5}',)], "value string")
    assert table(vocab_io.vocab_from_json(df)) == {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4}
