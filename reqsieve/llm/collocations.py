"""Phrase collocations by set-oriented relational mining (SETM).

Relation R_k holds the occurrences of the frequent phrases of k words: where one starts, and
which. R_(k+1) comes from a merge-join of the sorted relation R_k with itself at adjacent
positions of a piece, a count per group, and a semi-join with the groups that are frequent.
Then the next length follows. Every part of a frequent phrase is frequent, so nothing is lost.

Texts are dealt into blocks of whole documents of one language, of about ``BLOCK_WORDS`` words.
A block is one row: its relation is stored sorted by position, a piece's words stand at
adjacent positions, and pieces are one position apart. A merge-join thus stays within a block,
while group counts and the semi-join run over all blocks: groups are dealt by a hash into
shares, of about ``SHARE_WORDS`` words of the input. A block sends each share one row of packed
arrays, with each of its groups once and the group's count. The share adds the counts up and
sends back, one row a block, which of these groups are frequent and their ids. A very frequent
phrase is thus one entry a block, and no task holds more than a block or a share.
Phrases are known by exact ids: a word by an id of (language, word), a longer phrase by the ids
of its two parts that are one word shorter. Every relation is written to the shared folder
before the next length reads it.

A phrase that lies in a frequent longer one at a given share lies in one that is a single word
longer at that share too, since counts only fall with length. So only those are looked at.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each;
texts without words add nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import discard, stored

LONGEST = 5
MIN_COUNT = 100
KEEP = 2000
# A phrase goes where a longer one has at least this percentage of its count.
COVERED = 100
BLOCK_WORDS = 500_000
SHARE_WORDS = 2_000_000

# Pieces end at . , ; : ! ? and at line feed to carriage return; words end at
# blank and tab. A-Z become lower case.
_BYTES = bytes(
    10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if chr(b) in " \t" else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)


class _Codes(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 byte by byte, all lowest bytes first, compressed: small ones take little room."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()
    return bytes([width]) + len(values).to_bytes(6, "little") + pa.compress(planes, "zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:7], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(pa.decompress(packed[7:], width * n, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


def _packed_words(words: list[bytes]) -> bytes:
    """Words, in which no line feed occurs."""
    joined = b"\n".join(words)
    return len(joined).to_bytes(6, "little") + pa.compress(joined, "zstd", asbytes=True)


def _words(packed: bytes) -> list[bytes]:
    size = int.from_bytes(packed[:6], "little")
    return pa.decompress(packed[6:], size, "zstd", asbytes=True).split(b"\n") if size else []


def _relation(at: np.ndarray, code: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending positions, as steps from one to the next, and codes."""
    return _packed(np.diff(at, prepend=0)), _packed(code)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _pair_hashes(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    mixed = pre.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suf.astype(np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(32)


def _shares(hashes: np.ndarray, shares: int) -> np.ndarray:
    """The share of each hash of 32 bits; shares ascend with the hashes."""
    return (hashes * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _runs(share: np.ndarray) -> list[tuple[int, int, int]]:
    """(share, from, to) of ascending shares."""
    own, first = np.unique(share, return_index=True)
    return list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(share)]))


# What stands between words: nothing is an empty part, a line feed the end of a piece.
_EMPTY, _END = 0, 1


class _Block:
    """Documents of one language: their words as codes, piece after piece."""

    def __init__(self) -> None:
        self.codes = _Codes({b"": _EMPTY, b"\n": _END})
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, text: bytes) -> None:
        words = text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        self.parts.append(codes[codes != _EMPTY])
        self.held += len(self.parts[-1])

    def row(self) -> tuple[bytes, bytes, int, bytes, bytes, int]:
        """Positions and codes of R_1, its number of words, the different words in the order of
        their hashes, how often each occurs, and the number of these."""
        codes = np.concatenate(self.parts)
        at = np.flatnonzero(codes != _END)
        codes, words = codes[at] - 2, list(self.codes)[2:]
        order = np.argsort(_word_hashes(words), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n = np.bincount(codes, minlength=len(words))[order]
        return *_relation(at, rank[codes]), len(at), _packed_words([words[i] for i in order]), _packed(n), len(words)


def _word_relation(docs: DataFrame, block_words: int) -> DataFrame:
    """R_1 in blocks, unpruned: a code per position, and the words and counts of the codes."""
    schema = "block bigint, lang string, at binary, code binary, held bigint, words binary, n binary, size bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        blocks: dict[str, _Block] = {}

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number
            columns = blocks.pop(lang).row()
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([lang]), *(pa.array([c]) for c in columns)],
                names=["block", "lang", "at", "code", "held", "words", "n", "size"],
            )

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                block = blocks.get(lang)
                if block is None:
                    block = blocks[lang] = _Block()
                block.add(text.as_py())
                if block.held >= block_words:
                    yield row(lang)
                elif len(blocks) > 1 and sum(b.held for b in blocks.values()) >= 2 * block_words:
                    # Many languages: the fullest block goes, so that open ones stay bounded.
                    yield row(max(blocks, key=lambda x: blocks[x].held))
        for lang in list(blocks):
            yield row(lang)

    texts = docs.selectExpr("coalesce(lang, 'und') AS lang", "CAST(coalesce(text, '') AS BINARY) AS text")
    return texts.mapInArrow(run, schema)


# What a share makes of its groups: for each block the codes from ``first`` on that are frequent,
# as bits, and their numbers in the share; and, without a block, the frequent groups themselves.
_REPLY = "share bigint, block bigint, first bigint, marks binary, ids binary, id bigint, f bigint"


def _replies(share: int, packets: list[tuple[int, int, int]], number: np.ndarray) -> list[dict]:
    """A reply to each (block, first, length); ``number`` is that of each entry in turn, or -1."""
    rows, at = [], 0
    for block, first, length in packets:
        own = number[at : at + length]
        at += length
        frequent = own >= 0
        if frequent.any():
            rows.append({"share": share, "block": block, "first": first,
                         "marks": np.packbits(frequent).tobytes(), "ids": _packed(own[frequent])})
    return rows


def _share_result(replies: list[dict], found: dict[str, pa.Array], more: dict[str, pa.DataType]) -> pa.Table:
    """Replies and frequent groups as one table."""
    kinds = {"share": pa.int64(), "block": pa.int64(), "first": pa.int64(), "marks": pa.binary(), "ids": pa.binary(),
             "id": pa.int64(), "f": pa.int64(), **more}
    size = len(found["id"])
    columns = [
        pa.chunked_array([pa.array([r.get(c) for r in replies], t), found[c].cast(t) if c in found else pa.nulls(size, t)])
        for c, t in kinds.items()
    ]
    return pa.table(columns, names=list(kinds))


def _frequent_words(relation: DataFrame, shares: int, min_count: int) -> DataFrame:
    """Replies to the blocks of R_1, and the frequent words with their language."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, words, n in zip(*(batch[c] for c in ("block", "lang", "words", "n"))):
                words, n = _words(words.as_py()), _numbers(n.as_py())
                runs = _runs(_shares(_word_hashes(words), shares))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in runs], pa.int64()),
                     pa.array([block.as_py()] * len(runs), pa.int64()), pa.array([lang.as_py()] * len(runs), pa.string()),
                     pa.array([a for _, a, _ in runs], pa.int64()),
                     pa.array([_packed_words(words[a:b]) for _, a, b in runs], pa.binary()),
                     pa.array([_packed(n[a:b]) for _, a, b in runs], pa.binary())],
                    names=["share", "block", "lang", "first", "words", "n"],
                )

    def count(packets: pa.Table) -> pa.Table:
        share = packets["share"][0].as_py()
        lists = [_words(x.as_py()) for x in packets["words"]]
        sizes = [len(x) for x in lists]
        words = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        langs = packets["lang"].combine_chunks().dictionary_encode()
        many = max(1, len(words.dictionary))
        keys = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes) * many + words.indices.to_numpy()
        groups, entry = np.unique(keys, return_inverse=True)
        f = np.zeros(len(groups), np.int64)
        np.add.at(f, entry, np.concatenate([_numbers(x.as_py()) for x in packets["n"]]))
        frequent = f >= min_count
        number = np.where(frequent, np.cumsum(frequent) - 1, -1)
        replies = _replies(share, list(zip(packets["block"].to_pylist(), packets["first"].to_pylist(), sizes)), number[entry])
        groups = groups[frequent]
        found = {"id": pa.array(number[frequent] * shares + share), "f": pa.array(f[frequent]),
                 "lang": langs.dictionary.take(pa.array(groups // many)), "word": words.dictionary.take(pa.array(groups % many))}
        return _share_result(replies, found, {"lang": pa.string(), "word": pa.binary()})

    held = relation.where("size > 0").select("block", "lang", "words", "n")
    dealt = held.mapInArrow(deal, "share bigint, block bigint, lang string, first bigint, words binary, n binary")
    return dealt.groupBy("share").applyInArrow(count, _REPLY + ", lang string, word binary")


def _next_relation(relation: DataFrame, replies: DataFrame, shares: int) -> DataFrame:
    """From R_k in blocks and the replies that name its frequent groups, the groups of R_(k+1).

    One row per block: ``at`` and ``code`` of every occurrence, and for each share the ids of
    the phrase without its last and without its first word, and its count in the block. Codes
    ascend with share and ids.
    """
    packet = pa.struct([("share", pa.int64()), ("first", pa.int64()), ("pre", pa.binary()), ("suf", pa.binary()), ("n", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, at, code, size in zip(*(left[c].to_pylist() for c in ("block", "at", "code", "size"))):
            at, code = np.cumsum(_numbers(at)), _numbers(code)
            # Semi-join: codes without an id are not frequent.
            known = np.full(size, -1, np.int64)
            for share, first, marks, own in zip(*(right[c].to_pylist() for c in ("share", "first", "marks", "ids"))):
                codes = first + np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8)))
                known[codes] = _numbers(own) * shares + share
            codes = np.flatnonzero(known >= 0)
            codes = codes[np.argsort(known[codes])]
            ids = known[codes]
            place = np.full(size, -1, np.int64)
            place[codes] = np.arange(len(codes))
            place = place[code]
            at, place = at[place >= 0], place[place >= 0]
            # Merge-join of the relation with itself at the position after.
            first = np.flatnonzero(at[1:] == at[:-1] + 1)
            if not len(first):
                continue
            groups, found, n = np.unique(place[first] * len(ids) + place[first + 1], return_inverse=True, return_counts=True)
            pre, suf = ids[groups // len(ids)], ids[groups % len(ids)]
            share = _shares(_pair_hashes(pre, suf), shares)
            order = np.argsort(share, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pre, suf, n = pre[order], suf[order], n[order]
            packets = [
                {"share": s, "first": a, "pre": _packed(pre[a:b]), "suf": _packed(suf[a:b]), "n": _packed(n[a:b])}
                for s, a, b in _runs(share[order])
            ]
            rows.append((block, *_relation(at[first], rank[found]), len(groups), packets))
        names = ["block", "at", "code", "size", "packets"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(packet)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    schema = (
        "block bigint, at binary, code binary, size bigint, "
        "packets array<struct<share: bigint, first: bigint, pre: binary, suf: binary, n: binary>>"
    )
    states = relation.select("block", "at", "code", "size").groupBy("block")
    named = replies.where("block IS NOT NULL").selectExpr("block AS owner", "share", "first", "marks", "ids")
    return states.cogroup(named.groupBy("owner")).applyInArrow(run, schema)


def _frequent_pairs(relation: DataFrame, shares: int, min_count: int) -> DataFrame:
    """Replies to the blocks of R_(k+1), and its frequent groups."""

    def count(packets: pa.Table) -> pa.Table:
        share = packets["share"][0].as_py()
        parts = [[_numbers(x.as_py()) for x in packets[c]] for c in ("pre", "suf", "n")]
        sizes = [len(x) for x in parts[0]]
        pre, suf, n = map(np.concatenate, parts)
        order = np.lexsort((suf, pre))
        pre, suf = pre[order], suf[order]
        new = np.append(True, (pre[1:] != pre[:-1]) | (suf[1:] != suf[:-1]))
        first = np.flatnonzero(new)
        f = np.add.reduceat(n[order], first)
        frequent = f >= min_count
        number = np.where(frequent, np.cumsum(frequent) - 1, -1)
        entry = np.empty(len(order), np.int64)
        entry[order] = number[np.cumsum(new) - 1]
        replies = _replies(share, list(zip(packets["block"].to_pylist(), packets["first"].to_pylist(), sizes)), entry)
        found = {"id": pa.array(number[frequent] * shares + share), "f": pa.array(f[frequent]),
                 "pre": pa.array(pre[first][frequent]), "suf": pa.array(suf[first][frequent])}
        return _share_result(replies, found, {"pre": pa.int64(), "suf": pa.int64()})

    dealt = relation.selectExpr("block", "inline(packets)")
    return dealt.groupBy("share").applyInArrow(count, _REPLY + ", pre bigint, suf bigint")


def _phrases(counts: DataFrame, shorter: DataFrame) -> DataFrame:
    """Frequent phrases with their words and the counts of all that they begin and end with."""
    head = shorter.selectExpr("id AS pre", "lang", "words", "heads")
    tail = shorter.selectExpr("id AS suf", "element_at(words, -1) AS word", "tails")
    return counts.join(head, "pre").join(tail, "suf").selectExpr(
        "id", "pre", "suf", "lang", "f", "concat(words, array(word)) AS words",
        "concat(heads, array(f)) AS heads", "concat(tails, array(f)) AS tails",
    )


def frequent_phrases(
    docs: DataFrame, longest: int, min_count: int, block_words: int, share_words: int = SHARE_WORDS
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length the frequent phrases:
    id, pre, suf, lang, f, words, heads, tails."""
    relation = stored(_word_relation(docs, block_words), "word-relation", "zstd")
    sizes = stored(relation.groupBy("lang").agg(F.sum("held").alias("n")), "language-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // share_words))
    replies = stored(_frequent_words(relation, shares, min_count), "frequent-words", "zstd")
    levels = [replies.where("block IS NULL").selectExpr(
        "id", "lang", "word", "f", "array(word) AS words", "array(f) AS heads", "array(f) AS tails"
    )]
    for length in range(2, longest + 1):
        before, relation = relation, stored(_next_relation(relation, replies, shares), "phrase-relation", "zstd")
        discard(before)
        replies = stored(_frequent_pairs(relation, shares, min_count), "frequent-groups", "zstd")
        counts = replies.where("block IS NULL").select("id", "pre", "suf", "f")
        levels.append(stored(_phrases(counts, levels[-1]), "frequent-phrases"))
    discard(relation)
    return sizes, levels


def collocations(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, keep: int = KEEP, covered: int = COVERED,
    block_words: int = BLOCK_WORDS, share_words: int = SHARE_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``keep`` phrases.

    A phrase of count a, cut into parts of counts l and r among n words, scores
    floor(1000 a n / (l r)) at its lowest-scoring cut.
    """
    sizes, levels = frequent_phrases(docs.select("lang", "text"), longest, min_count, block_words, share_words)
    wide = lambda x: f"CAST({x} AS DECIMAL(19, 0))"
    cut = (
        f"transform(sequence(1, size(words) - 1), k -> struct("
        f"CAST(1000 * {wide('f')} * {wide('n')} div ({wide('heads[k - 1]')} * {wide('tails[size(words) - k - 1]')}) AS BIGINT) AS score, "
        "k AS k, heads[k - 1] AS l, tails[size(words) - k - 1] AS r))"
    )
    scored = None
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        kept = level
        if longer is not None:
            inside = longer.selectExpr("pre AS id", "f AS over").unionByName(longer.selectExpr("suf AS id", "f AS over"))
            most = inside.groupBy("id").agg(F.max("over").alias("over"))
            kept = level.join(most, "id", "left").where(f"over IS NULL OR 100 * over < {covered} * f")
        part = kept.select("lang", "words", "f", "heads", "tails")
        scored = part if scored is None else scored.unionByName(part)
    best = scored.join(sizes, "lang").selectExpr(
        "lang", "CAST(array_join(transform(words, w -> CAST(w AS STRING)), ' ') AS STRING) AS phrase", "f AS a", "n", f"array_min({cut}) AS cut"
    ).selectExpr("lang", "phrase", "a", "cut.l AS l", "cut.r AS r", "n", "cut.score AS score")
    order = "ORDER BY score DESC, a DESC, phrase"
    # A language's phrases are dealt out first, so that the last window sees few of them.
    first = best.selectExpr("*", "pmod(xxhash64(phrase), 64) AS share").selectExpr(
        "*", f"row_number() OVER (PARTITION BY lang, share {order}) AS place"
    )
    ranked = first.where(f"place <= {keep}").selectExpr(
        "lang", f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT) AS rank", "phrase", "a", "l", "r", "n", "score"
    )
    return ranked.where(f"rank <= {keep}")
