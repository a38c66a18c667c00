import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from beamloom.llm import bpe, tokens
from tests.llm.data import documents, frame

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_counts_are_those_of_the_library(spark, tokenizer):
    rows = documents()
    got = sorted(map(tuple, tokens.count_tokens(frame(spark, rows), JSON, batch_bytes=5000).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert got == want
    assert tokens.count_tokens(frame(spark, []), JSON).count() == 0


def test_pieces_put_together_are_the_text_and_memo_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)
    tokens._memo(JSON).clear()
    r = random.Random(3)
    parts = ["a", "The", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u2003", "'s", "12", "!!", "<|endoftext|>", "é", "漢"]
    texts = ["".join(r.choice(parts) for _ in range(60)) for _ in range(300)]
    assert all("".join(tokens.PIECE.findall(t)) == t for t in texts)
    assert tokens.token_lengths(texts, JSON, 400) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tree_gives_the_encoding_of_the_whole_text():
    b = bpe.Bpe(RANKS, P.PATTERN, leaf=8, window=1)
    r = random.Random(5)
    parts = ["a", "b", "ing", "tion", " ", "  ", "\n\n", "'s", "'", "'re", "7", "!!", "=", "é", "ß", "漢字", "🙂", "\u3000", "\u00a0", "\x1c", "\u200b", "ꟶ", "\u0301"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    texts += [c * 400 + "x" for c in ("a", "ing", "é", "漢字", "'", " ", "\n", "1", "!", "🙂", "'s")]
    for t in texts:
        ids = b.encode(t)
        assert ids == b.encoding.encode_ordinary(t), t
        assert b.decode(ids) == t.encode()


def test_every_token_forms_by_merging():
    """The proof about pairs of tokens needs it."""
    b = bpe.Bpe(RANKS, P.PATTERN)
    ranks = {t: i for i, t in enumerate(b.bytes) if t}
    for token in ranks:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            assert parts[best] + parts[best + 1] in ranks
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


def test_round_trip_in_spark(spark):
    import tiktoken

    b = bpe.Bpe(RANKS, P.PATTERN)
    assert isinstance(b.encoding, tiktoken.Encoding)
    rows = documents()
    coded = bpe.encode(frame(spark, rows), RANKS, P.PATTERN)
    back = bpe.decode(coded, RANKS, P.PATTERN)
    assert set(frame(spark, []).columns) | {"ids", "decoded"} == set(back.columns)
    got = {(r.doc_id, tuple(r.ids), hashlib.sha256(r.decoded).hexdigest()) for r in back.select("doc_id", "ids", "decoded").collect()}
    assert got == {(i, tuple(b.encoding.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert back.count() == len(rows) and bpe.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0
    assert bpe.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), RANKS, P.PATTERN).filter("length(decoded) > 0").count() == 0


def test_both_ways_in_one_pass_are_the_two_ways(spark, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 3)
    docs = frame(spark, documents()).select("doc_id", "text", "id")
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    once = bpe.encode_and_decode(docs, RANKS, P.PATTERN)
    key = lambda r: repr((r.doc_id, r.text))
    assert once.columns == back.columns and sorted(once.collect(), key=key) == sorted(back.collect(), key=key)
