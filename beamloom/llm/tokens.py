"""Token counts: lengths only, from batch encoding inside Arrow functions.

Texts are cut at safe boundaries, the places where white space follows a character that is not white space: every
match of a byte-level pre-tokenizer that ends in such a character ends there, and none looks back over it. The cut
pieces are therefore encoded alone with the same number of tokens. Pieces are encoded in batches of about the same
number of bytes, each distinct piece once, and a text's length is the sum over its pieces; so neither a very long text
nor a batch of them holds more than one batch of encodings.

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows give repeated results; an empty table gives none. Other
columns, of whatever names, are not read unless asked for in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamloom.llm.memory import frugal

#: White space of Unicode (fixed values); nothing else may end a piece.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

BATCH_BYTES = 1 << 20
MEMO_PIECES = 300_000
MEMO_CHARS = 60


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _memo(path: str) -> dict[str, int]:
    return {}


def batches(texts: list[str], batch_bytes: int) -> Iterator[list[str]]:
    """Runs of texts of about batch_bytes bytes of UTF-8."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if size >= batch_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_lengths(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Number of tokens of each text."""
    tokenizer, memo, out = _tokenizer(path), _memo(path), []
    for run in batches(texts, batch_bytes):
        pieces = [PIECE.findall(t) for t in run]
        new = list(set().union(*pieces).difference(memo))
        lengths: dict[str, int] = {}
        for part in batches(new, batch_bytes):
            lengths.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        if len(memo) + len(lengths) > MEMO_PIECES:
            # what this run needs stays
            lengths.update((p, memo[p]) for p in set().union(*pieces) if p in memo)
            memo.clear()
        memo.update(lengths)
        out += [sum(map(memo.__getitem__, p)) for p in pieces]
        for p in lengths:
            if len(p) > MEMO_CHARS:
                del memo[p]
    return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The kept columns, n_bytes (UTF-8) and n_tokens (by the tokenizer file at ``path``) of each row.

    Special strings inside a text are what the library makes of them by default; none are added. One pass, no shuffle.
    """
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType(), False)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n = token_lengths(b.column(b.num_columns - 1).to_pylist(), path, batch_bytes)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)
