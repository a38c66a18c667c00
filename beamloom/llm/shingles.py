"""Word shingles of whole texts as 64-bit hashes, computed on the byte buffer of an Arrow batch.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased; since the separators are ASCII, this is the
same on UTF-8 bytes as on characters. Two different shingles share a hash with a probability of about 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; numpy needs about 60 times as much.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(1, 257, dtype=np.uint64)
LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64, fixed values)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _coefficients(n: int) -> np.ndarray:
    """Odd pseudo-random factors, one for each place in a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in pieces of about CHUNK_BYTES that begin at white space."""
    at = 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data):
            space = np.flatnonzero(SPACE[data[end : end + CHUNK_BYTES]])
            if len(space):
                end += int(space[0])
                break
            end += CHUNK_BYTES
        yield at, min(end, len(data))
        at = end


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[edges[i]:edges[i + 1]], and the text each word is of."""
    if len(edges) == 2 and len(data) > 2 * CHUNK_BYTES:
        found = np.concatenate([_word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data)])
        return found, np.zeros(len(found), np.int64)
    return _word_hashes(data, edges)


def _word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = edges[:-1][edges[:-1] < edges[1:]]
    starts[first] = word[first]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    own = np.cumsum(starts) - 1  # the word each byte is of; spaces go to the word before and weigh nothing
    own[own < 0] = 0
    place = np.arange(len(data)) - at[own]
    place[~word] = 0
    terms = LOWER[data] * _coefficients(int(place.max()) + 1)[place]
    terms[~word] = 0
    terms[: at[0]] = 0
    return mix(np.add.reduceat(terms, at)), np.searchsorted(edges, at, side="right") - 1


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of n words with their text, repeats included, in reading order within a text.

    A text with fewer words has one shingle, all its words; a text without words has none.
    """
    count = np.bincount(text, minlength=n_texts)
    ends = np.cumsum(count)

    def chained(at: np.ndarray, size: int) -> np.ndarray:
        h = words[at] + U(size)
        for k in range(1, size):
            h = mix(h * U(0x9E3779B97F4A7C15) + words[at + k])
        return h

    full = np.arange(max(0, len(words) - n + 1))
    full = full[text[full] == text[full + n - 1]] if len(full) else full
    out, of = [chained(full, n)], [text[full]]
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            out.append(chained(ends[short] - size, size))
            of.append(short)
    hashes, owner = np.concatenate(out), np.concatenate(of)
    if len(out) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def chunks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes (CHUNK_BYTES): number of the first one, bytes and edges. A null is an empty text."""
    size = size or CHUNK_BYTES
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + size, side="right")) - 1)
        yield i, data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
        i = j


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each text, and the sorted distinct hashes of its shingles."""
    for first, data, edges in chunks(texts):
        hashes, owner = shingles(*word_hashes(data, edges), len(edges) - 1, n)
        cut = np.searchsorted(owner, np.arange(len(edges)))
        for k in range(len(edges) - 1):
            yield first + k, np.unique(hashes[cut[k] : cut[k + 1]])
