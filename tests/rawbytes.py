"""Packs small raw files word by word, straight from the layout."""

import os

import numpy as np


def psd_event(ch, ttt, ext=0, flags=0, fine=0, ql=0, pur=0, qs=0, wave=(), extras=True):
    words = [(ch & 1) << 31 | ttt, *wave]
    if extras:
        words.append(ext << 16 | flags << 10 | fine)
    return words + [ql << 16 | pur << 15 | qs]


def block(events, samples=0, dual=False, option=2, extras=True, group=False):
    body = [w for e in events for w in e]
    fmt = (0 if group else dual << 31) | 1 << 30 | 1 << 29 | extras << 28 | (samples > 0) << 27 | option << 24 | samples // 8
    return [1 << 31 | (len(body) + 2), fmt, *body]


def board(blocks, counter, bid=3):
    """blocks: {couple: words}"""
    body = [w for c in sorted(blocks) for w in blocks[c]]
    return [0xA << 28 | (len(body) + 4), bid << 27 | sum(1 << c for c in blocks), counter, 77, *body]


def save(folder, words, name="exp_00012_15880_PSD_2_000.raw"):
    path = os.path.join(folder, name)
    np.asarray(words, np.uint32).astype("<u4").tofile(path)
    return path


def simple(counter, t, n=2, couple=0, **kw):
    """A board aggregate of n hits at ticks t, t+10, ..."""
    return board({couple: block([psd_event(i & 1, t + 10 * i, ql=100 + i, qs=40, **kw) for i in range(n)])}, counter)
