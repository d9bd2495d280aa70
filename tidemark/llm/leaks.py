"""Passages of held-out items inside a corpus.

Method. Both sides become words (case, punctuation and spacing ignored) and every window of ``window`` words gets a
64-bit SimHash of its weighted shingles (pairs of words weigh twice as much as words). The window is sized to the
passage that counts as a leak: a stretch of ``least`` item words with at most one in ``one_in`` words edited must
hold ``window`` words in a row without an edit (of 30 words with 3 edits: four runs of 27 words, one of at least
six; longer stretches have at least six too), so each leak has windows at Hamming distance 0 and at least three
of them (32 words with 4 edits leave three, all other lengths more). The items' fingerprints are held in a multi-index of ``radius + 1`` blocks: two fingerprints
within the radius agree in at least one block, so looking up all blocks finds every pair within the radius,
for certain. Candidates are document and item with at least ``votes`` agreeing item positions near one
diagonal; all of them in which enough words are equal for a leak to be possible at all are verified exactly, by an
alignment that finds the longest item stretch for each number of edits.

Scale. Documents are only ever mapped: no shuffle, no pair of documents. The items' index is broadcast in blocks
of at most ``index_words`` words, counted beforehand; more items take more passes over the documents, one after the other, whose
index is dropped before the next is made. Long texts go through in slices of words.

Defined results. Null or empty texts on either side give nothing. Repeated documents or items are each reported by
their id; the pair once. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

WORD = re.compile(r"[^\W_]+")
DROP = re.compile("['`\u2019\u00b4\u00ad\u200b\u200c\u200d\ufeff]")  # apostrophes, and characters without width
SLICE = 100_000


def words_of(text: str) -> list[str]:
    return WORD.findall(DROP.sub("", text.casefold()))


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of hashed words."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
    pair *= np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(29)

    votes = _window_sums(h, window) + 2 * _window_sums(pair, window - 1)
    return np.packbits(votes * 2 > window + 2 * (window - 1), axis=1).view(np.uint64).ravel()


def _window_sums(v: np.ndarray, w: int) -> np.ndarray:
    """How many of each ``w`` values in a row have each of the 64 bits, by doubling."""
    power = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint8 if w < 40 else np.uint16)
    n, size, out, done = len(v) - w + 1, 1, None, 0
    while w:
        if w & 1:
            out = power[done : done + n].copy() if out is None else out + power[done : done + n]
            done += size
        w >>= 1
        if w:
            power, size = power[:-size] + power[size:], 2 * size
    return out


class Index:
    """The items' windows under a multi-index of Hamming blocks; windows of one fingerprint are held once."""

    def __init__(self, items: list[tuple[object, str]], window: int, radius: int):
        self.window, self.radius, self.blocks = window, radius, radius + 1
        self.ids, self.words, self.number = [], [], {}
        fp, item, pos = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for id_, text in items:
            w = words_of(text or "")
            if len(w) < window:
                continue
            f = fingerprints(pd.util.hash_array(np.array(w, dtype=object)), window)
            fp.append(f)
            item.append(np.full(len(f), len(self.ids), np.int32))
            pos.append(np.arange(len(f), dtype=np.int32))
            self.ids.append(id_)
            self.words.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64))
        self.fp, at = np.unique(np.concatenate(fp), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.item, self.pos = np.concatenate(item)[order], np.concatenate(pos)[order]
        self.first = np.r_[0, np.cumsum(np.bincount(at, minlength=len(self.fp)))]  # of each fingerprint's windows
        bits = 64 // self.blocks
        self.spans = [(b * bits, bits if b < self.blocks - 1 else 64 - b * bits) for b in range(self.blocks)]
        self.tables = []
        for shift, width in self.spans:
            v = self.block(self.fp, shift, width)
            order = np.argsort(v, kind="stable")
            # where each value of a block begins; wide blocks are looked up by their highest bits first
            top = min(width, 20)
            begin = np.searchsorted(v[order] >> np.uint64(width - top), np.arange((1 << top) + 1, dtype=np.uint64)).astype(np.int32)
            self.tables.append((order.astype(np.int32), width - top, begin))

    @staticmethod
    def block(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in fp, window of an item) within the radius, each once."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int32))]
        for b, ((shift, width), (order, rest, begin)) in enumerate(zip(self.spans, self.tables, strict=True)):
            v = (self.block(fp, shift, width) >> np.uint64(rest)).astype(np.int64)
            lo = begin[v]
            some = np.flatnonzero(begin[v + 1] > lo)
            q, at = _spread(some, lo[some], begin[v[some] + 1])
            at = order[at]
            x = fp[q] ^ self.fp[at]
            ok = np.bitwise_count(x) <= self.radius
            q, at, x = q[ok], at[ok], x[ok]
            for s, w in self.spans[:b]:  # found by an earlier block already
                new = self.block(x, s, w) != 0
                q, at, x = q[new], at[new], x[new]
            out.append((q, at))
        q, at = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        return _spread(q, self.first[at], self.first[at + 1])


def _spread(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``of`` with all places from its lo to its hi."""
    n = hi - lo
    total = np.cumsum(n)
    return np.repeat(of, n), np.repeat(lo - np.r_[0, total[:-1]], n) + np.arange(total[-1] if len(n) else 0)


def promising(pairs: list[tuple[np.ndarray, np.ndarray, int]], least: int, one_in: int, reach: int) -> np.ndarray:
    """Whether enough item words have an equal word on the band; without it no stretch of the item can be held.

    A stretch of ``one_in`` * e words with e edits lies in ``least`` words in a row, or both its first and its last ``least``
    words share the edits. So some ``least`` words in a row have at most 2 * least / (one_in + 1) edits: those that both share,
    when all edits lie there and fill it. Shorter and longer stretches have fewer.
    """
    item, band = _banded(pairs, reach)
    rows = item.shape[1]
    same = np.zeros(item.shape, bool)
    for k in range(2 * reach + 1):
        same |= item == band[:, k : k + rows]
    total = np.c_[np.zeros(len(pairs), np.int32), np.cumsum(same, axis=1, dtype=np.int32)]
    w = min(least, rows)
    return (total[:, w:] - total[:, :-w]).max(1) >= least - 2 * least // (one_in + 1)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray, int]], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Item words, and document words such that column i + b lies beside item word i on diagonal b of the band."""
    n, width = len(pairs), 2 * reach + 1
    rows = max(len(p[0]) for p in pairs)
    item = np.full((n, rows), -1, np.int64)
    band = np.full((n, rows + width), -2, np.int64)
    for k, (a, d, diagonal) in enumerate(pairs):
        item[k, : len(a)] = a
        lo = diagonal - reach  # document place of item word 0 on the band's first diagonal
        s, e = max(lo, 0), min(lo + rows + width, len(d))
        if s < e:
            band[k, s - lo : e - lo] = d[s:e]
    return item, band


def holds(pairs: list[tuple[np.ndarray, np.ndarray, int]], least: int, one_in: int, most: int, reach: int) -> np.ndarray:
    """For each (item words, document words, diagonal), whether a stretch of the item is held.

    An alignment begins and ends with a matched word; edits at the ends of a stretch count with the stretch, so fewer matched
    words suffice where edits are left over. Words are numbers. best[e, b]: item words of the longest alignment that ends at the row's item word and at
    the document word on diagonal b of the band, with e edits. Edits are bounded by ``most``, the band by ``reach``.
    """
    item, band = _banded(pairs, reach)
    (n, rows), width = item.shape, 2 * reach + 1
    none = np.int16(-10_000)
    best = np.full((most + 1, n, width), none, np.int16)
    found = np.zeros(n, bool)
    e = np.arange(most + 1)
    spare = least // one_in  # edits that a stretch of the least length may have; those at its ends lie outside the matched words
    limit = np.where(e <= spare, least - spare + e, np.maximum(least, one_in * e)).astype(np.int16)[:, None, None]
    for i in range(rows):
        same = (item[:, i, None] == band[:, i : i + width]) & (item[:, i, None] >= 0)
        new = np.full_like(best, none)
        new[0] = np.where(same, np.maximum(best[0], 0) + 1, none)
        for e in range(1, most + 1):
            r = np.where(same, best[e] + 1, none)
            np.maximum(r, best[e - 1] + 1, out=r)  # replaced
            np.maximum(r[:, :-1], best[e - 1][:, 1:] + 1, out=r[:, :-1])  # dropped from the item
            np.maximum(r[:, 1:], new[e - 1][:, :-1], out=r[:, 1:])  # inserted in the document
            new[e] = r
        found |= ((new >= limit) & same[None]).any(axis=(0, 2))
        best = np.maximum(new, none)
    return found


def find(index: Index, ids: list, texts: list[str], least: int, one_in: int, votes: int, reach: int) -> list[tuple]:
    """(document, item) of the leaks in some documents."""
    docs = [(i, words_of(t)) for i, t in zip(ids, texts, strict=True) if t]
    docs = [(i, w) for i, w in docs if len(w) >= index.window]
    if not docs or not len(index.fp):
        return []
    flat = np.array([w for _, ws in docs for w in ws], dtype=object)
    codes, uniques = pd.factorize(flat)
    h = pd.util.hash_array(np.asarray(uniques, dtype=object))[codes]
    length = np.array([len(w) for _, w in docs])
    start = np.r_[0, np.cumsum(length)]
    owner = np.repeat(np.arange(len(docs)), length)
    hits = []
    for lo in range(0, len(h), SLICE):
        fp = fingerprints(h[lo : lo + SLICE + index.window - 1], index.window)
        at = np.arange(lo, lo + len(fp))
        q, w = index.near(fp[inside := owner[at] == owner[at + index.window - 1]])
        hits.append((at[inside][q], w))
    at, w = (np.concatenate([x[k] for x in hits]) for k in (0, 1))
    if not len(at):
        return []
    doc, item = owner[at], index.item[w]
    diagonal = at - start[doc] - index.pos[w]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal, pos = doc[order], item[order], diagonal[order], index.pos[w][order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach // 2)]
    group = np.cumsum(new) - 1
    distinct = np.unique(group.astype(np.int64) * (1 << 32) + pos)
    count = np.bincount(distinct >> 32, minlength=group[-1] + 1)
    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
    numbers = np.array([index.number.get(u, -2) for u in uniques], np.int64)[codes]  # words of no item are equal to none
    pairs, who = [], []
    for g in np.flatnonzero(count >= votes):
        a, b = first[g], last[g]
        d, it = doc[a], item[a]
        for mid in range(int(diagonal[a]), int(diagonal[b]) + 1, reach):  # one band, more where the hits spread
            pairs.append((index.words[it], numbers[start[d] : start[d + 1]], (mid + min(mid + reach, int(diagonal[b]))) // 2))
            who.append((docs[d][0], index.ids[it]))
    found: dict[tuple, None] = {}
    some = np.concatenate([promising(pairs[k : k + 256], least, one_in, reach) for k in range(0, len(pairs), 256)] or [np.empty(0, bool)])
    pairs, who = ([x[i] for i in np.flatnonzero(some)] for x in (pairs, who))
    for k in range(0, len(pairs), 256):
        part = pairs[k : k + 256]
        most = max(len(p[0]) for p in part) // one_in
        for ok, pair in zip(holds(part, least, one_in, most, reach), who[k : k + 256], strict=True):
            if ok:
                found[pair] = None
    return list(found)


def leaks(docs: DataFrame, items: DataFrame, *, id: str, text: str, item_id: str, item_text: str, window: int = 6, radius: int = 3, least: int = 30, one_in: int = 8, votes: int = 3, reach: int = 14, index_words: int = 2_000_000) -> DataFrame:
    """(id, item) of every document that holds a stretch of an item. See the module's text."""
    spark = docs.sparkSession
    held = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).filter("item is not null and t is not null")
    total = held.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    passes = max(1, math.ceil(total / index_words))
    kinds = dict(docs.dtypes)[id], dict(items.dtypes)[item_id]
    src = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    out = None
    for k in range(passes):
        mine = held.filter(F.expr(f"pmod(hash(item), {passes}) = {k}")).distinct().collect()  # at most about index_words words
        shared = spark.sparkContext.broadcast(Index([(r.item, r.t) for r in mine], window, radius))

        def work(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for b in batches:
                for lo in range(0, len(b), 1000):
                    part = b.iloc[lo : lo + 1000]
                    rows = find(shared.value, part.id.tolist(), part.text.tolist(), least, one_in, votes, reach)
                    yield pd.DataFrame(rows, columns=["id", "item"])

        found = src.mapInPandas(work, f"id {kinds[0]}, item {kinds[1]}")
        if passes > 1:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
