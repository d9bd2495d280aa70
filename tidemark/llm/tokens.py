"""Encoding of texts with a public byte-pair vocabulary, as a streaming transducer with bounded lookahead.

Method. A byte-pair encoding is fixed by its pairs: a sequence of tokens is an encoding if and only if every two
neighbours encode their own concatenation to themselves, so each prefix of the bytes has exactly one possible
last token. ``Transducer`` keeps that last token for the positions since the last one emitted. What follows the bytes
read so far can change their encoding only near its end: ``sufficient_lookahead`` computes from the merges how near. Tokens that
end that many bytes before the last byte read are stable and are emitted. Memory is bounded by
the lookahead, not by the text. ``Stream`` cuts the text into the pieces within which merges happen, holding back three
characters, the most that the pattern looks ahead; every text is encoded by being fed to it in blocks.

``Decoder`` is the inverse: ids to bytes to text, holding back an unfinished character.

What the transducer has made of a short piece is remembered (a bounded table per worker), so that it isn't asked again.
The vocabulary's path is a parameter; the driver reads it once and broadcasts its fixed 50,000 entries.

Defined results. Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie unless a path is given.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: the pattern of the pieces of byte_bpe_50k.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOK = 3
MOST_ENTRIES = 1_000_000


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to id; the id is the rank of the merge that makes the token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MOST_ENTRIES:
        raise ValueError("this is no vocabulary of bounded size")
    return ranks


def sufficient_lookahead(ranks: dict[bytes, int], split: Callable[[bytes], tuple[bytes, bytes] | None]) -> int:
    """How many bytes from the end of what is read its encoding may still change, whatever follows.

    Compare a text's merges with those of the text cut off. The first place where they differ, the front, is at first the cut. It
    moves left only where a merge (x, y) takes place in one of them alone: y begins at the front, and the front moves to where
    x begins. When it moves again, by (x', y'), that merge is of higher rank, and y' has x as its left edge: it is x, or its left part
    is, or that one's left part. So the way that the front can go is the greatest sum of left parts over such chains of merges.
    """
    way: dict[bytes, int] = {}  # by left part: how far the front can have come when it is at that part's beginning
    most = 0
    for t in sorted(ranks, key=ranks.get):
        if (parts := split(t)) is None:
            continue
        x, y = parts
        if max(ranks[x], ranks[y]) > ranks[t] and min(len(x), len(y)) > 1:
            raise ValueError(f"a part of {t!r} is merged after it: this is no list of merges in order")
        far, edge = 0, y
        while True:
            far = max(far, way.get(edge, 0))
            if (e := split(edge)) is None:
                break
            edge = e[0]
        far += len(x)
        way[x] = max(way.get(x, 0), far)
        most = max(most, far)
    return max(most, 1)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        by_end: dict[int, set[int]] = {}
        for t in ranks:
            by_end.setdefault(t[-1], set()).add(len(t))
        self.lengths = {e: sorted(n, reverse=True) for e, n in by_end.items()}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.lookahead = 0

    def learn(self) -> "Vocabulary":
        """Compute the lookahead, once on the driver."""
        self.lookahead = sufficient_lookahead(self.ranks, self.split)
        self._split.clear()
        return self

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for a single byte, or if its bytes don't merge to it."""
        if token not in self._split:
            parts = self.merged(token, below=self.ranks[token])
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 and len(token) > 1 else None
        return self._split[token]

    def merged(self, data: bytes, below: int = MOST_ENTRIES + 1) -> list[bytes]:
        """The encoding by its definition: the pair of lowest rank is merged, the leftmost first, until none of a rank ``below`` is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, MOST_ENTRIES + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: bytes) -> bool:
        """Whether the token is the encoding of its own bytes."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(token) == [token]
        return known

    def neighbours(self, a: bytes, b: bytes) -> bool:
        """Whether a, b is the encoding of their concatenation."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > MOST_ENTRIES:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return known


class Transducer:
    """Bytes of one piece in, ids out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.data = bytearray()  # since the last emitted token
        self.last: list[bytes | None] = [b""]  # the last token of each prefix of data
        self.before: bytes = b""  # the last emitted token

    def feed(self, data: bytes) -> list[int]:
        v = self.v
        out: list[int] = []
        for byte in data:
            self.data.append(byte)
            i = len(self.data)
            found = None
            for n in v.lengths[byte]:
                if n > i:
                    continue
                t = bytes(self.data[i - n : i])
                if t not in v.ranks or not v.whole(t):
                    continue
                prior = self.last[i - n] if i > n else self.before
                if prior is None:
                    continue
                if not prior or v.neighbours(prior, t):
                    found = t
                    break
            self.last.append(found)
            if i >= 3 * v.lookahead:
                out += self._stable()
        return out

    def _ends(self, i: int) -> list[int]:
        """Token ends on the way back from position i."""
        ends = []
        while i > 0:
            ends.append(i)
            i -= len(self.last[i])
        return ends

    def _stable(self) -> list[int]:
        """Emit what lies further back than the lookahead."""
        n = len(self.data)
        at = next((e for e in self._ends(n) if e <= n - self.v.lookahead), 0)
        return self._emit(at) if at else []

    def _emit(self, at: int) -> list[int]:
        tokens = [self.last[i] for i in reversed(self._ends(at))]
        self.before = tokens[-1]
        del self.data[:at]
        self.last = [b"", *self.last[at + 1 :]]
        return [self.v.ranks[t] for t in tokens]

    def flush(self) -> list[int]:
        out = self._emit(len(self.data)) if self.data else []
        self.reset()
        return out


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Encoder:
    """Text in blocks in, ids out; the same ids however the text is cut into blocks."""

    #: Characters held at most before they are encoded; a piece longer than this is handed to the transducer in parts.
    LONG = 4096

    def __init__(self, vocabulary: Vocabulary, pattern: str = PIECES, remember: int = 500_000, short: int = 64):
        self.v = vocabulary if vocabulary.lookahead else vocabulary.learn()
        self.pieces = regex.compile(pattern)
        self.edge = regex.compile(r"^\s|\s$|^$")
        self.known: dict[str, list[int]] = {}
        self.pieces_known: dict[str, list[int]] = {}
        self.remember, self.short = remember, short

    def piece(self, text: str) -> list[int]:
        """The ids of a whole piece; a short one is asked of the transducer once."""
        ids = self.pieces_known.get(text)
        if ids is None:
            t = Transducer(self.v)
            ids = t.feed(_bytes(text)) + t.flush()
            self._keep(self.pieces_known, text, ids)
        return ids

    def plain(self, text: str) -> list[int]:
        """All ids of a text whose ends are ends of pieces."""
        return [i for p in self.pieces.findall(text) for i in self.piece(p)]

    def _keep(self, known: dict[str, list[int]], key: str, ids: list[int]) -> None:
        if len(key) <= self.short:
            if len(known) >= self.remember:
                known.clear()
            known[key] = ids

    def words(self, text: str) -> list[int]:
        """All ids of a text whose ends are ends of pieces, word by word.

        A single space between two words always begins a piece, so a word may be encoded with the
        space before it. Where a word is empty or has space at an end, the whole text goes piece by piece.
        """
        out: list[int] = []
        known = self.known
        words = text.split(" ")
        first = words[0]
        if first:
            ids = known.get(first)
            if ids is None:
                if self.edge.search(first):
                    return self.plain(text)
                ids = self.plain(first)
                self._keep(known, first, ids)
            out += ids
        for w in words[1:]:
            key = " " + w
            ids = known.get(key)
            if ids is None:
                if self.edge.search(w):
                    return self.plain(text)
                ids = self.plain(key)
                self._keep(known, key, ids)
            out += ids
        return out

    def stream(self, blocks: Iterable[str]) -> Iterator[int]:
        """Ids as soon as they are stable, in memory that doesn't grow with the text."""
        s = Stream(self)
        for block in blocks:
            yield from s.feed(block)
        yield from s.flush()

    def encode(self, text: str) -> list[int]:
        """All ids of a text, fed in blocks."""
        return list(self.stream([text] if len(text) <= self.LONG else (text[i : i + self.LONG] for i in range(0, len(text), self.LONG))))


class Stream:
    """The state between two blocks of a text: what is held back, and the transducer of a piece that has begun."""

    # The last single space between two characters that are none: a piece begins there, whatever follows.
    GAP = regex.compile(r"(?r)\S \S")
    KINDS = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+")))

    def __init__(self, encoder: Encoder):
        self.e, self.held, self.t = encoder, "", Transducer(encoder.v)
        self.kind: regex.Pattern | None = None  # of the piece at the beginning of what is held, if part of it is in the transducer

    def feed(self, block: str) -> list[int]:
        out: list[int] = []
        self.held += block
        while len(self.held) > self.e.LONG:
            gap = None if self.kind else self.GAP.search(self.held)
            if gap:
                out += self.e.words(self.held[: gap.start() + 1])
                self.held = self.held[gap.start() + 1 :]
                continue
            done = 0
            for a, b in self._pieces():
                if b > len(self.held) - LOOK:
                    break
                out += self._end_of(a, b)
                done = b
            if not done:  # one piece fills what is held: all but its end, which later text may change, goes on
                done = len(self.held) - LOOK
                out += self.t.feed(_bytes(self.held[:done]))
                self.kind = next(k for k in self.KINDS if k.match(self.held, done))
            self.held = self.held[done:]
        return out

    def flush(self) -> list[int]:
        if self.kind is None:
            out = self.e.words(self.held) if self.held else []
        else:
            out = [i for a, b in self._pieces() for i in self._end_of(a, b)]
        self.held = ""
        return out

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """The pieces of what is held, first what belongs to one that has begun."""
        at = 0
        if self.kind:
            m = self.kind.match(self.held)
            at = m.end() if m else 0
            yield 0, at
        for m in self.e.pieces.finditer(self.held, at):
            yield m.span()

    def _end_of(self, a: int, b: int) -> list[int]:
        if self.kind is None:
            return self.e.piece(self.held[a:b])
        self.kind = None
        return self.t.feed(_bytes(self.held[a:b])) + self.t.flush()


class Decoder:
    """Ids in, text out: an incremental state machine from bytes to characters."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.bytes_of[i]) for i in ids)

    def end(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


def encode(df: DataFrame, *, id: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", pattern: str = PIECES) -> DataFrame:
    """(id, ids ARRAY<INT>): one row for each row of ``df``. See the module's text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(ranks_of(vocabulary)).learn())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder(shared.value, pattern)
        for b in batches:
            yield pd.DataFrame({"id": b.id, "ids": [e.encode(t) if t else [] for t in b.text]})

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(work, f"id {dict(df.dtypes)[id]}, ids array<int>")
