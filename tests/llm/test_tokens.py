import random

import pytest
import tiktoken
from tidemark.llm.tokens import PIECES, VOCABULARIES, Decoder, Encoder, Transducer, Vocabulary, encode, ranks_of

PATH = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return ranks_of(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_match_an_independent_encoder_and_round_trip(ranks, plain):
    rnd, e = random.Random(3), Encoder(Vocabulary(ranks))
    alphabet = ["a", "b", "é", "日", "🙂", " ", "  ", "\n", "'ll", "'", "1", "22", "<|endoftext|>", "...", "\xa0", "\x00", "\x1c", "The", " the", "\t", "\r\n"]
    e.LONG = 8
    for _ in range(1500):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50)))
        ids = e.encode(s)
        assert ids == plain.encode_ordinary(s), s
        n = rnd.randint(1, 9)
        assert list(e.stream([s[i : i + n] for i in range(0, len(s), n)])) == ids, s
        d = Decoder(ranks)
        assert "".join(d.feed([i]) for i in ids) + d.end() == s


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 4000, "é" * 3000, "=" * 3000 + "_" * 3000, " " * 5000 + "x", "lorem" * 1000])
def test_long_pieces(ranks, plain, text):
    e = Encoder(Vocabulary(ranks))
    assert e.encode(text) == plain.encode_ordinary(text)
    assert list(e.stream([text[i : i + 700] for i in range(0, len(text), 700)])) == plain.encode_ordinary(text)


def test_memory_of_the_transducer_is_bounded(ranks):
    t = Transducer(Vocabulary(ranks).learn())
    most = 0
    for _ in range(60):
        t.feed(b"abcd" * 64)
        most = max(most, len(t.data))
    assert most <= 4 * t.v.lookahead


def test_the_lookahead_suffices(ranks):
    """Whatever follows, the tokens that end the lookahead before the end of what is read stay as they are."""
    rnd, v = random.Random(4), Vocabulary(ranks).learn()
    assert 1 < v.lookahead < 512
    longest = 0
    for _ in range(3000):
        letters = bytes(rnd.choice(b"aeinrst -=") for _ in range(40))
        data, whole = letters[:28], v.merged(letters)
        cut = v.merged(data)
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        gone = [e for e in ends(cut)[:-1] if e not in ends(whole)]
        longest = max([longest, *(len(data) - e for e in gone)])
        assert all(e > len(data) - v.lookahead for e in gone)
    assert longest > 0


def test_lone_surrogates_and_small_lists():
    small = Vocabulary({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"cd": 259}).learn()
    assert small.lookahead == 2  # c stays open until d is known, and ab with it
    e = Encoder(small)
    assert e.encode("\ud800") == [0xED, 0xA0, 0x80] == list(e.stream(["\ud800"]))
    assert e.encode("ab" * 5000) == [256] * 5000


def test_defined_results(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "<|endoftext|>", 5), (3, "x", 5)], "doc_id bigint, text string, ids int")
    got = {(r.id, tuple(r.ids)) for r in encode(df, id="doc_id", text="text").collect()}
    assert (1, ()) in got and (2, ()) in got and len(got) == 4
    assert all(50256 not in ids for _, ids in got)
    assert encode(df.limit(0), id="doc_id", text="text").count() == 0
