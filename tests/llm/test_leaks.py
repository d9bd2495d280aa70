import random

import numpy as np
from tidemark.llm.leaks import Index, fingerprints, holds, leaks, promising, words_of

WORDS = [f"w{i}" for i in range(400)]


def brute(doc: list[str], item: list[str], least: int = 30, one_in: int = 8) -> bool:
    """Any item stretch of the length within the edit distance of any document stretch."""
    for a in range(len(item) - least + 1):
        row = [0] * (len(doc) + 1)
        for i in range(a, len(item)):
            new = [row[0] + 1]
            for j, w in enumerate(doc):
                new.append(min(row[j] + (w != item[i]), row[j + 1] + 1, new[j] + 1))
            row = new
            n = i - a + 1
            if n >= least and min(row) <= n // one_in:
                return True
    return False


def test_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(k, [rnd.choice(WORDS) for _ in range(rnd.randint(46, 70))]) for k in range(12)]
    docs = []
    for k in range(150):
        it = rnd.choice(items)[1]
        n = rnd.randint(24, min(44, len(it)))
        at = rnd.randint(0, len(it) - n)
        part = it[at : at + n]
        for _ in range(rnd.randint(0, 6)):
            p = rnd.randrange(len(part))
            how = rnd.random()
            part = part[:p] + ([] if how < 0.3 else [rnd.choice(WORDS)] if how < 0.7 else [part[p], rnd.choice(WORDS)]) + part[p + 1 :]
        pad = lambda: [rnd.choice(WORDS) for _ in range(rnd.randint(0, 25))]
        docs.append((k, pad() + part + pad()))
    want = {(d, i) for d, dw in docs for i, iw in items if brute(dw, iw)}
    frame = spark.createDataFrame([(d, "  ".join(w).upper() + "!") for d, w in docs], "doc_id bigint, text string")
    held = spark.createDataFrame([(i, ", ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(r.id, r.item) for r in leaks(frame, held, id="doc_id", text="text", item_id="item_id", item_text="text").collect()}
    assert got == want and 20 < len(want) < 140
    several = {(r.id, r.item) for r in leaks(frame, held, id="doc_id", text="text", item_id="item_id", item_text="text", index_words=200).collect()}
    assert several == want


def test_multi_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(1)
    ix = Index([(k, " ".join(rnd.choice(WORDS, 60))) for k in range(40)], 6, 3)
    q = ix.fp[rnd.integers(0, len(ix.fp), 500)] ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (3, 500)).astype(np.uint64), axis=0)
    i, j = ix.near(q)
    full = np.bitwise_count(q[:, None] ^ ix.fp[None]) <= 3
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(full))))


def test_words_and_edges(spark):
    assert words_of("Don't STOP—the café; 3.5!") == ["dont", "stop", "the", "café", "3", "5"]
    assert len(fingerprints(np.arange(5, dtype=np.uint64), 6)) == 0
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b", 1), (4, "x " * 50_000, 1)], "doc_id bigint, text string, item int")
    held = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "item_id bigint, text string")
    assert leaks(docs, held, id="doc_id", text="text", item_id="item_id", item_text="text").count() == 0
    assert leaks(docs.limit(0), held.limit(0), id="doc_id", text="text", item_id="item_id", item_text="text").count() == 0


def test_repeated_rows(spark):
    text = " ".join(random.Random(2).sample(WORDS, 50))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    held = spark.createDataFrame([(9, text), (9, text)], "item_id bigint, text string")
    got = leaks(docs, held, id="doc_id", text="text", item_id="item_id", item_text="text").distinct().collect()
    assert {(r.id, r.item) for r in got} == {(1, 9), (2, 9)}


def test_the_hardest_edits(spark):
    """32 words with four edits so that only three windows of six stay whole."""
    r = random.Random(0)
    item = r.sample(WORDS, 60)
    part = item[10:42]
    for at in (6, 12, 19, 25):
        part[at] = "edited"
    docs = spark.createDataFrame([(1, " ".join(["x"] * 20 + part + ["y"] * 20)), (2, " ".join(part[:27]))], "doc_id bigint, text string")
    held = spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    assert [(x.id, x.item) for x in leaks(docs, held, id="doc_id", text="text", item_id="item_id", item_text="text").collect()] == [(1, 9)]


def test_a_further_short_quotation_hides_no_leak(spark):
    """The item's start verbatim, and at the same offset a few words of its end, with other words between."""
    item = random.Random(3).sample(WORDS, 160)
    docs = spark.createDataFrame([(1, " ".join(item[:34] + [f"z{k}" for k in range(120)] + item[154:]))], "doc_id bigint, text string")
    held = spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    assert [(x.id, x.item) for x in leaks(docs, held, id="doc_id", text="text", item_id="item_id", item_text="text").collect()] == [(1, 9)]


def test_words_that_other_items_share(spark):
    """A stretch of 40 words, five rare ones edited, among items that hold its other words too."""
    r = random.Random(6)
    common, rare = [f"c{i}" for i in range(35)], [f"r{i}" for i in range(5)]
    item = list(common)
    for k, at in enumerate((5, 12, 19, 26, 33)):
        item.insert(at, rare[k])
    leak = ["edited" if w in rare else w for w in item]
    others = [(k, " ".join(r.sample(common, 35) + r.sample(WORDS, 12))) for k in range(240)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 9 + leak + ["y"] * 9))], "doc_id bigint, text string")
    held = spark.createDataFrame([(999, " ".join(item + ["z1", "z2", "z3", "z4", "z5", "z6"])), *others], "item_id bigint, text string")
    assert (1, 999) in {(x.id, x.item) for x in leaks(docs, held, id="doc_id", text="text", item_id="item_id", item_text="text").collect()}


def test_what_is_held_is_promising():
    r = random.Random(8)
    pairs = []
    for _ in range(2000):
        words = r.sample(range(300), 80)
        n = r.choice((30, 32, 40, 48, 56, 64, 80))
        part = words[:n]
        for _ in range(n // 8):  # edits as close together as may be, or anywhere
            p = r.randrange(n // 3, 2 * n // 3) if r.random() < 0.5 else r.randrange(len(part))
            p = min(p, len(part) - 1)
            part = part[:p] + ([] if r.random() < 0.3 else [-5]) + part[p + r.randint(0, 1) :]
        pairs.append((np.array(words), np.array(part), 0))
    for k in range(0, len(pairs), 250):
        part = pairs[k : k + 250]
        yes = holds(part, 30, 8, 10, 14)
        assert yes.sum() > 50 and promising(part, 30, 8, 14)[yes].all()


def test_repeated_windows_are_held_once():
    text = " ".join(random.Random(9).sample(WORDS, 20))
    ix = Index([(1, text), (2, text)], 6, 3)
    assert len(ix.fp) == 15 and len(ix.near(ix.fp[:1])[0]) == 2
