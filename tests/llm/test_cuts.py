import random

from tidemark.llm.cuts import share_cut, truncated

PARTS = ["The brush head", "My second unit", "The hinge pin", "The viewing dome"], ["worked from the first minute", "came apart in my hands", "fits a narrow rail", "stayed bright in murky water"], ["on a steel deck", "in the workshop", "by a wide margin", "under the stern"]


def sentence(r):
    return " ".join(r.choice(p) for p in PARTS)


def corpus():
    r, rows, cut = random.Random(4), [], set()
    for k in range(3000):
        t = ". ".join(sentence(r) for _ in range(r.randint(1, 4)))
        end = r.random()
        t += "." if end < 0.8 else "" if end < 0.9 else "..." if end < 0.95 else " 👍"
        if k % 20 == 0 and len(t) > 60:
            full = t
            t = t[: r.randint(30, len(t) - 8)]
            if full[len(t)].isalpha() and t[-1].isalpha():  # inside a word for certain
                cut.add(k)
                t += r.choice(["", "�", "\n", " "])
            else:
                t = full
        rows.append((k, t, "free"))
    for k in range(3000, 3400):
        t = ". ".join(sentence(r) for _ in range(6)) + "."
        if t[119] != "." and t[119].isalpha():
            rows.append((k, t[:120], "limited"))
            cut.add(k)
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.id for r in truncated(df, id="doc_id", text="text", source="source").collect()}
    assert len(got & cut) >= 0.95 * len(cut), (len(got & cut), len(cut))
    assert len(got - cut) <= 0.03 * len(got)
    s = {r.source: r for r in share_cut(df, id="doc_id", text="text", source="source").collect()}
    assert s["limited"].share > 0.9 > 0.2 > s["free"].share


def test_defined_results(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \n ", "a"), (4, "word " * 30_000, None), (5, "Fine.", None), (5, "Fine.", None), (6, "the end�", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, why int, tok int")
    got = {r.id for r in truncated(df, id="doc_id", text="text", source="source").collect()}
    assert got >= {6} and not got & {1, 2, 3, 5}
    assert truncated(df.limit(0), id="doc_id", text="text", source="source").count() == 0


def test_copies_of_a_cut_text_are_no_proper_ends(spark):
    rows, cut = corpus()
    full = "The newer grinder wheel ran hot all through the second shift and the operator had to wait for an hour before " * 2
    rows += [(10_000 + k, full[:114] + "...", "limited") for k in range(40)]  # cut back to a word and marked, within the slack of 120
    part = "My second unit came apart in my hands in the worksh"
    rows += [(20_000 + k, part + ("…" if k % 2 else ""), "unlimited") for k in range(40)]
    half = "My second unit fits a narrow rail by a wide"
    rows += [(30_000 + k, half, "unlimited") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.id for r in truncated(df, id="doc_id", text="text", source="source").collect()}
    for first in (10_000, 20_000, 30_000):
        assert got >= set(range(first, first + 40)), first
    assert len(got - cut - set(range(10_000, 40_000))) <= 0.03 * len(got)


def test_a_corpus_that_is_there_fifty_times_is_judged_alike(spark):
    rows, _ = corpus()
    rows = [r for r in rows if r[0] % 4 == 0 or r[0] >= 3200] + [(9000 + k, "Does the job", "free") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    many = df.selectExpr("doc_id", "text", "source", "explode(sequence(0, 49)) as copy").selectExpr("doc_id * 50 + copy as doc_id", "text", "source")
    one = {r.id for r in truncated(df, id="doc_id", text="text", source="source").collect()}
    got = {(r.id // 50, r.id % 50) for r in truncated(many, id="doc_id", text="text", source="source").collect()}
    assert one and got == {(i, k) for i in one for k in range(50)}


def test_a_source_whose_limit_was_raised(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(200)]
    text = lambda: " ".join(r.choice(words) for _ in range(60))
    rows = [(k, text()[: 120 if k % 2 else 40], "s") for k in range(300)]
    rows += [(1000 + k, text()[: r.randint(20, 119)] + ".", "s") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [x for x in truncated(df, id="doc_id", text="text", source="source").collect() if x.id < 1000]
    assert sum(x.id % 2 for x in got) > 100 and sum(1 - x.id % 2 for x in got) > 100
