"""Texts cut off by a field limit or in transfer, found by how word trigrams occur inside texts and at ends.

Method, in SQL alone. Texts are taken apart into lower-case words (numbers alike) and stops; for each trigram
of words the corpus is counted: how often a further word of the same sentence follows (inside), how often a stop
(ended), how often the text is over without one (open). Copies of a text count once, and so do open ends after the same
``CONTEXT`` words: copies of a cut text say nothing of how sentences end. Only texts of no more words than that,
which many authors write alike, count as often as they occur, by the number of copies that texts usually have (so that a corpus
that is there 50 times counts as once); copies in numbers of so short a cut text pass for such a phrase. The same is counted for the pairs and words that the
trigrams back off to, and for the beginnings of words after the same two words. A text without a stop at its end
has its last trigram looked up:

* a last word that hardly occurs there as a whole but begins words that do was cut inside the word;
* a last trigram that is frequent inside and almost never ends a sentence was cut inside the sentence.

Marks that a system leaves where it cut (an ellipsis, a replacement character, space at the end) are taken off
first; the same is then asked of what is before them. The limits of a source are learned from the corpus too: lengths, in
characters or bytes, at which different texts pile up. A text within ``slack`` of a limit of its source
that has no stop at its end was cut by it, whatever its words. Decisions are by shares; a share counts where
at least a few occurrences (3, 5 or 20) stand behind it, else the pair or the word decides.

Scale. The corpus is read twice: once for a narrow row of each text (flags, lengths, a digest, its last words), which is written
and serves the limits, the copies and the open ends; and once for the trigrams, which are made and summed up where the texts
are read. Copies are told by their digest, so no text is shuffled. Tables grow with the vocabulary of trigrams, not with the
corpus; only beginnings of words that stand at an open end are looked for.

Defined results. Null, empty and blank texts are not cut. A null source is a source of its own. Repeated ids are
judged each by its text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

# What a system may leave where it cut, at the end of a text.
MARK = r"(?:\s*(?:\x{FFFD}+|…|\.{3,}|\[…\]|\[\.{3}\]))+$"
SPACE = " \t\n\x0b\f\r"
# Words and stops; commas and their like are neither.
TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*['’]?|[^\p{L}\p{M}\p{N}\s,;:'’–—\-]"
PAUSE = r"[,;:–—\-(]"
# So many words before an open end are its context.
CONTEXT = 8
OPEN_END = r"[\p{L}\p{M}\p{N}'’]"
# So many lengths beyond a limit must be next to empty.
BEYOND = 10
# More copied texts than this are joined and not broadcast.
MOST_BROADCAST = 200_000


def _texts(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """(id, source, text, core, body, low): core is without space at the end, body without a mark there, low in lower case."""
    d = df.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).withColumn("core", F.rtrim("text", F.lit(SPACE))).filter("core <> ''")
    marked = F.col("core").endswith("\ufffd") | F.col("core").endswith("\u2026") | F.col("core").endswith("...") | F.col("core").endswith("]")
    return d.withColumn("body", F.when(marked, F.regexp_replace("core", MARK, "")).otherwise(F.col("core"))).withColumn("low", F.lower("body"))


def _plain(w: Column) -> Column:
    """A token as it is counted: numbers are '#', stops '.'."""
    number = (w >= "0") & (w < ":") & w.rlike(r"^\p{N}+$")
    stop = (F.length(w) == 1) & ~w.rlike(r"[\p{L}\p{M}\p{N}]")
    return F.when(number, "#").when(stop, ".").otherwise(w)


def _raw(low: str) -> Column:
    """Words and stops, two '.' before."""
    return F.concat(F.array(F.lit("."), F.lit(".")), F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))


def _narrow(texts: DataFrame) -> DataFrame:
    """One narrow row for each text; w1 to w3 are the last words of those that could be cut, context a digest of the last ``CONTEXT``.

    key is alike in copies, whatever their case, spacing and pauses; h is the text's own digest.
    """
    end = F.expr("right(body, 1)")
    t = texts.select(
        "id", "source", F.xxhash64("text").alias("h"), F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.expr("substring(core, length(body) + 1)").alias("mark"),
        (F.octet_length("core") < F.octet_length("text")).alias("space"), end.rlike(PAUSE).alias("pause"), end.rlike(OPEN_END).alias("bare"), "low")
    t = t.withColumn("key", F.md5(F.concat(F.translate("low", SPACE + ",;:'\u2019\u2013\u2014-123456789", ""), (F.col("bare") | F.col("pause")).cast("string"))))
    open_ = F.col("bare") | F.col("pause") | (F.col("mark") != "")
    t = t.withColumn("tok", F.when(open_, F.transform(_raw("low"), _plain))).withColumns({"some": F.size("tok") > 2, "brief": F.size("tok") - 2 <= CONTEXT})
    last = {"w1": "if(tok[size(tok) - 2] = '.', '.', tok[size(tok) - 3])", "w2": "tok[size(tok) - 2]", "w3": "tok[size(tok) - 1]", "context": f"xxhash64(slice(tok, greatest(1, size(tok) - {CONTEXT - 1}), {CONTEXT}))"}
    return t.select("id", "source", "h", "chars", "bytes", "mark", "space", "pause", "bare", "brief", "key", *[F.expr(f"if(some, {e}, null)").alias(c) for c, e in last.items()])


def _copies(narrow: DataFrame) -> DataFrame:
    """(id, h, n, m) of the texts that have copies: how many copies there are, and how many rows share their weight; m is null where another row counts."""
    rows = narrow.groupBy("key", "id", "h").agg(F.count(F.lit(1)).alias("k"))
    first = rows.groupBy("key").agg(F.min(F.struct("id", "h")).alias("first"), F.sum("k").alias("n")).filter("n > 1")
    return rows.join(first, "key").select("id", "h", "n", F.when((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")), F.col("k")).alias("m"))


def _usual(narrow: DataFrame) -> float:
    """How often a text occurs as a rule, copies counted: 1, or more where the whole corpus is there several times."""
    return narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile_approx("n", 0.5)).first()[0] or 1


def _trigrams(texts: DataFrame, narrow: DataFrame) -> DataFrame:
    """(w1, w2, w3, inside, ended, open): counts over all positions of the distinct texts; open over distinct contexts."""
    usual = F.lit(float(_usual(narrow)))
    copies = _copies(narrow)
    if copies.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        copies = F.broadcast(copies)
    once = texts.select("id", F.xxhash64("text").alias("h"), "low").join(copies, ["id", "h"], "left").filter("n is null or m is not null")
    n = F.when(F.size("tok") - 2 <= CONTEXT, F.greatest(F.coalesce("n", F.lit(1)) / usual, F.lit(1.0))).otherwise(F.lit(1.0)) / F.coalesce("m", F.lit(1))
    # four neighbours in a row at every place, by shifted copies; what they count as is told afterwards, in generated code
    shifted = F.arrays_zip(*[F.slice("tok", k, F.size("tok")).alias(f"w{k}") for k in (1, 2, 3, 4)])
    rows = once.select(_raw("low").alias("tok"), "m", "n").select(n.alias("n"), F.explode(shifted).alias("t")).select("n", "t.*").filter("w4 is not null")
    rows = rows.select("n", *[_plain(F.col(c)).alias(c) for c in ("w1", "w2", "w3")], (_plain(F.col("w4")) == ".").alias("over")).filter("w3 <> '.'").withColumn("w1", F.expr("if(w2 = '.', '.', w1)"))
    inner = rows.groupBy("w1", "w2", "w3").agg(*[F.round(F.sum(F.when(F.col("over") == ended, F.col("n")).otherwise(0.0)), 6).alias(c) for ended, c in ((False, "inside"), (True, "ended"))])
    last = narrow.filter("w3 <> '.'").groupBy("w1", "w2", "w3", "context", "brief", "key").agg(F.count(F.lit(1)).alias("n"))
    last = last.groupBy("w1", "w2", "w3", "context").agg(F.max(F.when(F.col("brief"), F.greatest(F.col("n") / usual, F.lit(1.0))).otherwise(1.0)).alias("n"))
    outer = last.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("open"))
    return inner.join(outer, ["w1", "w2", "w3"], "full").fillna(0.0, ["inside", "ended", "open"])


def _longer(words: DataFrame, wanted: DataFrame, keys: list[str], begins: DataFrame, name: str) -> DataFrame:
    """For each wanted context and beginning of a word: how often longer words with that beginning occur there."""
    wanted = wanted.select(*keys, "w3").distinct()
    near = words.join(wanted.select(*keys).distinct(), keys, "left_semi") if keys else words
    return near.select(*keys, F.col("w3").alias("word"), "n").join(begins, "word").join(wanted, [*keys, "w3"], "left_semi").groupBy(*keys, "w3").agg(F.sum("n").alias(name))


def _limits(narrow: DataFrame, least: int, share: float) -> DataFrame:
    """(source, at_chars ARRAY, at_bytes ARRAY): the lengths at which different texts of the source pile up.

    Either hardly any text of the source is longer (for lengths of 64 and more), or next to none of the ``BEYOND`` longer lengths
    and the pile is far higher than the shorter lengths let expect, and holds 5 * ``share`` of the texts; so a source may have several limits
    in characters. (In bytes the second would also hold where plain texts end at a limit in characters.)
    """
    sizes = F.explode(F.array(F.struct(F.lit("chars").alias("what"), F.col("chars").alias("v")), F.struct(F.lit("bytes").alias("what"), F.col("bytes").alias("v"))))
    n = cut(narrow.select("source", "key", sizes.alias("x")).select("source", "key", "x.*").distinct().groupBy("source", "what", "v").agg(F.count(F.lit(1)).alias("n")))
    total = n.groupBy("source", "what").agg(F.sum("n").alias("all"))
    named = lambda d: d.withColumnsRenamed({"source": "s", "what": "k", "v": "w", "n": "m"})
    piles = n.join(named(total), F.expr("source <=> s and what = k")).drop("s", "k").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).withColumn("part", F.col("n") / F.col("all")).drop("all")
    # at most 1 / share piles a source, each with the source's distinct lengths
    near = piles.join(named(n), F.expr("source <=> s and what = k")).groupBy("source", "what", "v", "n", "part")
    some = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("m"))), F.lit(0))
    near = near.agg(some("w > v").alias("longer"), some(f"w > v and w <= v + {BEYOND}").alias("beyond"), (some(f"w < v - {BEYOND} and w >= v - {3 * BEYOND}") / (2 * BEYOND)).alias("usual"))
    last = (F.col("v") >= 64) & (F.col("longer") <= 0.1 * F.col("n"))
    cliff = (F.col("what") == "chars") & (F.col("beyond") <= 0.1 * BEYOND * F.col("n")) & (F.col("n") > F.col("usual") + 8 * F.sqrt(F.col("usual") + 1)) & (F.col("part") >= 5 * share)
    return near.filter(last | cliff).groupBy("source").agg(*[F.collect_list(F.when(F.col("what") == w, F.col("v"))).alias(f"at_{w}") for w in ("chars", "bytes")])


def cut_features(df: DataFrame, *, id: str, text: str, source: str, least: int = 3, share: float = 0.003) -> DataFrame:
    """One row for each text that could be cut: with an open end, a pause or a mark, and what the corpus says of its last words."""
    texts = _texts(df, id, text, source)
    narrow = cut(_narrow(texts))
    tri = cut(_trigrams(texts, narrow))  # as large as the corpus' vocabulary of trigrams
    two = tri.groupBy("w2", "w3").agg(*[F.sum(c).alias(f"{c}2") for c in ("inside", "ended", "open")])
    one = cut(tri.groupBy("w3").agg(*[F.sum(c).alias(f"{c}1") for c in ("inside", "ended", "open")]))  # as large as the vocabulary
    ends = narrow.filter("w3 is not null")
    wanted = ends.select("w1", "w2", "w3").distinct()
    total = lambda d, n: d.withColumn("n", F.col(f"inside{n}") + F.col(f"ended{n}")).filter("n > 0 and w3 <> '#'")
    begins = total(one, 1).select(F.col("w3").alias("word"), F.explode(F.expr("transform(sequence(1, greatest(length(w3) - 1, 1)), i -> substring(w3, 1, i))")).alias("w3"))
    begins = begins.filter("w3 <> word").join(wanted.select("w3").distinct(), "w3", "left_semi")
    e = ends.join(tri, ["w1", "w2", "w3"], "left").join(two, ["w2", "w3"], "left").join(one, ["w3"], "left")
    for d, keys, name in ((total(tri, ""), ["w1", "w2"], "longer3"), (total(two, 2), ["w2"], "longer2"), (total(one, 1), [], "longer1")):
        e = e.join(_longer(d, wanted, keys, begins, name), [*keys, "w3"], "left")
    e = e.fillna(0.0, [c + n for n in ("", "2", "1") for c in ("inside", "ended", "open")] + ["longer3", "longer2", "longer1"])
    e = e.join(_limits(narrow, least, share).withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").drop("s")
    beyond = lambda w: F.transform(F.coalesce(f"at_{w}", F.array().cast("array<int>")), lambda v: v - F.col(w))
    gaps = F.concat(beyond("chars"), beyond("bytes"))
    return e.withColumn("gap", F.array_min(F.filter(gaps, lambda g: g >= 0))).drop("at_chars", "at_bytes", "key", "context", "brief", "h")


def truncated(df: DataFrame, *, id: str, text: str, source: str, slack: int = 6, rare: float = 0.02) -> DataFrame:
    """(id, source, why) of the cut texts. See the module's text.

    rare: a share of this or less counts as almost never. The open end of the text itself is not counted as an end.
    """
    e = cut_features(df, id=id, text=text, source=source)

    def inside_word(n: str, least: int) -> Column:
        whole = F.col(f"inside{n}") + F.col(f"ended{n}") + F.greatest(F.col(f"open{n}") - 1, F.lit(0))
        return (F.col(f"longer{n or 3}") >= least) & (whole <= rare * F.col(f"longer{n or 3}"))

    def inside_sentence(n: str, least: int) -> Column:
        ends = F.col(f"ended{n}") + F.greatest(F.col(f"open{n}") - 1, F.lit(0))
        return (F.col(f"inside{n}") >= least) & (ends <= rare * (F.col(f"inside{n}") + ends))

    def surely_inside(n: str) -> Column:
        ends = F.col(f"ended{n}") + F.greatest(F.col(f"open{n}") - 1, F.lit(0))
        most = ends + 3.1 * F.sqrt(ends + 1) + 4  # what a count seldom (one in a thousand) lies below
        return most <= rare * (F.col(f"inside{n}") + ends)

    ends3 = F.col("ended") + F.greatest(F.col("open") - 1, F.lit(0))
    ending = ends3 / F.greatest(F.col("inside") + ends3 + F.col("longer3"), F.lit(1))  # how often a sentence is over after these words
    seen = lambda n: (F.col(f"inside{n}") + F.col(f"ended{n}") + F.greatest(F.col(f"open{n}") - 1, F.lit(0)) + F.col(f"longer{n or 3}")) >= 5
    words = (
        F.when(seen(""), inside_word("", 3) | inside_sentence("", 3))
        .when(seen("2"), inside_word("2", 3) | inside_sentence("2", 3))
        .otherwise(inside_word("1", 5) | inside_sentence("1", 20))
    ) | (surely_inside("2") & (ending < 0.1))
    rest3 = F.col("inside") + F.col("longer3")
    over = (ending >= 0.9) | (ends3 - rest3 > 2 * F.sqrt(ends3 + rest3))  # words that end what they stand in
    why = (
        F.when(F.col("mark").contains("\ufffd"), "damaged")
        .when(F.col("pause"), "after a pause")
        .when(F.col("bare") & (F.col("gap") <= slack) & ~(over & ((F.col("gap") > 0) | (F.col("mark") != ""))), "at the limit")
        .when(F.col("bare") & words, "by its last words")
    )
    return e.withColumn("why", why).filter("why is not null").select("id", "source", "why")


def share_cut(df: DataFrame, *, id: str, text: str, source: str) -> DataFrame:
    """(source, texts, cut, share) for each source."""
    all_ = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    cuts = truncated(df, id=id, text=text, source=source).groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("cut"))
    return all_.join(cuts, F.expr("source <=> s"), "left").select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
