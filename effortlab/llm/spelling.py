"""Spelling variants by PartEnum signatures over letter multisets.

A word is a binary vector with one bit for the i-th occurrence of a letter.
One inserted or deleted letter changes one bit, a replaced one two, so near
words differ in at most two bits.  Partition and enumerate: the letters are
dealt to parts, evenly by how often the words use them; two bits lie in at
most two parts, so near words agree on all the others, and a signature is
written for every way to leave two parts out.  An edit also leaves either the
first or the last letters of both words alone (half the length of the shorter
one), so a signature is written once with the first and once with the last
letters, for the word's own length and, as the longer word of a pair, for one
less.  That keeps groups small when few letters make many words.  Words that share a
signature meet in an equi-join whose condition verifies the edit at once: only
near pairs leave it.

Counting is one aggregate that combines map-side, so frequent words cost
nothing; everything after works on distinct words.  A text goes through in
pieces of some hundred words, never as one array.

Defined results: a null text has no words, a null id counts as an empty one.
Rows are counted as often as they stand in the table; other columns are not
read.  Empty tables give no words.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The letters of a run, and those that are lower-cased.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a piece.
PIECE_WORDS = 200


def runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters of every text, A-Z lower-cased."""
    piece = F.lit(f"(?:[^{LETTERS}]*+[{LETTERS}]++){{1,{PIECE_WORDS}}}")
    pieces = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                         F.explode(F.regexp_extract_all(F.col(text), piece, 0)).alias("piece"))
    low = F.translate("piece", UPPER, UPPER.lower())
    return pieces.select("id", F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]+"), 0)).alias("run"))


def misspelt(found: DataFrame, every: int = 31) -> DataFrame:
    """(word): the runs; where ``every`` divides the checksum of id and run,
    the run lacks the letter at the checksum modulo its length."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = found.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, *, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return (words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def deal_letters(words: DataFrame, parts: int) -> list[str]:
    """The letters of the words in ``parts`` parts that hold about as many bits
    each (the largest letter first, to the part that holds least)."""
    uses = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").groupBy("c").count()
    held, out = [0] * parts, [""] * parts
    for c, n in sorted(map(tuple, uses.collect()), key=lambda u: (-u[1], u[0])):       # the alphabet, no more
        p = min(range(parts), key=held.__getitem__)
        held[p] += n
        out[p] += c
    return out


def projections(word: str, letters: list[str]) -> list[Column]:
    """The letters that a word has of every part, in order: its bits there."""
    ordered = F.array_join(F.sort_array(F.split(word, "")), "")
    others = ["".join(p for j, p in enumerate(letters) if j != i) for i in range(len(letters))]
    return [F.translate(ordered, o, "") if o else ordered for o in others]


def signatures(word: Column, least: Column, parts: list[Column], bits: int = 2) -> Column:
    """Array of a word's signatures against words of the least length ``least``:
    all ways to leave ``bits`` of the parts out, with the first and with the
    last letters, half of ``least``."""
    half = F.floor(least / 2).cast("int")
    return F.array(*[F.xxhash64(F.lit(2 * k + side), least, end, *chosen)
                     for k, chosen in enumerate(combinations(parts, len(parts) - bits))
                     for side, end in enumerate([F.left(word, half), F.right(word, half)])])


def near_pairs(words: DataFrame, *, parts: int = 3) -> DataFrame:
    """(a, a_n, b, b_n), a < b: words that differ by exactly one inserted,
    deleted or replaced letter.  ``words`` has word and n, each word once."""
    held = [f"p{i}" for i in range(parts)]
    split = words.select("word", "n", *[p.alias(c) for c, p in zip(held, projections("word", deal_letters(words, parts)), strict=True)])
    # As long as the shorter word of its pair, or one letter longer.
    roles = split.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    roles = roles.withColumn("least", F.length("word") - F.col("longer").cast("int")).filter("least > 0")
    signed = roles.select(F.explode(signatures(F.col("word"), F.col("least"), [F.col(c) for c in held])).alias("s"), "word", "n", "longer")
    a, b = signed.toDF("s", "a", "a_n", "a_longer"), signed.toDF("s", "b", "b_n", "b_longer")
    near = (F.col("a") < F.col("b")) & ~(F.col("a_longer") & F.col("b_longer")) & (F.levenshtein("a", "b", 1) == 1)
    # A pair may share several signatures.
    return a.join(b, "s").filter(near).select("a", "a_n", "b", "b_n").distinct()


def group_variants(words: DataFrame, *, times: int = 10, parts: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n).

    ``form``: the near word of largest n (the smallest of equals) if its n is
    ``times`` the word's n at least; ``root``: where following forms ends."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words, "words")
    pairs = near_pairs(words, parts=parts)
    both = pairs.select("a", F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    forms = scratch.put(forms, "forms")

    # n grows `times`-fold on every step, so the longest chain follows from the largest n.
    least, most = forms.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(most / least, times) + 1e-9) if least and times > 1 else 0
    links = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for k in range(max(steps - 1, 0).bit_length()):                  # each round doubles the steps taken
        links = scratch.put(links, f"links-{k}")
        ahead = links.toDF("root", "next")
        links = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                    "n", "n_near", "form_n")
