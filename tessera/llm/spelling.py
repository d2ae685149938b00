"""Spelling variant grouping with pivotal grams.

Two words are near when one inserted, deleted or replaced code point turns one into the other.
Such an edit touches at most one of two disjoint bigrams, so:

* Bigrams are ranked over the vocabulary, the rarest first. A word's *prefix* is its three first
  bigrams in that order (all places of the third one); its two *pivots* are the disjoint bigrams
  of the prefix with the smallest total frequency, chosen by dynamic programming over the places.
* Of two near words, one pivot of the word whose prefix ends earlier in the ranking survives in the
  other word, within that word's prefix, at most one place away. Pivots are therefore looked up in
  an index of the other words' prefixes, and only in words whose prefix ends no earlier.
* Position limits: with the edit outside the surviving pivot, either all up to the pivot's end or all
  from its start is unchanged. A posting is keyed by that side (which fixes the pivot's place from the left or
  from the right) and the length, and where the side is short also by the half of the other side
  that the edit left alone. That is finer than "one place away" and keeps lists short in a growing vocabulary.
* Pairs that share a posting are verified by edit distance inside the join; only near pairs leave it.

Words are counted in the tasks that read the texts. Bigrams of the alphabet are at most 90 x 90,
which bounds the table of their ranks that goes to every task.

Null and empty texts have no words. A null id alters no run (its hash is undefined). Repeated rows
count again. An empty table gives no rows. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import emit, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")       # fixed value
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
TYPO_EVERY = 97                                   # fixed value
MIN_CHARS, MIN_COUNT = 5, 3                       # fixed values
PREFIX_GRAMS, PIVOTS, GRAM = 3, 2, 2
SHORT_SIDE = 8           # sides below this many code points are keyed by half of the other side too
HELD_WORDS = 200_000     # counts a task holds before it sends them on


def altered(word: str, doc_id, typo_every: int = TYPO_EVERY) -> str:
    """``word`` as it stands in the document: one code point lost where the hash says so."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % typo_every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n) of all words of ``min_chars`` code points that occur ``min_count`` times."""

    def run(batches):
        def counted():
            held: Counter = Counter()
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own: Counter = Counter()
                    for word, n in Counter(RUN.findall(text or "")).items():
                        own[word.translate(LOWER)] += n
                    for word, n in own.items():
                        if len(word) >= min_chars and len(word := altered(word, doc_id, typo_every)) >= min_chars:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield list(held), list(held.values())
                    held = Counter()
            yield list(held), list(held.values())

        yield from emit(counted(), ["word", "n"], [pa.string(), pa.int64()])

    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Places of each bigram in the vocabulary; as many entries as the alphabet has pairs."""
    places = F.transform(F.sequence(F.lit(1), F.char_length("word") - GRAM + 1), lambda i: F.col("word").substr(i, F.lit(GRAM)))
    rows = words.select(F.explode(places).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: r["count"] for r in rows}


def prefix_and_pivots(word: str, rank: dict[str, int], count: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Places of the prefix grams, places of the pivots, and the rank that ends the prefix."""
    grams = [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]
    ranks = [rank[g] for g in grams]
    last = sorted(ranks)[PREFIX_GRAMS - 1]
    prefix = [i for i, r in enumerate(ranks) if r <= last]
    # best[k]: cheapest (weight, places) of k disjoint grams among those seen, for each end place
    best: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())]] + [[] for _ in range(PIVOTS)]
    for i in prefix:
        for k in range(PIVOTS, 0, -1):
            before = [b for b in best[k - 1] if not b[1] or b[1][-1] + GRAM <= i]
            if before:
                weight, places = min(before)
                best[k].append((weight + count[grams[i]], (*places, i)))
    return prefix, list(min(best[PIVOTS])[1]), last


def keys(word: str, at: int, probe: bool):
    """Posting keys of the gram at a place: the unchanged side, and what else must be equal."""
    n = len(word)
    for side, kept, rest in (("L", word[:at + GRAM], word[at + GRAM:]), ("R", word[at:], word[:at])):
        if len(kept) >= SHORT_SIDE:
            for length in ((n - 1, n, n + 1) if probe else (n,)):
                yield f"{side}{length}\t{kept}"
            continue
        # the shorter word's rest has m code points; the edit lies outside its first or its last half
        for m in (len(rest), len(rest) - 1):
            if m >= 0:
                half = m // 2
                yield f"{side}<{m}\t{kept}\t{rest[:half]}"
                yield f"{side}>{m}\t{kept}\t{rest[len(rest) - (m - half):]}"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of words one edit apart."""
    count = gram_counts(words)
    rank = {g: i for i, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}

    def run(batches):
        def postings():
            for b in batches:
                key, word, last, probe = [], [], [], []
                for w in b.column(0).to_pylist():
                    prefix, pivots, end = prefix_and_pivots(w, rank, count)
                    for places, asks in ((prefix, False), (pivots, True)):
                        own = {xxhash.xxh64_intdigest(k) for i in places for k in keys(w, i, asks)}
                        key += own
                        word += [w] * len(own)
                        last += [end] * len(own)
                        probe += [asks] * len(own)
                yield pa.array(key, pa.uint64()).view(pa.int64()), word, last, probe

        yield from emit(postings(), ["key", "word", "last", "probe"], [pa.int64(), pa.string(), pa.int32(), pa.bool_()])

    rows = stored(words.select("word").mapInArrow(run, "key long, word string, last int, probe boolean"), "spelling-postings")
    p = rows.where("probe").select("key", F.col("word").alias("a"), F.col("last").alias("a_last"))
    x = rows.where("not probe").select("key", F.col("word").alias("b"), F.col("last").alias("b_last"))
    near = F.expr("a_last <= b_last AND abs(char_length(a) - char_length(b)) <= 1 AND levenshtein(a, b, 1) = 1")
    found = p.hint("merge").join(x, (p.key == x.key) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form. Counts double along a chain, so it has at most 62
    steps; each round doubles the steps followed."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
             typo_every: int = TYPO_EVERY, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root: each word with its number of near words, the near word
    of largest count if that is ``ratio`` times its own (ties: the smallest), and where forms lead to."""
    if min_chars < PREFIX_GRAMS + GRAM - 1:
        raise ValueError("words need three bigrams")
    words = stored(word_counts(docs, id_col, text_col, min_chars, min_count, typo_every), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("word", "other")
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    out = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-forms")
    end = roots(out.where("form is not null"))
    return out.join(end, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
