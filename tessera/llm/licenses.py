"""License scans with a positional rare-token index.

Licence words are those of the templates and key phrases below; their inverse document
frequency is counted over all documents. The index holds postings (template or phrase, position)
for the ``RARE`` highest-IDF words of each, the rarest word of every phrase included. A file's
indexed words are looked up from the highest IDF down; a posting puts the template or phrase at
a relative position, votes for the same position are intersected, and the words there are
compared. A label needs its mandatory key phrase in place and ``MIN_SCORE`` of the template's
IDF weight at one relative position; the three base labels need their phrase only.

Null and empty texts have no words and no labels. Repeated rows are scanned one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes
from tessera.llm.decontam import words

RARE = 4
MIN_SCORE = 0.5

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    text: str


# Short public licence notices and the phrase each must contain.
TEMPLATES = (
    Template("mit", "under the mit license", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "attribution noncommercial", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc0", "public domain dedication", "creative commons cc0 1 0 universal public domain dedication"),
    Template("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted"),
)


class RareIndex:
    """Phrases and templates over a dense licence word numbering, with their rare-word postings."""

    def __init__(self, templates: tuple[Template, ...], base: dict[str, str]):
        self.templates, self.base = templates, list(base.items())
        phrases = list(dict.fromkeys([*base, *(t.phrase for t in templates)]))
        self.vocab: dict[bytes, int] = {}
        number = lambda s: np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(s.encode())], np.int64)
        self.phrase = {p: number(p) for p in phrases}
        self.text = [number(t.text) for t in templates]

    def weigh(self, holding: np.ndarray, total: int, rare: int = RARE) -> None:
        """IDF of each word and the postings of the rare ones, the highest IDF first."""
        self.idf = np.log((total + 1) / (holding + 1)) + 1e-3
        rarest = lambda ids: sorted(range(len(ids)), key=lambda i: (-self.idf[ids[i]], i))
        post: dict[int, list] = {}
        for p, ids in self.phrase.items():
            i = rarest(ids)[0]
            post.setdefault(int(ids[i]), []).append((p, i))
        for t, ids in enumerate(self.text):
            for i in rarest(ids)[:rare]:
                post.setdefault(int(ids[i]), []).append((t, i))
        self.postings = sorted(post.items(), key=lambda x: (-self.idf[x[0]], x[0]))
        self.rare = np.zeros(len(self.vocab) + 1, bool)
        self.rare[list(post)] = True

    def scan(self, ids: np.ndarray) -> tuple[dict[str, list[int]], dict[str, float]]:
        """Places of each phrase found, and the score of each label the method gives."""
        at = np.flatnonzero(self.rare[ids])
        places: dict[str, list[int]] = {}
        votes: dict[tuple[int, int], int] = {}
        for word, posts in self.postings:
            here = at[ids[at] == word]
            if not len(here):
                continue
            for what, offset in posts:
                starts = here - offset
                if isinstance(what, str):
                    want = self.phrase[what]
                    starts = starts[(starts >= 0) & (starts + len(want) <= len(ids))]
                    for k, w in enumerate(want):
                        starts = starts[ids[starts + k] == w]
                    if len(starts):
                        places[what] = starts.tolist()
                else:
                    for s in starts.tolist():
                        votes[what, s] = votes.get((what, s), 0) + 1
        scores: dict[str, float] = {}
        for (t, s), _ in votes.items():
            template, want = self.templates[t], self.text[t]
            found = places.get(template.phrase)
            if not found:
                continue
            k = np.arange(max(0, -s), min(len(want), len(ids) - s))
            part = self.idf[want]
            score = float(part[k][ids[s + k] == want[k]].sum() / part.sum())
            near = any(s <= p < s + len(want) for p in found)
            if near and score >= MIN_SCORE:
                scores[template.label] = max(score, scores.get(template.label, 0.0))
        return places, scores


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE_PHRASES,
         out_col: str = "license") -> DataFrame:
    """``docs`` with a struct column ``out_col`` (one of that name is replaced): n_words, n_base, first_word, last_word,
    base_labels and labels (sorted arrays), score (of the best label; 0 without one)."""
    index = RareIndex(templates, base)
    docs = docs.drop(out_col)
    only = docs.select(text_bytes(text_col).alias("text"))

    def count(batches):
        n, total = np.zeros(len(index.vocab), np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                n[[index.vocab[w] for w in set(words(text)).intersection(index.vocab)]] += 1
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(n)), -1)), pa.array(np.append(n, total))], names=["word", "n"])

    sums = {r.word: r.n for r in only.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index.weigh(np.array([sums.get(i, 0) for i in range(len(index.vocab))], np.int64), sums.get(-1, 0))
    schema = ("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,score:double>")
    out = docs.withColumn(out_col, F.lit(None).cast(schema))

    def run(batches):
        get = index.vocab.get
        none = len(index.vocab)
        for b in batches:
            cols = [[] for _ in range(7)]
            for text in b.column(text_col).cast(pa.binary()).to_pylist():
                ids = np.array([get(w, none) for w in words(text or b"")], np.int64)
                places, scores = index.scan(ids)
                hits = sorted(p for phrase, _ in index.base for p in places.get(phrase, ()))
                labels = {label for phrase, label in index.base if phrase in places}
                best = max(scores.values(), default=0.0)
                row = (len(ids), len(hits), hits[0] if hits else None, hits[-1] if hits else None, sorted(labels), sorted(labels | set(scores)),
                       max(best, MIN_SCORE) if labels else best)
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            s = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                           names=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, out.schema)
