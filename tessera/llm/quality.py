"""Quality rules: a linear-chain conditional random field labels lines as content or
boilerplate, and the share of content decides whether a document stays.

Training reads a bounded sample of labelled documents (``SAMPLE_DOCS`` of each label, by hash
order, one text an id, of at most ``SAMPLE_CHARS`` characters and ``SAMPLE_LINES`` lines): every line of a good document counts as content,
every line of a bad one as boilerplate. Decoding covers every line of every document: scores
of all lines of a batch come from one matrix product, Viterbi runs through each document.
With no labelled rows of either kind all lines are content.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail the base rule.
Rows, repeated ones too, are judged one by one; other columns are carried along, but for one of the
name of the output column, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 400         # labelled documents of each label used for fitting
SAMPLE_CHARS = 20_000
SAMPLE_LINES = 2_000
MIN_CONTENT = 0.4         # share of word characters in content lines that keeps a document
MIN_WORDS = 50            # fixed value
MAX_REPEAT_PERCENT = 50   # fixed value
SYMBOLS = "#*$%&|<>"      # fixed value

SPACE, LETTER, UPPER, DIGIT, SYMBOL, STOP, OTHER, TAIL = range(8)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[97:123] = LETTER
_KIND[192:] = LETTER                      # first bytes of longer code points
_KIND[128:192] = TAIL                     # their other bytes
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
_KIND[list(SYMBOLS.encode())] = SYMBOL
_KIND[list(b".,;:!?")] = STOP
N_FEATURES = 11


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the lines of each text, and the word characters of each line. They are
    shares of character kinds and how the line ends; line and word lengths are left out, as they made
    held-out clean texts of one long line look like boilerplate."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    kind = _KIND[data]
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([[0], breaks[:-1] + 1])
    lines = np.diff(np.concatenate([[0], np.searchsorted(breaks, np.cumsum(lengths) - 1, "right")]))

    def tally(mask):
        return np.add.reduceat(mask, start, dtype=np.int64)

    chars = tally((kind != SPACE) & (kind != TAIL))
    some = np.maximum(chars, 1)
    part = np.stack([tally(kind == k) / some for k in (LETTER, UPPER, DIGIT, SYMBOL, STOP, OTHER)], axis=1)
    f = np.empty((len(start), N_FEATURES))
    f[:, 0] = 1
    f[:, 1:7] = part
    f[:, 7] = part[:, 1] > 0.5
    f[:, 8] = part[:, 3] > 0.08
    f[:, 9] = (kind[np.maximum(breaks - 1, 0)] == STOP) & (chars > 0)
    f[np.cumsum(lines) - 1, 9] = 1                # a text may break off in its last line
    f[:, 10] = chars == 0
    return f, lines, chars


class LineField:
    """Linear-chain CRF with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray, change: np.ndarray):
        self.weights, self.change = weights, change

    @classmethod
    def fit(cls, features: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3):
        """Gradient ascent (Adam) on the mean log-likelihood of a line, all documents at once, padded."""
        w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        if not labels or len(set(labels)) < 2:
            w[0, 1] = 1.0
            return cls(w, t)
        longest = max(map(len, features))
        x = np.zeros((len(features), longest, N_FEATURES))
        on = np.zeros((len(features), longest))
        for i, f in enumerate(features):
            x[i, :len(f)], on[i, :len(f)] = f, 1
        y = np.array(labels)
        gold = on[:, :, None] * (np.arange(2) == y[:, None])[:, None, :]
        weight = (1 / on.sum(axis=1)) / len(y)                      # every document weighs the same
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, t)]
        pairs = (on[:, 1:] * on[:, :-1]).sum(axis=1)
        same = np.zeros((2, 2))
        for label in (0, 1):
            same[label, label] = (weight * pairs)[y == label].sum()
        for step in range(1, rounds + 1):
            s = x @ w
            fwd = np.empty_like(s)
            back = np.zeros_like(s)
            fwd[:, 0] = s[:, 0]
            for i in range(1, longest):
                nxt = s[:, i] + np.logaddexp(fwd[:, i - 1, 0, None] + t[0], fwd[:, i - 1, 1, None] + t[1])
                fwd[:, i] = np.where(on[:, i, None] > 0, nxt, fwd[:, i - 1])
            for i in range(longest - 2, -1, -1):
                ahead = s[:, i + 1] + back[:, i + 1]
                nxt = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
                back[:, i] = np.where(on[:, i + 1, None] > 0, nxt, 0)
            total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(fwd + back - total[:, None, None]) * on[:, :, None]
            grad_w = np.einsum("dlf,dlk,d->fk", x, gold - p, weight) - decay * w
            edge = np.exp(fwd[:, :-1, :, None] + t + (s + back)[:, 1:, None, :] - total[:, None, None, None])
            grad_t = same - np.einsum("dljk,dl,d->jk", edge, on[:, 1:], weight) - decay * t
            for p_, g, (m, v) in ((w, grad_w, moments[0]), (t, grad_t, moments[1])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return cls(w, t)

    def decode(self, scores: list[list[float]]) -> list[int]:
        """Viterbi path of one document from its lines' label scores."""
        (aa, ab), (ba, bb) = self.change.tolist()
        back = []
        a, b = scores[0]
        for sa, sb in scores[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab > b + bb
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = sa + (a + aa if from_a else b + ba), sb + (a + ab if from_b else b + bb)
        path = [0 if a > b else 1]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def content_share(self, texts: list[bytes]) -> np.ndarray:
        """Share of each text's word characters that stand in content lines (1 if it has none)."""
        if not texts:
            return np.zeros(0)
        f, lines, chars = line_features(texts)
        scores = (f @ self.weights).tolist()
        content = np.empty(len(scores))
        at = 0
        for n in lines.tolist():
            content[at:at + n] = self.decode(scores[at:at + n])
            at += n
        first = np.cumsum(lines) - lines
        total = np.add.reduceat(chars, first)
        return np.where(total > 0, np.add.reduceat(chars * content, first) / np.maximum(total, 1), 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
        sample_lines: int = SAMPLE_LINES) -> LineField:
    """A field fitted on at most ``sample_docs`` documents of each label (bounded, so driver-side). Of
    rows that share a chosen id, however many, one text goes to the driver (the smallest by hash)."""
    short = F.length("text").between(1, sample_chars) & (F.size(F.split("text", "\n")) <= sample_lines)
    labelled = (docs.select("doc_id", "text").where(short).join(F.broadcast(_chosen(labels, sample_docs)), "doc_id")
                .groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
                .select("doc_id", "quality", "t.text"))
    feats, ys = [], []
    for r in sorted(labelled.collect(), key=lambda r: (r.quality, r.doc_id, r.text)):
        f, _, chars = line_features([r.text.encode()])
        if chars.any():
            feats.append(f)
            ys.append(int(r.quality))
    return LineField.fit(feats, ys)


def _chosen(labels: DataFrame, n: int) -> DataFrame:
    """The first n ids of each label in hash order (2 n rows)."""
    parts = [labels.where((F.col("quality") == q) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for q in (0, 1)]
    return parts[0].union(parts[1])


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]
    w = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(words), bool)
    i = np.concatenate([order[1:][same], order[:-1][same]])
    hit[i] = hit[i + 1] = hit[i + 2] = True
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    chars = len(text.translate(None, b" \t\n\v\f\r" + bytes(range(128, 192))))
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, field: LineField, text_col: str = "text", min_content: float = MIN_CONTENT,
          out_col: str = "quality_rules") -> DataFrame:
    """``docs`` with a struct column ``out_col``: the counts, content_share, base_failed, kept."""
    docs = docs.drop(out_col)
    out = docs.withColumn(out_col, F.lit(None).cast(
        "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ",content_share:double,base_failed:boolean,kept:boolean>"))

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            share = field.content_share(texts)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            cols = [*counts.T, share, failed, ~failed & (share >= min_content)]
            s = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=[*COUNTS, "content_share", "base_failed", "kept"])
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, out.schema)
