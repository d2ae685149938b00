"""Text expressions: title composition, guards, previews, word/character tokens, chunking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference behaviour.
CHUNK_SIZE = 256          # words per chunk
CHUNK_OVERLAP = 32        # words shared by consecutive chunks
MAX_TEXT_CHARS = 50000    # demo UI length limit
PREVIEW_CHARS = 200       # retrieval printout preview
TITLE_PREFIX = "Title: "  # "Title: {title}\n{text}"

# Python str.split() splits on Unicode white space and on the separators
# U+001C..U+001F; Java's (?U)\s covers the first, the class adds the second.
WORD_SPLIT = r"(?U)[\s\x1c-\x1f]+"
VISIBLE = r"(?U)[^\s\x1c-\x1f]"      # any character that is not white space


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where inner lambdas use it: a lambda evaluates an
    outer expression again for each element, but not its own variable."""
    return F.transform(F.array(value), body)[0]


def compose_title(title, text) -> Column:
    return F.concat(F.lit(TITLE_PREFIX), col_(title), F.lit("\n"), col_(text))


def words(text) -> Column:
    """Whitespace words of ``text`` (like ``str.split()``), empty strings removed."""
    return F.filter(F.split(col_(text), WORD_SPLIT), lambda w: w != "")


def lower_words(text) -> Column:
    return words(F.lower(col_(text)))


def characters(text) -> Column:
    """Code points of ``text`` as one-character strings."""
    return F.split(col_(text), "")


def chunk_array(word_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of ``size`` words starting every ``size - overlap`` words, joined by one space.

    ``word_col`` must name a materialised word-array column (see ``words``):
    the lambda then reads that column instead of re-splitting the text for
    every chunk. n words give ceil(n / (size - overlap)) chunks; none for blank text.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("chunk overlap must be smaller than chunk size")
    w = F.col(word_col)
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    return F.when(n > 0, chunks).otherwise(F.array().cast("array<string>"))


def guard_status(text, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """'empty' for blank text, 'too_long' above the limit, else 'ok'."""
    t = col_(text)
    return (
        F.when(t.isNull() | ~t.rlike(VISIBLE), F.lit("empty"))
        .when(F.length(t) > max_chars, F.lit("too_long"))
        .otherwise(F.lit("ok"))
    )


def truncate(text, max_chars: int = MAX_TEXT_CHARS) -> Column:
    return F.substring(col_(text), 1, max_chars)


def preview(text, n: int = PREVIEW_CHARS) -> Column:
    t = col_(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def utf8_bytes(text) -> Column:
    return F.encode(col_(text), "UTF-8")
