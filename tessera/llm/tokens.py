"""Token ids of whole texts by a public byte-level BPE tokenizer, for tasks.

The tokenizer splits a text into pre-tokens that never run from a visible character into white
space, nor from a letter into punctuation. So a text may be cut before white space that follows
a visible character, and a word from the punctuation behind it, and the parts encoded one by
one by the library. Parts come again and again: the ids of each are kept, and the ids of a
batch of texts are gathered from them with numpy.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

KEPT_PARTS = 350_000       # parts kept as new, and as many again that were new before

#: White space and invisible characters on which Unicode tables differ: texts that hold them
#: are cut only between plainly visible characters and single blanks.
_ODD_CLASS = r"\x00-\x08\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}"
_ODD = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _ODD_CLASS) + "]")
#: Not plain: such a character, or white space before a blank or a line end.
_NOT_PLAIN = rf"[ \n\t][ \n]|[{_ODD_CLASS}]"
_SAFE_CUT = re.compile("(?<=[!-~\u00c0-\u024f])(?=[ \n])")
_PARTS = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
_LETTERS = frozenset(chr(c) for c in range(0x41, 0x250) if chr(c).isalpha() and (c < 0x80 or c >= 0xc0))
#: A single pre-token whatever the library's Unicode tables.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_TAIL = ".,;:!?"
_ENDS = frozenset(_TAIL)
_TOGETHER = 1 << 6         # parts encoded in one call


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary, by Latin-1 code point."""
    own = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER_OF_BYTE = _byte_letters()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, as the library gives them by default: the
    string of a special token inside a text is that token; none are added. Texts with such a string are encoded by the
    library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True                 # parts hold none
        self._whole = Tokenizer.from_file(path)
        added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        pre = self._tokenizer.pre_tokenizer
        self._model = self._tokenizer.model
        # words of letters alone go straight to the library's model: nothing before it would change or cut them
        self._bare = (self._tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex
                      and not pre.add_prefix_space and isinstance(self._model, models.BPE))
        self._line_end, = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}       # runs of punctuation behind a letter

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. A word's ids and those of the punctuation behind it are kept apart; what is not
        kept is encoded, each once."""
        if len(self._new) > KEPT_PARTS:
            self._old, self._new = self._new, {}
        new, old, tails = self._new, self._old, self._tails
        words = [p.rstrip(_TAIL) if p[-1:] in _ENDS else p for p in parts]
        cut = [i for i, (w, p) in enumerate(zip(words, parts)) if len(w) < len(p)]
        for i in cut:
            if words[i][-1:] not in _LETTERS:              # the punctuation may belong to what stands before it
                words[i] = parts[i]
        out = list(map(new.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        wanted = {}
        for i in missing:
            w = words[i]
            x = old.get(w)
            if x is None:
                wanted[w] = None
            else:
                out[i] = new[w] = x
        ends = {p[len(w):]: None for p, w in ((parts[i], words[i]) for i in cut) if len(w) < len(p)}
        new[""] = b""
        wanted.pop("", None)
        self._encode(list(wanted), new)
        self._encode([e for e in ends if e not in tails], tails)
        for i in missing:
            if out[i] is None:
                out[i] = new[words[i]]
        for i in cut:
            n = len(words[i])
            if n < len(parts[i]):
                out[i] += tails[parts[i][n:]]
        return out

    def _encode(self, parts: list[str], into: dict[str, bytes]) -> None:
        """Encode parts ``into`` a table by the library: words by its model, other parts many at once: a line end between
        two parts is a token of its own, and its id occurs in no part without a line end."""
        if self._bare:
            tokenize, match, others = self._model.tokenize, _WORD.fullmatch, []
            for p in parts:
                if match(p):
                    letters = p.replace(" ", "\u0120") if p.isascii() else p.encode().decode("latin-1").translate(_LETTER_OF_BYTE)
                    into[p] = array("I", [t.id for t in tokenize(letters)]).tobytes()
                else:
                    others.append(p)
            parts = others
        alone = [p for p in parts if "\n" in p or p[-1] in " \t" or _ODD.search(p)]
        aside = set(alone)
        rest = [p for p in parts if p not in aside]
        for at in range(0, len(rest), _TOGETHER):
            some = rest[at:at + _TOGETHER]
            ids = np.array(self._tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self._line_end)
            if len(cuts) != len(some) - 1:
                raise RuntimeError("a part ran into its neighbour")
            lo = [0, *(cuts + 1).tolist()]
            raw = ids.tobytes()
            into.update(zip(some, (raw[4 * a:4 * b] for a, b in zip(lo, [*cuts.tolist(), len(ids)]))))
        for p in alone:
            into[p] = np.array(self._tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; equal texts of a call are encoded once."""
        distinct = list(dict.fromkeys(texts))
        if len(distinct) < len(texts):
            ids = dict(zip(distinct, self._encode_texts(distinct)))
            return [ids[t] for t in texts]
        return self._encode_texts(texts)

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):                       # bounded characters at a time
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 1 << 23):
                size += len(texts[upto])
                upto += 1
            column = pa.array(texts[at:upto], pa.large_string())
            odd = pc.match_substring_regex(column, _NOT_PLAIN).to_numpy(zero_copy_only=False)
            special = np.array([self._special.search(t) is not None for t in texts[at:upto]], bool)
            plain = np.flatnonzero(~odd & ~special)
            for i, x in zip((plain + at).tolist(), self._gather(column.take(pa.array(plain)), [texts[i] for i in (plain + at).tolist()])):
                out[i] = x
            for i in (np.flatnonzero(special) + at).tolist():
                out[i] = np.array(self._whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
            for i in (np.flatnonzero(odd & ~special) + at).tolist():
                parts = _SAFE_CUT.split(texts[i]) if _ODD.search(texts[i]) else _PARTS.findall(texts[i])
                out[i] = b"".join(self._ids(parts))
            at = upto
        return out

    def _gather(self, column: pa.Array, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # One blank before each line end makes every piece but the first of a text follow a blank:
        # its own (the part is the blank and the piece) or, before a line end, the one added here.
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        coded = pieces.values.dictionary_encode()
        n = len(coded.dictionary)
        whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), coded.dictionary), pa.scalar("\x00", pa.large_string()))[0].as_py()
        parts = [p if p[:1] == "\n" else " " + p for p in whole.split("\x00")]
        which = coded.indices.to_numpy().astype(np.int64)
        cuts = pieces.offsets.to_numpy()
        heads = [t.split(" ", 1)[0].split("\n", 1)[0] for t in texts]      # without a blank in front
        names = list(dict.fromkeys(heads))
        number = {h: len(parts) + k for k, h in enumerate(names)}
        which[cuts[:-1]] = [number[h] for h in heads]
        ids = self._ids(parts + names)
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first = np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        tokens = flat[np.repeat(first[which] - (end - n), n) + np.arange(int(end[-1]))]
        stop = np.concatenate([[0], end])[cuts]
        return [tokens[a:b].tobytes() for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker for a tokenizer file; by default the public byte-level
    BPE vocabulary of 50k ids."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
