"""Token ids of texts under a word-level BPE vocabulary, by the whole-token shortcut.

Most pre-tokens of a text are vocabulary strings that encode, alone, as exactly
one token.  :func:`whole_tokens` proves that for every vocabulary string by
asking the library; pre-tokens found in this table need no merging.  Only the
rest goes through the library's merges, and repeats of it are remembered in a
table of bounded size.

Texts with characters outside the Latin ranges below, or that may hold a special
token, go to the library whole: its result is the definition of a right one.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np

#: Pre-tokens remembered beside the whole tokens; over this the table starts anew.
REMEMBERED = 300_000

# Character classes of lower-cased text within the fast range (U+0000-U+017F and general punctuation).
_SPACE = "\t-\r \x85\xa0"
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BEYOND = re.compile("[^\x00-įı-ſ‐-‧‰-⁞€]|<\\|")


def default_vocabulary() -> str:
    """Path of the vocabulary file of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file; one per process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character; this is the way back."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, int]:
    """Every vocabulary string that is one pre-token and that the library encodes, alone, as one token."""
    tok, back = tokenizer(path), _bytes_of_symbols()
    strings = []
    for symbol in tok.get_vocab(with_added_tokens=False):
        if symbol.endswith("</w>"):
            try:
                s = bytes(back[c] for c in symbol[:-4]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if _PRE_TOKEN.fullmatch(s) and not _BEYOND.search(s):
                strings.append(s)
    encoded = tok.encode_batch(strings, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(strings, encoded) if len(e.ids) == 1}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Table:
    """Pre-token -> its ids as bytes, or their number; whole tokens are there from the start, the rest is merged on first sight."""

    def __init__(self, path: str, packed: bool):
        self.tok, self.packed = tokenizer(path), packed
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids with the word-end mark
        self.last[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.known = {s: _pack([i]) if packed else 1 for s, i in whole_tokens(path).items()}
        self.kept = len(self.known) + REMEMBERED // 2

    def of(self, text: str) -> Iterator:
        """The values of all pre-tokens of ``text``; those not known yet are merged in one call."""
        words = _PRE_TOKEN.findall(text.lower())
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.kept + REMEMBERED // 2:  # those seen first, mostly the common ones, stay
                self.known = dict(islice(self.known.items(), self.kept))
                new = set(words).difference(self.known)
            self.learn(list(new))
        return map(self.known.__getitem__, words)

    def learn(self, new: list[str]) -> None:
        ids = np.array(self.tok.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1  # the last token of a word has the word-end mark
        if len(ends) != len(new):
            raise ValueError(f"{len(new)} words came back as {len(ends)}: this vocabulary does not mark word ends as expected")
        if self.packed:
            data, at = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(new, map(data.__getitem__, map(slice, [0, *at[:-1]], at))))
        else:
            self.known.update(zip(new, np.diff(ends, prepend=0).tolist()))


@functools.lru_cache(maxsize=4)
def _table(path: str, packed: bool) -> _Table:
    return _Table(path, packed)


def _beyond(text: str) -> bool:
    """Whether the library has to encode the whole text."""
    return "<|" in text if text.isascii() else _BEYOND.search(text) is not None


def count_tokens(text: str, path: str) -> int:
    """Number of tokens of ``text`` without special tokens added."""
    if _beyond(text):
        return len(tokenizer(path).encode(text, add_special_tokens=False).ids)
    return sum(_table(path, False).of(text))


def token_bytes(text: str, path: str) -> bytes:
    """The token ids of ``text`` as little-endian unsigned 32-bit integers."""
    if _beyond(text):
        return _pack(tokenizer(path).encode(text, add_special_tokens=False).ids)
    return b"".join(_table(path, True).of(text))
