"""Exact encoders that meet each distinct pre-token once per worker, as long as its table holds it.

A byte-level vocabulary encodes pre-tokens one by one, and none spans the start of a run of white space. What a
pattern of the standard library can tell for sure (Latin words, digits, ASCII marks, white space) is cut
into pre-tokens; the library cuts everything else, from one such boundary to the next white space.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

_UNITS = re.compile(r"\s*\S+|\s+").findall
WORDS = re.compile(r"[^ \t\n\r]+").findall
#: Python counts these four as white space, the tokenizers don't.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"!-/:-@\[-`{-~"
_SURE = r"(?![^\x00-\x7fÀ-ɏ])"  # no letter or digit of another kind goes on with the run
_PRETOKENS = re.compile(rf" ?[{_LATIN}]++{_SURE}| ?[0-9]++{_SURE}|'(?:[stmd]|re|ve|ll)| ?[{_MARKS}]++{_SURE}| ?\S+|\s+(?!\S)|\s+").findall
#: Distinct pre-tokens of a generation. A worker keeps two: what the newer one lacks is looked up in the older one.
CACHE_UNITS = 100_000

_loaded: dict = {}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file is on this machine; an absolute path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteLevelIds(dict):
    """pre-token -> its ids as little-endian bytes. For byte-level vocabularies without a normalizer."""

    def __init__(self, name: str):
        super().__init__()
        self.older: dict = {}
        self.tokenizer = _tokenizer(name)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
        self.kind = "H" if self.dtype == "<u2" else "I"
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.splits = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        if self.splits:
            self.tokenizer.model._resize_cache(0)  # this table is the cache
            self.model, self.pre = self.tokenizer.model.tokenize, pre.pre_tokenize_str
            self.shown = {ord(c): self.pre(c)[0][0] for c in map(chr, range(0x250)) if c == " " or c.isalpha()}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if unit in self.older:
            ids = self.older[unit]
        else:
            if unit.isascii() and unit.isprintable():
                pieces = self.model(unit.replace(" ", self.shown[32]))
            elif unit.lstrip(" ").isalpha() and max(unit) < "\u0250":
                pieces = self.model(unit.translate(self.shown))
            else:
                pieces = [t for piece, _ in self.pre(unit) for t in self.model(piece)]
            ids = array(self.kind, [t.id for t in pieces]).tobytes()
        self[unit] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not self.splits or _ODD_SPACE(text) or any(" " in s for s in self.special):
            return np.frombuffer(self._whole(text), self.dtype)
        if len(self) > CACHE_UNITS:
            self.older = dict(self)
            self.clear()
        if any(s in text for s in self.special):  # a special string lies within a unit between white space
            parts = [self._whole(u) if any(s in u for s in self.special) else b"".join(map(self.__getitem__, _PRETOKENS(u))) for u in _UNITS(text)]
            return np.frombuffer(b"".join(parts), self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, _PRETOKENS(text))), self.dtype)


class WordPieceCounts:
    """How many pieces a text or pre-token has; ``whole``: only whole texts can be counted, as pieces may span white space."""

    def __init__(self, name: str):
        self.special: list[str] = []
        if name.endswith(".model"):
            import sentencepiece

            self.whole, processor = True, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
            self.count = lambda text: len(processor.encode(text, num_threads=1))
        else:
            tokenizer = _tokenizer(name)
            # Pieces that carry a word end, made from patterns without white space: pre-tokens can be counted alone.
            self.whole = getattr(tokenizer.model, "end_of_word_suffix", None) != "</w>"
            self.special = [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def byte_level(name: str) -> ByteLevelIds:
    """This worker's encoder; its units stay from task to task."""
    if ("ids", name) not in _loaded:
        _loaded["ids", name] = ByteLevelIds(name)
    return _loaded["ids", name]


def word_pieces(name: str) -> WordPieceCounts:
    """This worker's counter."""
    if ("counts", name) not in _loaded:
        _loaded["counts", name] = WordPieceCounts(name)
    return _loaded["counts", name]


def release() -> None:
    """Lets go of this worker's tables: for tasks of another kind that follow in the same worker."""
    _loaded.clear()
