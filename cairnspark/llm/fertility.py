"""Quality rules (1): tokeniser fertility with rejection bands per language or script."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, map_arrow, stored
from cairnspark.llm.encoders import vocabulary_path

#: A word ends at one of these.
SPACES = " \t\n\x0b\x0c\r"
_SYMBOL_SET = "#*$%&|<>"
METRICS = ("chars_per_token", "byte_share", "token_entropy")
_SCHEMA = "doc_id long, group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_pieces long, chars_per_token double, byte_share double, token_entropy double"

_processors: dict = {}


def _processor(name: str):
    if name not in _processors:
        import sentencepiece

        _processors[name] = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
    return _processors[name]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


@lru_cache(1 << 16)
def _script(character: str) -> str:
    return unicodedata.name(character, "OTHER").split()[0].lower()


def script_of(text: str) -> str:
    """The script of most of the letters of the whole text, by their Unicode names."""
    names: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            names[_script(c)] += n
    return min(names, key=lambda k: (-names[k], k)) if names else "none"


def measures(text: str, processor, first_byte: int, last_byte: int) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_pieces and the three metrics."""
    words = text.translate(_TO_SPACE).split(" ") if any(s in text for s in SPACES[1:]) else text.split(" ")
    words = [w for w in words if w]
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(SPACES):
            seen.add(line)
    ids = processor.encode(text, num_threads=1)
    n = len(ids)
    counts = Counter(ids)
    chars = sum(map(len, words))
    entropy = math.log2(n) - sum(k * math.log2(k) for k in counts.values()) / n if n else 0.0
    shares = sum(k for i, k in counts.items() if first_byte <= i <= last_byte) / n if n else 0.0
    return len(words), chars, sum(map(text.count, _SYMBOL_SET)), duplicates, repeated_words(words), n, chars / n if n else 0.0, shares, entropy


_TO_SPACE = str.maketrans(dict.fromkeys(SPACES, " "))


def fertility(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", min_words: int = 50, spread: float = 6.0) -> DataFrame:
    """Base counts and tokeniser fertility for every whole text, and whether a document is kept.

    Per document: characters per token, share of byte-fallback tokens, token entropy (bits) under a
    public vocabulary. The bands come from all documents of the same language (script where the
    language is null) that pass the base rules: quartiles, widened by ``spread`` times the quartile
    distance and by a twentieth of the quartile. Characters per token is rejected on either side,
    byte share above, and entropy below (entropy grows with length, so a long text isn't rejected).
    base_failed: fewer than ``min_words`` words, or more than half of them in repeated 3-word windows.

    Null and empty texts have no words and fail the base rules. Repeated rows count each; null ids
    stay; other columns are ignored; an empty table gives no rows.
    """

    def measure(batches):
        processor = _processor(vocabulary)
        first, last = processor.piece_to_id("<0x00>"), processor.piece_to_id("<0xFF>")
        for batch in by_bytes(batches, 1):
            out = []
            for doc_id, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                out.append((doc_id, lang if lang is not None else "script:" + script_of(text), *measures(text, processor, first, last)))
            columns = list(zip(*out, strict=True)) or [[] for _ in range(11)]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.cast("string").alias("lang")).transform(map_arrow, measure, _SCHEMA), "fertility")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quartiles = rows.where(~failed).groupBy("group").agg(*(F.percentile_approx(m, [0.25, 0.75], 10_000).alias(f"q_{m}") for m in METRICS))
    bands = []
    for m in METRICS:
        low, high = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        bands += [(low - spread * (high - low) - low / 20).alias(f"low_{m}"), (high + spread * (high - low) + high / 20).alias(f"high_{m}")]
    judged = rows.join(stored(quartiles.select("group", *bands), "fertility-bands"), "group", "left")
    inside = (
        F.col("chars_per_token").between(F.col("low_chars_per_token"), F.col("high_chars_per_token"))
        & (F.col("byte_share") <= F.greatest(F.col("high_byte_share"), F.lit(0.02)))
        & (F.col("token_entropy") >= F.col("low_token_entropy"))
    )
    base = failed.alias("base_failed")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "n_pieces", *METRICS)
