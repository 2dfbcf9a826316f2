"""Quality rules: repetition counts, and the fertility of public tokenisers.

Fertility of a text under each of two vocabularies (a piece model with byte fallback and
a byte-level BPE for many languages), each word encoded by itself as after a space:
characters of words per token, the share of tokens that are single bytes the vocabulary
fell back to, and the entropy of the tokens in bits. A text whose measures leave the band
of its language (``lang``) is rejected; one of no or another language has the band of its
script: ``Latn`` where most characters of its words are Latin letters, or the widest
(None). Bands are of fixed numbers and don't depend on the data at hand. A text of n tokens
may lie below a band's floor by its slack / sqrt(n), so that few tokens, which tell
little, reject little, without a length from which the rule holds.

Defined cases: null or empty text has no words and fails the base rules; a null language
has the band of its script; repeated rows give repeated rows; other columns don't matter;
an empty table gives an empty result. The vocabularies must be at the same path on every
machine. A single text must fit a worker.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import read_ranks
from millrace.llm.common import Scan, grams, mix, pieces, sole, tune


class Band(NamedTuple):
    """Floors as (floor, slack) of characters a token and entropy under either vocabulary, and the most byte fallback."""

    piece_chars: tuple[float, float]
    byte_chars: tuple[float, float]
    piece_bits: tuple[float, float]
    byte_bits: tuple[float, float]
    fallback: float


#: Fitted once on the labelled documents of sf0.1 with quality 1 that pass the base rules (en 2013, de 488, fr 490, es
#: 311: this sample is the bound). Floors of characters are medians less 0.02, the least of the four languages', as texts
#: mix them; floors of entropy are about that of long texts. A slack is the 99.9th percentile of what texts of n tokens
#: lack, times sqrt(n), and a tenth more.
BANDS = {
    "en": Band((1.92, 4.7), (2.01, 2.9), (6.7, 13.7), (6.6, 12.4), 0.20),
    "de": Band((1.92, 4.7), (2.01, 2.9), (6.7, 13.6), (6.6, 12.3), 0.25),
    "fr": Band((1.92, 4.7), (2.01, 2.9), (6.7, 14.9), (6.6, 12.5), 0.25),
    "es": Band((1.92, 4.7), (2.01, 2.9), (6.7, 14.9), (6.6, 13.2), 0.25),
    "Latn": Band((1.6, 5.0), (1.6, 5.0), (6.0, 20.0), (6.0, 20.0), 0.35),
    None: Band((0.6, 5.0), (0.3, 5.0), (5.0, 20.0), (5.0, 20.0), 0.60),
}
MEMO_WORDS, MEMO_BYTES = 250_000, 64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LATIN = np.zeros(256, bool)  # ASCII letters, and the lead bytes of U+00C0 to U+024F
_LATIN[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = True
_BLANK = " \t\n\v\f\r"


class Vocabularies:
    """The ids of words under both vocabularies, memoised as bytes: piece ids, then byte ids from ``first`` on."""

    def __init__(self, piece: str, ranks: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece)
        self.byte = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        self.first = self.piece.vocab_size()
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.first)])
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """By text of these words: all ids."""
        if len(self.memo) > MEMO_WORDS:  # words of the last generation that come again are kept
            self.memo, self.old = {}, self.memo
        memo, brief = self.memo, {}
        new = {w for words in texts for w in words if w not in memo}
        for w in [w for w in new if w in self.old]:
            memo[w] = self.old[w]
            new.discard(w)
        new = list(new)
        names = [w.decode() for w in new]
        for w, name, ids in zip(new, names, self.piece.encode(names)):
            more = self.byte.encode_ordinary(" " + name)
            got = np.array(ids, np.uint32).tobytes() + (np.array(more, np.uint32) + np.uint32(self.first)).tobytes()
            (memo if len(w) <= MEMO_BYTES else brief)[w] = got
        known = memo | brief if brief else memo
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32) for words in texts]


_models: dict[tuple, Vocabularies] = {}


def model(*paths: str) -> Vocabularies:
    sole("quality", _models.clear)
    if paths not in _models:
        gc.set_threshold(500_000, 50, 50)
        _models[paths] = Vocabularies(*paths)
    return _models[paths]


class Fertility(NamedTuple):
    n_tokens: int
    chars_per_token: float
    fallback_share: float
    token_entropy: float
    byte_tokens: int
    chars_per_byte_token: float
    byte_token_entropy: float


def fertility(ids: np.ndarray, known: Vocabularies, chars: int) -> Fertility:
    """What the ids of a text with so many characters in words measure; all 0 without tokens."""
    value, count = np.unique(ids, return_counts=True)
    cut = int(np.searchsorted(value, known.first))
    out = []
    for c in (count[:cut], count[cut:]):
        n = int(c.sum())
        share = c / max(n, 1)
        out.append((n, chars / n if n else 0.0, float(-(share * np.log2(share)).sum()) if n else 0.0))
    (n, per, bits), (m, per_byte, byte_bits) = out
    fell = float(count[:cut][known.is_byte[value[:cut]]].sum() / n) if n else 0.0
    return Fertility(n, per, fell, bits, m, per_byte, byte_bits)


def within(lang: str | None, latin: bool, m: Fertility) -> bool:
    """Whether the measures lie in the band of the language, or else of the script."""
    band = BANDS.get(lang) if lang in BANDS and lang is not None else BANDS["Latn" if latin else None]
    if not m.n_tokens:
        return True
    for got, n, (floor, slack) in ((m.chars_per_token, m.n_tokens, band.piece_chars), (m.chars_per_byte_token, m.byte_tokens, band.byte_chars), (m.token_entropy, m.n_tokens, band.piece_bits), (m.byte_token_entropy, m.byte_tokens, band.byte_bits)):
        if got < floor - slack / n**0.5:
            return False
    return m.fallback_share <= band.fallback


def repeated(scan: Scan, window: int = 8) -> np.ndarray:
    """By text, the words in windows found twice or more in it."""
    n = len(scan.starts)
    cover = np.zeros(n + 1, np.int64)
    at = np.arange(max(0, n - window + 1))
    at = at[scan.doc[at] == scan.doc[at + window - 1]] if len(at) else at
    if len(at):
        key = mix(grams(scan.hashes(), window)[at] ^ mix(scan.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover[at[twice]] += 1
        np.subtract.at(cover, at[twice] + window, 1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:n] > 0)))
    return inside[scan.first[1:]] - inside[scan.first[:-1]]


def _sums(scan: Scan, flag: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[scan.off[1:]] - total[scan.off[:-1]]


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, byte_tokens long, chars_per_byte_token double, byte_token_entropy double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _measure(paths: tuple[str, str, str]):
    def each(batches: Iterable[pa.RecordBatch]):
        known = model(*paths)
        for batch in batches:
            for b in pieces(batch, "text"):
                scan = Scan(b["text"])
                texts = [t or "" for t in b["text"].to_pylist()]
                word = ~scan.space
                chars = _sums(scan, word & ((scan.bytes & 0xC0) != 0x80))
                latin = 2 * _sums(scan, _LATIN[scan.bytes]) >= chars
                cols = [b["doc_id"], scan.n_words, chars, _sums(scan, _SYMBOL[scan.bytes]), [dup_lines(t) for t in texts], repeated(scan)]
                failed = (scan.n_words < 20) | (100 * cols[5] > 30 * scan.n_words)
                ids = known.ids([t.encode().split() for t in texts])
                measures = [fertility(x, known, c) for x, c in zip(ids, chars.tolist())]
                good = np.array([within(*x) for x in zip(b["lang"].to_pylist(), latin.tolist(), measures)], bool)
                cols += [failed, ~failed & good, *(list(x) for x in zip(*measures))]
                yield pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in cols], names=_NAMES)

    return each


def rules(docs: DataFrame, piece: str, ranks: str, pattern: str) -> DataFrame:
    """One row a document: the counts, base_failed, kept, and what fertility measured.

    The vocabularies: a sentencepiece model, and a rank file with the pattern that goes with it.
    """
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(_measure((piece, ranks, pattern)), _SCHEMA)


def filtered(docs: DataFrame, piece: str, ranks: str, pattern: str) -> DataFrame:
    """The documents kept, with all their columns, in one pass over the texts."""
    names = docs.columns
    measure = _measure((piece, ranks, pattern))

    def each(batches):
        for batch in batches:
            got = list(measure([batch.select(["doc_id", "text", "lang"])]))
            if got:
                yield batch.filter(pa.concat_arrays([g["kept"] for g in got]))

    tune(docs.sparkSession)
    return docs.select(*names).mapInArrow(each, docs.schema)
