"""Exact byte-level BPE by backtracking over the vocabulary in pyahocorasick.

The vocabulary's byte strings, one Latin-1 character a byte, go into a pyahocorasick
trie that gives the longest token from a position of a piece. Encoding takes that
token, checks that it may stand beside the one before it (two tokens may,
if merging their joined bytes gives these two back; memoised by pair), tries its next
shorter prefix token if not, and steps back one token when none fits. Every position is
given up at most once, so time is linear in the piece. Pieces are the pattern's matches,
each encoded separately, without special tokens; short words are memoised with what they
decode to.

Defined cases: null text is empty; no ids join to the empty string; other columns don't
matter; repeated rows give repeated rows; an empty table gives an empty result. The
vocabulary file must be at the same path on every machine.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import sole, tune

MEMO_WORDS, MEMO_CHARS, MEMO_PAIRS = 250_000, 48, 500_000
_NONE = 1 << 40
#: Fixed value: the pattern under which a match holds a space only at its beginning or in a run of white space, and takes a whole run of letters.
CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_GAP, _CUT = re.compile(r"\s ").search, re.compile(r"(?<=\S)(?= )").split


class _Halves(dict):
    """Ids of parts of pieces."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, chars: str):
        got = self.codec.merged(chars)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[chars] = got
        return got


_TAILED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)").fullmatch


class _Memo(dict):
    """What ``make`` gives of the ids of a word after ``before``, a space or nothing.

    Letters and then ASCII punctuation are two pieces, and words around a line feed three, of which most have been seen:
    what they gave is put together by ``add``. When the memo is full, the words of the last generation that come again are kept.
    """

    def __init__(self, codec: Codec, before: str, make, add, bare: _Memo | None = None):
        self.codec, self.before, self.make, self.add, self.bare, self.old = codec, before, make, add, self if bare is None else bare, {}

    def _new(self, word: str):
        parts = _TAILED(word)
        if parts and max(parts[1]) < "\u0250":
            return self.add(self[parts[1]], self.bare[parts[2]])
        if word.count("\n") == 1:
            one, two = word.split("\n")
            if one and two and not one[-1].isspace() and not two[0].isspace():
                return self.add(self.add(self[one], self.bare["\n"]), self.bare[two])
        return self.make(self.codec.chunk(self.before + word))

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self._new(word)
            if len(word) > MEMO_CHARS:
                return got
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


def _tell_both(a: tuple[int, str, bytes], b: tuple[int, str, bytes]) -> tuple[int, str, bytes]:
    return a[0] + b[0], f"{a[1]} {b[1]}", a[2] + b[2]


class Codec:
    """Encoder and decoder of one rank file. Only under ``CUT_AT_SPACES`` are texts cut at spaces before the pattern sees them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.at_spaces = regex.compile(pattern).findall, pattern == CUT_AT_SPACES
        self.token = {i: t for t, i in ranks.items()}
        self.name = {i: str(i) for i in self.token}
        self.length = {i: len(t) for i, t in self.token.items()}
        self.ranks, self.pairs_ok = ranks, {}
        self.bare_memo = _Memo(self, "", tuple, tuple.__add__)
        self.memo = _Memo(self, " ", tuple, tuple.__add__, self.bare_memo)
        self.bare_told = _Memo(self, "", self._told, _tell_both)
        self.told = _Memo(self, " ", self._told, _tell_both, self.bare_told)
        self.halves = _Halves(self)
        self.latin = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.shorter: dict[int, int | None] = {}
        self.made: dict[str, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.most = max(map(len, ranks))
        made = lambda i: self.length[i] == 1 or self.parts[i] != (i, i)
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[i] = (i, i)
            if len(t) > 1:
                # The last merge that makes the token joins the two tokens into which lower ranks encode it.
                for n in range(1, len(t)):
                    a, b = ranks.get(t[:n], _NONE), ranks.get(t[n:], _NONE)
                    if a < i and b < i and (a, b) not in self.merge and made(a) and made(b) and self.beside(a, b):
                        self.parts[i] = (a, b)
                        self.merge[a, b] = i
                        break
        self.pairs_ok.clear()
        machine = ahocorasick.Automaton()
        for t, i in ranks.items():  # a token that no merges make stands for a whole piece only
            if made(i):
                machine.add_word(t.decode("latin-1"), i)
                self.made[t.decode("latin-1")] = i
        for chars, i in self.made.items():
            self.shorter[i] = next((self.made[chars[:n]] for n in range(len(chars) - 1, 0, -1) if chars[:n] in self.made), None)
        self.machine = machine

    def beside(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their joined bytes."""
        limit, parts, merge = _NONE, self.parts, self.merge
        while True:
            if merge.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        return True

    def longest(self, chars: str) -> int:
        """The longest token that the characters begin with: the trie says how far any key goes along."""
        ranks, n = self.made, self.machine.longest_prefix(chars)
        while True:
            got = ranks.get(chars[:n])
            if got is not None:
                return got
            n -= 1

    def joined(self, chars: str) -> list[int]:
        """The ids of a piece as Latin-1. A piece that is in the ranks is one token, whether or not merges make it."""
        whole = self.latin.get(chars)
        return [whole] if whole is not None else self.merged(chars)

    def merged(self, chars: str) -> list[int]:
        """What merges make of the characters: two memoised halves, if their tokens beside the cut are compatible."""
        whole = self.made.get(chars)
        if whole is not None:
            return [whole]
        n = len(chars)
        if 7 < n <= MEMO_CHARS:
            halves, seen = self.halves, self.pairs_ok
            for cut in (n >> 1, (n >> 1) + 1, (n >> 1) - 1):
                a, b = halves[chars[:cut]], halves[chars[cut:]]
                pair = a[-1] << 32 | b[0]
                fits = seen.get(pair)
                if fits is None:
                    fits = seen[pair] = self.beside(a[-1], b[0])
                if fits:
                    return a + b
        return self.piece(chars)

    def piece(self, chars: str) -> list[int]:
        """The ids of one match of the pattern, which must not be empty, as Latin-1."""
        n = len(chars)
        length, shorter, seen, most = self.length, self.shorter, self.pairs_ok, self.most
        if len(seen) > MEMO_PAIRS:
            seen.clear()
        shut: set[int] = set()
        out, at, last = [], 0, -1
        token = self.longest(chars[:most])
        while True:
            end = at + length[token]
            if end not in shut:
                fits = last < 0 or seen.get(last << 32 | token)
                if fits is None:
                    fits = seen[last << 32 | token] = self.beside(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last = end, token
                    token = self.longest(chars[at : at + most])
                    continue
            token = shorter[token]
            while token is None:  # nothing fits here: never come back, and shorten the token before
                shut.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def chunk(self, text: str) -> list[int]:
        pieces = (text,) if text[1:].isalpha() and text[0] == " " and max(text) < "\u0250" else self.split(text)
        if len(pieces) == 1 and text.isascii():
            return self.joined(text)
        out = []
        for p in pieces:
            out += self.joined(p if p.isascii() else p.encode().decode("latin-1"))
        return out

    def words(self, text: str) -> list[str]:
        """The text cut before each space that follows anything but white space, where a piece always ends."""
        return text.split(" ") if _GAP(text) is None else [w if k == 0 else w[1:] for k, w in enumerate(_CUT(text))]

    def encode(self, text: str) -> list[int]:
        if not self.at_spaces:
            return list(chain.from_iterable([self.joined(p.encode().decode("latin-1")) for p in self.split(text)]))
        head, *rest = self.words(text)
        return list(chain(self.bare_memo[head], *map(self.memo.__getitem__, rest)))

    def _told(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), " ".join(map(self.name.__getitem__, ids)), self.decode(ids)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the digests of the decimal ids and of the bytes that they decode to."""
        if not self.at_spaces:
            ids = self.encode(text)
            return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()
        head, *rest = self.words(text)
        known = [self.bare_told[head], *map(self.told.__getitem__, rest)]
        names = " ".join([x[1] for x in known if x[0]])
        back = b"".join([x[2] for x in known])
        return sum([x[0] for x in known]), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once a process, until another operator takes the worker."""
    sole("bpe", _codecs.clear)
    if (path, pattern) not in _codecs:
        gc.set_threshold(500_000, 50, 50)  # the memos hold no cycles, and walking them takes time
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every text and the bytes they decode to."""

    def each(batches):
        c = codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids = [c.encode(t or "") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): round-trip digests of every text."""

    def each(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids, back = zip(*[c.digests(t or "") for t in b["text"].to_pylist()]) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
