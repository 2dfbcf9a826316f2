"""Substring dedup with sharded repeated-phrase automata.

A window is 13 consecutive words of one text. A word goes if a window over it also
starts in a document with a smaller doc_id. Texts are dealt to shards of about 2 MB;
the number of shards follows the corpus.

1. Anchors: every window has the smallest hash of its 6-word grams as anchor, so equal
   windows have equal anchors; about a fifth of the windows' number is sent, each
   shard sends each once. Anchors seen in two shards, or in two documents of one,
   mark candidate windows; nothing else can recur.
2. Confirming: candidates' 128-bit window hashes (two of 64 bits from independent hashes of
   the words) with the smallest doc_id of their shard meet by hash range; each shard learns
   of smaller doc_ids elsewhere.
3. Each shard compiles the anchors of its recurring windows (6 words each, every word a few
   characters) into an Aho-Corasick automaton and streams its texts through it. Where an anchor
   is found, the windows around it are looked up whole, word by word, among the recurring
   ones, which finds every occurrence. A passage that thousands of texts share is one row a
   shard throughout.

Hash ranges are as many as hold ``RANGE_BYTES`` of anchors, so a shard's row for a range
grows with the corpus until it is full, and rows grow with the anchors, not with the square of
the shards.

Defined cases: null text has no words; a text shorter than a window loses nothing; rows
that repeat a doc_id are the same document for "smaller"; a null doc_id is larger than
any other and null rows don't remove each other; other columns don't matter; an empty
table gives an empty result. A single text must fit a worker (about 40 times its size).
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scan, drop, fresh, grams, keep, sole, tune

WINDOW, GRAM = 13, 6
SHARD_BYTES, LEAST_SHARDS = 2 << 20, 64
RANGE_BYTES, ANCHOR_SHARE = 16 << 20, 0.3  # anchors are about this share of the texts' bytes
BRANCHES = 192
NULL_ID = np.int64((1 << 63) - 1)
_ROWS = "to int, shard int, body binary"
_OUT = "doc_id long, n_words long, n_removed long, kept string"


def _windows(table: pa.Table, window: int):
    """Texts' words, the first word of every window, its 64-bit hash and its document's id."""
    sole("substring", lambda: None)
    scan = Scan(table["text"])
    words = scan.hashes()
    at = np.arange(max(0, len(words) - window + 1))
    at = at[scan.doc[at] == scan.doc[at + window - 1]] if len(at) else at
    ids = table["doc_id"].fill_null(int(NULL_ID)).to_numpy()
    return scan, words, at, ids[scan.doc[at]] if len(at) else np.zeros(0, np.int64)


def _anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, and the word of the window with which it begins (the first of equal ones)."""
    low = grams(words, gram)
    n = max(0, len(words) - window + 1)
    out, at = low[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - gram + 1):
        less = low[j : j + n] < out
        out[less] = low[j : j + n][less]
        at[less] = j
    return mix_high(out), at


def mix_high(x: np.ndarray) -> np.ndarray:
    """Minima are small numbers; a multiplication spreads them over the buckets again."""
    return x * np.uint64(0xD1342543DE82EF95)


def _groups(h: np.ndarray, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (h, g) are together, and where each group begins in it."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    if g is not None:
        other = np.zeros(len(h), bool)
        other[1:] = g[order[1:]] != g[order[:-1]]
        if (other & ~new).any():  # two windows with the same 64 bits
            order = np.lexsort((g, h))
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    return order, np.flatnonzero(new)


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted keys that occur with more than one doc."""
    order, heads = _groups(key)
    if not len(heads):
        return key
    d = doc[order]
    return key[order[heads]][np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)]


def _among(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _dealt(key: np.ndarray, rows: np.ndarray, n: int, shard: int) -> pa.Table:
    """One row for each of n ranges of the sorted keys that has any."""
    to = ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    ends = np.append(cut[1:], len(to))
    body = [rows[a:b].tobytes() for a, b in zip(cut, ends)]
    return pa.table({"to": pa.array(to[cut], pa.int32()), "shard": pa.array(np.full(len(cut), shard), pa.int32()), "body": pa.array(body, pa.binary())})


def _empty(schema) -> pa.Table:
    return pa.schema(schema).empty_table()


_SCHEMA = [("to", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())]
_CANDIDATE = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8")])


def _send_anchors(ranges: int, window: int, gram: int):
    def each(table: pa.Table) -> pa.Table:
        _, words, at, _ = _windows(table, window)
        if not len(at):
            return _empty(_SCHEMA)
        unique = np.unique(_anchors(words, window, gram)[0][at])
        return _dealt(unique, unique, ranges, table["shard"][0].as_py())

    return each


def _meet_anchors(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, np.uint64) for b in table["body"].to_pylist()]
    all_, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = all_[counts > 1]
    got = [(s, p[_among(p, shared)]) for s, p in zip(table["shard"].to_pylist(), parts)]
    got = [(s, p) for s, p in got if len(p)]
    return pa.table({"to": pa.array([table["to"][0].as_py()] * len(got), pa.int32()), "shard": pa.array([s for s, _ in got], pa.int32()), "body": pa.array([p.tobytes() for _, p in got], pa.binary())})


def _second(scan: Scan, window: int) -> np.ndarray:
    """The other 64 bits of each window's hash."""
    return grams(scan.hashes(1), window, 0x9E6C63D0876A9A99)


def _send_candidates(ranges: int, window: int, gram: int):
    def each(docs: pa.Table, shared: pa.Table) -> pa.Table:
        scan, words, at, ids = _windows(docs, window)
        if not len(at):
            return _empty(_SCHEMA)
        anchor = _anchors(words, window, gram)[0][at]
        told = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in shared["body"].to_pylist()] or [np.zeros(0, np.uint64)]))
        hit = _among(anchor, told) | _among(anchor, _several(anchor, ids))
        at, ids = at[hit], ids[hit]
        rows = _lowest(grams(words, window)[at], _second(scan, window)[at], ids)
        return _dealt(rows["h"], rows, ranges, docs["shard"][0].as_py())

    return each


def _lowest(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """By window, a row with the smallest doc, sorted by window."""
    order, heads = _groups(h, g)
    rows = np.empty(len(heads), _CANDIDATE)
    if len(heads):
        rows["h"], rows["g"], rows["doc"] = h[order[heads]], g[order[heads]], np.minimum.reduceat(doc[order], heads)
    return rows


def _meet_candidates(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, _CANDIDATE) for b in table["body"].to_pylist()]
    rows = np.concatenate(parts)
    shard = np.repeat(np.array(table["shard"].to_pylist(), np.int32), [len(p) for p in parts])
    order, heads = _groups(rows["h"].copy(), rows["g"].copy())
    rows, shard = rows[order], shard[order]
    low = np.repeat(np.minimum.reduceat(rows["doc"].copy(), heads), np.diff(heads, append=len(rows)))
    use = np.flatnonzero(low < rows["doc"])
    rows["doc"][use] = low[use]
    use = use[np.argsort(shard[use], kind="stable")]
    cut = np.flatnonzero(np.diff(shard[use], prepend=-1))
    ends = np.append(cut[1:], len(use))
    return pa.table({"to": pa.array([table["to"][0].as_py()] * len(cut), pa.int32()), "shard": pa.array(shard[use][cut], pa.int32()), "body": pa.array([rows[use[a:b]].tobytes() for a, b in zip(cut, ends)], pa.binary())})


_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def joined(text: bytes) -> bytes:
    """The words joined by one space."""
    out = text.translate(_BLANKS).strip(b" ")
    return out if b"  " not in out else b" ".join(out.split())


def codes(words: dict[bytes, str]) -> int:
    """Gives each word as many characters as all need, each place with its own; returns how many.

    A node's branches are searched one by one, so a place has at most BRANCHES characters,
    and places share none, so that no match begins within a word. Fewer characters a word
    make fewer nodes.
    """
    width = 1
    while BRANCHES**width < len(words):
        width += 1
    base = max(2, math.ceil(len(words) ** (1 / width)))
    while base**width < len(words):  # the root was rounded down
        base += 1
    for n, w in enumerate(words):
        words[w] = "".join([chr(1 + base * k + n // base**k % base) for k in range(width)])
    return width


def automaton(phrases) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton over strings of word codes."""
    out = ahocorasick.Automaton()
    for phrase in phrases:
        out.add_word(phrase, None)
    out.make_automaton()
    return out


def _locate(window: int, gram: int):
    def each(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        scan, words, at, ids = _windows(docs, window)
        h, g = (grams(words, window)[at], _second(scan, window)[at]) if len(at) else (np.zeros(0, np.uint64),) * 2
        own, heads = _groups(h, g)
        h, g = h[own[heads]], g[own[heads]]
        low, high = (f.reduceat(ids[own], heads) for f in (np.minimum, np.maximum)) if len(at) else (ids, ids)
        there = np.concatenate([np.frombuffer(b, _CANDIDATE) for b in told["body"].to_pylist()] or [np.zeros(0, _CANDIDATE)])
        there = there[np.argsort(there["h"])]
        if len(there):
            there_h, there_g = there["h"].copy(), there["g"].copy()
            spot = np.searchsorted(there_h, h)
            live = np.flatnonzero(spot < len(there))
            while len(live := live[there_h[spot[live]] == h[live]]):  # windows with the same first 64 bits stand side by side
                fits = live[there_g[spot[live]] == g[live]]
                low[fits] = np.minimum(low[fits], there["doc"][spot[fits]])
                spot[live] += 1
                live = live[spot[live] < len(there)]
        use = low < high
        first, value = at[own][heads[use]], low[use]
        hit = np.repeat(np.where(use, low, NULL_ID), np.diff(heads, append=len(own))) < ids[own]
        stream = set(scan.doc[at[own[hit]]].tolist())
        texts = docs["text"]
        code: dict[bytes, str] = {}
        if len(first):
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, first, 1)
            np.subtract.at(covered, first + window, 1)
            covered = np.cumsum(covered)[: len(words)] > 0
            homes = {}  # the texts that hold the phrases, cut into words
            for d in np.unique(scan.doc[first]).tolist():
                homes[d] = homed = (texts[d].as_py() or "").encode().split(), covered[scan.first[d] : scan.first[d + 1]].tolist()
                code.update(dict.fromkeys(compress(*homed), ""))
            width = codes(code)
            coded = {d: "".join([code[w] if c else "\0" * width for w, c in zip(*home)]) for d, home in homes.items()}
            begin, home = first - scan.first[scan.doc[first]], scan.doc[first].tolist()
            anchor = begin + _anchors(words, window, gram)[1][first]
            known = {coded[d][i * width : (i + window) * width]: v for d, i, v in zip(home, begin.tolist(), value.tolist())}
            found = automaton({coded[d][i * width : (i + gram) * width] for d, i in zip(home, anchor.tolist())})
            del homes, coded
        out = []
        for d, doc_id in enumerate(docs["doc_id"].to_pylist()):
            text, n = (texts[d].as_py() or "").encode(), int(scan.n_words[d])
            if d not in stream:  # none of its windows is among the recurring ones
                out.append((doc_id, n, 0, joined(text).decode()))
                continue
            parts, gone, me = text.split(), 0, int(NULL_ID) if doc_id is None else doc_id
            unknown, until, keep_, seen = "\0" * width, 0, [], 0
            coded = "".join([code.get(w, unknown) for w in parts])
            for last, _ in found.iter(coded):
                start = (last + 1) // width - gram
                for begin in range(max(seen, start - window + gram), min(start, n - window) + 1):
                    if known.get(coded[begin * width : (begin + window) * width], me) < me:
                        if begin > until:
                            keep_.append((until, begin))
                        gone += begin + window - max(begin, until)
                        until = begin + window
                seen = start + 1
            if gone:
                keep_.append((until, n))
                parts = [w for a, b in keep_ for w in parts[a:b]]
            out.append((doc_id, n, gone, b" ".join(parts).decode()))
        cols = list(zip(*out))
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.string())})

    return each


def _digests(locate):
    def each(docs: pa.Table, told: pa.Table) -> pa.Table:
        table = locate(docs, told)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in table["kept"].to_pylist()]
        return table.select(["doc_id", "n_words", "n_removed"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return each


def _rewrite(locate, shard: str):
    """The table with its texts as kept; texts that lose nothing stay as they were."""

    def each(docs: pa.Table, told: pa.Table) -> pa.Table:
        out = docs.drop_columns([shard])
        got = locate(out.select(["doc_id", "text"]).append_column("shard", docs[shard]), told)
        text = pc.if_else(pc.greater(got["n_removed"], 0), got["kept"], docs["text"].combine_chunks())
        out = out.set_column(out.column_names.index("text"), "text", text)
        return out.set_column(out.column_names.index("n_chars"), "n_chars", pc.utf8_length(text).cast(pa.int64())) if "n_chars" in out.column_names else out

    return each


def _located(docs: DataFrame, window: int, gram: int):
    """The documents with their shards (a further column, whose name is the second value), and what each shard is told of others."""
    tune(docs.sparkSession)
    (name,) = fresh(docs.columns, "shard")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    ranges = max(LEAST_SHARDS, int(size * ANCHOR_SHARE) // RANGE_BYTES)
    docs = docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    texts = docs.select("doc_id", "text", F.col(name).alias("shard"))
    anchors = texts.groupBy("shard").applyInArrow(_send_anchors(ranges, window, gram), _ROWS)
    shared = keep(anchors.groupBy("to").applyInArrow(_meet_anchors, _ROWS))
    candidates = texts.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_send_candidates(ranges, window, gram), _ROWS)
    told = keep(candidates.groupBy("to").applyInArrow(_meet_candidates, _ROWS))
    drop(shared)
    return docs, name, told


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the kept words joined by one space, or kept_sha256 its digest."""
    docs, shard, told = _located(docs.select("doc_id", "text"), window, gram)
    pairs = docs.groupBy(shard).cogroup(told.groupBy("shard"))
    if digests:
        return pairs.applyInArrow(_digests(_locate(window, gram)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return pairs.applyInArrow(_locate(window, gram), _OUT)


def rewritten(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents with all their columns, removed words gone; a column n_chars follows the text."""
    names = docs.columns
    docs, shard, told = _located(docs, window, gram)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.drop(shard).dtypes)
    return docs.groupBy(shard).cogroup(told.groupBy("shard")).applyInArrow(_rewrite(_locate(window, gram), shard), schema).select(*names)
