"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share those turns' tokens. Distinct
conversations are sorted by their path, the row of their turns' digests; that order is
depth-first, so each emits only the turns beyond those it shares with the one before it.
Every node has the token ids of its turn (head, text and end each encoded by itself with
the byte-level BPE of ``bpe``, so that the loss mask falls on token edges), its place in
one stream of tokens, the position id of its first token (the number of tokens above it),
its loss span and the merged stream intervals of its ancestors, which are what it may
attend to besides itself. The same places are given in characters of the formatted text.

The sorted rows are a checkpoint, whose partitions stay as they are; the driver sees one
row a partition (the paths at its ends) to know where each partition's stream begins and
what its first conversation shares with the last of the partition before.

A turn is ``### role:``, a line feed, the text, ``</turn>`` and a line feed. In texts a
backslash goes before each backslash, ``###`` and ``</turn>``; in roles a backslash and a
line feed are written ``\\\\`` and ``\\n``.

Defined cases: a null text or role is empty; turns are in order of (turn, role, text)
with nulls first, so ties and repeated rows are turns too; a null conv_id is one
conversation; other columns are ignored; an empty table gives an empty result. A single
conversation must fit a worker.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import codec
from millrace.llm.common import keep, scratch, tune

END = "</turn>\n"
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_SCAN = re.compile(r"\\(?:\\|###|</turn>)|(</turn>\n)")
_DIGEST = 16


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text is."""
    head = "### " + role.replace("\\", "\\\\").replace("\n", "\\n") + ":\n"
    body = _ESCAPE.sub(lambda m: "\\" + m[0], text)
    return head + body + END, len(head), len(head) + len(body)


def unescape(body: str) -> str:
    return _UNESCAPE.sub(r"\1", body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        stop = formatted.index("\n", at)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[at + 4 : stop - 1])
        end = next(m for m in _SCAN.finditer(formatted, stop + 1) if m[1])
        out.append((role, unescape(formatted[stop + 1 : end.start()])))
        at = end.end()
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both paths."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + _DIGEST] == b[n : n + _DIGEST]:
        n += _DIGEST
    return n // _DIGEST


def _turn_digest(role: str, text: str) -> bytes:
    """Lengths go before what they measure, so that no two turns are written alike."""
    r, t = role.encode(), text.encode()
    return hashlib.md5(b"%d:%b%d:%b" % (len(r), r, len(t), t)).digest()


def _paths(path: str, pattern: str):
    def each(batches):
        c = codec(path, pattern)
        for b in batches:
            paths, tokens, parts = [], [], []
            for turns in b["turns"].to_pylist():
                told = [(t["role"] or "", t["text"] or "") for t in turns]
                paths.append(b"".join(_turn_digest(*t) for t in told))
                ids, cut = [], []
                for role, text in told:
                    whole, a, z = segment(role, text)
                    three = [c.encode(x) for x in (whole[:a], whole[a:z], whole[z:])]
                    ids.append(three[0] + three[1] + three[2])
                    cut += [len(three[0]), len(three[0]) + len(three[1])]
                tokens.append(ids)
                parts.append(cut)
            cols = b["conv_id"], b["turns"], pa.array(paths, pa.binary()), pa.array(tokens, pa.list_(pa.list_(pa.int32()))), pa.array(parts, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(cols), names=["conv_id", "turns", "path", "ids", "cut"])

    return each


def _lengths(turns, ids) -> list[tuple[int, int]]:
    """Characters and tokens of each turn."""
    return [(len(segment(t["role"] or "", t["text"] or "")[0]), len(i)) for t, i in zip(turns, ids)]


def _ends(batches):
    """One row: the partition's first and last path, where their turns begin and end in this partition's stream, and its length.

    Places are flat: characters from and to, tokens from and to.
    """
    first = last = None
    stack, chars, tokens = [], 0, 0
    for b in batches:
        for turns, path, ids in zip(b["turns"].to_pylist(), b["path"].to_pylist(), b["ids"].to_pylist()):
            same = _shared(last, path) if last is not None else 0
            del stack[same:]
            for n, m in _lengths(turns[same:], ids[same:]):
                stack.append((chars, chars + n, tokens, tokens + m))
                chars, tokens = chars + n, tokens + m
            if first is None:
                first, begun = path, list(stack)
            last = path
    if first is not None:
        flat = lambda x: [y for z in x for y in z]
        row = [TaskContext.get().partitionId(), first, last, flat(begun), flat(stack), chars, tokens]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "first", "last", "begun", "stack", "chars", "tokens"])


def _starts(rows) -> dict[int, tuple[tuple[int, int], bytes, list[tuple]]]:
    """By partition: its offsets in characters and tokens, the path before it, and where that path's turns lie."""
    out, at, before, stack = {}, (0, 0), b"", []
    fours = lambda x: list(zip(x[::4], x[1::4], x[2::4], x[3::4]))
    for r in sorted(rows, key=lambda r: r.part):
        same = _shared(before, bytes(r.first))
        out[r.part] = at, before[: same * _DIGEST], stack[:same]
        begun, end = fours(r.begun), fours(r.stack)
        saved = begun[same - 1][1::2] if same else (0, 0)
        inherited = min(same, _shared(bytes(r.first), bytes(r.last)))
        c, t = at[0] - saved[0], at[1] - saved[1]
        stack = stack[:inherited] + [(x[0] + c, x[1] + c, x[2] + t, x[3] + t) for x in end[inherited:]]
        at, before = (c + r.chars, t + r.tokens), bytes(r.last)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [{"from": a, "to": b} for a, b in out]


_SPANS = "array<struct<from: long, to: long>>"
_NODE = f"struct<start: long, end: long, position: long, depth: int, loss_from: int, loss_to: int, ancestors: {_SPANS}, text: string, token_start: long, token_end: long, token_position: long, token_loss_from: int, token_loss_to: int, token_ancestors: {_SPANS}, ids: array<int>>"
_ARROW_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_PLACES = [("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("depth", pa.int32()), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("ancestors", _ARROW_SPANS), ("text", pa.string())]
_TOKEN_PLACES = [("token_start", pa.int64()), ("token_end", pa.int64()), ("token_position", pa.int64()), ("token_loss_from", pa.int32()), ("token_loss_to", pa.int32()), ("token_ancestors", _ARROW_SPANS), ("ids", pa.list_(pa.int32()))]
_ARROW_NODES = pa.list_(pa.struct(_PLACES + _TOKEN_PLACES))


def _emit(starts):
    def each(batches):
        here = starts.get(TaskContext.get().partitionId())
        if here is None:
            return
        (char, token), last, stack = here[0], here[1], list(here[2])
        for b in batches:
            spans, nodes = [], []
            for turns, path, ids, cut in zip(*(b[c].to_pylist() for c in ("turns", "path", "ids", "cut"))):
                same = _shared(last, path)
                del stack[same:]
                new, position, above = [], sum(x[1] - x[0] for x in stack), sum(x[3] - x[2] for x in stack)
                for depth, t in enumerate(turns[same:], same):
                    text, a, z = segment(t["role"] or "", t["text"] or "")
                    n, m, loss = len(text), len(ids[depth]), (t["role"] or "") == LOSS_ROLE
                    masked = (a, z, *cut[2 * depth : 2 * depth + 2]) if loss else (None,) * 4
                    new.append({
                        "start": char, "end": char + n, "position": position, "depth": depth, "loss_from": masked[0], "loss_to": masked[1], "ancestors": _merged([x[:2] for x in stack]), "text": text,
                        "token_start": token, "token_end": token + m, "token_position": above, "token_loss_from": masked[2], "token_loss_to": masked[3], "token_ancestors": _merged([x[2:] for x in stack]), "ids": ids[depth],
                    })
                    stack.append((char, char + n, token, token + m))
                    char, token, position, above = char + n, token + m, position + n, above + m
                last = path
                spans.append([{"from": x[0], "to": x[1]} for x in stack])
                nodes.append(new)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(p).digest() for p in b["path"].to_pylist()], pa.binary()), pa.array(spans, _ARROW_SPANS), pa.array(nodes, _ARROW_NODES)], names=["path_id", "spans", "nodes"])

    return each


def tree(conversations: DataFrame, path: str, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, members): nodes in depth-first stream places; path_id with the spans of its turns; conv_id with its path_id.

    path, pattern: the rank file and the pattern of the tokens.
    """
    spark = tune(conversations.sparkSession)
    turn = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    convs = keep(grouped.mapInArrow(_paths(path, pattern), "conv_id long, turns array<struct<role: string, text: string>>, path binary, ids array<array<int>>, cut array<int>"))
    members = convs.select("conv_id", F.unhex(F.md5("path")).alias("path_id"))
    distinct = convs.groupBy("path").agg(F.first(F.struct("turns", "ids", "cut")).alias("x")).select("x.*", "path")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").checkpoint()
    places = "part long, first binary, last binary, begun array<long>, stack array<long>, chars long, tokens long"
    starts = _starts(ordered.mapInArrow(_ends, places).collect())
    out = keep(ordered.mapInArrow(_emit(starts), f"path_id binary, spans {_SPANS}, nodes array<{_NODE}>"))
    return out.select(F.explode("nodes").alias("n")).select("n.*"), out.select("path_id", "spans"), members


def _read(batches):
    for b in batches:
        out = []
        for path_id, turns in zip(b["path_id"].to_pylist(), b["turns"].to_pylist()):
            turns.sort(key=lambda t: t["depth"])
            formatted = "".join(t["text"] for t in turns)
            parsed = parse(formatted)
            loss = "".join(unescape(t["text"][t["loss_from"] : t["loss_to"]]) for t in turns if t["loss_from"] is not None)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parsed).encode()).hexdigest()
            out.append((path_id, len(parsed), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        cols = list(zip(*out)) or [()] * 6
        kinds = pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(nodes: DataFrame, paths: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation's digests, put together from the nodes that its path's spans name."""
    steps = paths.select("path_id", F.explode("spans").alias("s")).select("path_id", F.col("s.from").alias("start"))
    turns = steps.join(nodes.select("start", "depth", "text", "loss_from", "loss_to"), "start")
    turns = turns.groupBy("path_id").agg(F.collect_list(F.struct("depth", "text", "loss_from", "loss_to")).alias("turns"))
    read = keep(turns.mapInArrow(_read, "path_id binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
    return members.join(read, "path_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
