"""Text expressions: tokens, lines, matches, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """ASCII words (a letter, then letters and apostrophes) in upper case. Only a-z are folded, once over the text: ``upper`` would make ASCII letters of others."""
    return F.regexp_extract_all(F.translate(text, _LOWER, _LOWER.upper()), F.lit("[A-Z][A-Z']*"), 0)


def inner_lines(text: Column | str) -> Column:
    """Lines between line feeds: what precedes the first and follows the last belongs to other ranges. Empty ones go."""
    parts = F.split(text, "\n", -1)
    return F.filter(F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>")), lambda x: x != "")


def matches(text: Column | str, pattern: str, groups: int = 0) -> Column:
    """All matches; with ``groups`` also every captured group."""
    out = [F.regexp_extract_all(text, F.lit(pattern), i) for i in range(groups + 1)]
    return F.concat(*out) if groups else out[0]


def literal_matches(text: Column | str, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal string."""
    text = F.col(text) if isinstance(text, str) else text
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def literal_found(text: Column | str, needle: str) -> Column:
    """The non-overlapping occurrences of a literal string, one element each."""
    return F.array_repeat(F.lit(needle), literal_matches(text, needle).cast("int"))


#: From so many entries on, ``score`` is too slow: use ``token_scores``.
MOST_ENTRIES = 64


def score(text: Column | str, lexicon: dict[str, int]) -> Column:
    """Sum of the scores of tokens cut at tabs and blanks, case-sensitive; entries with blanks never match. For a few entries: they are tried one by one."""
    if len(lexicon) > MOST_ENTRIES:
        raise ValueError(f"over {MOST_ENTRIES} entries: use token_scores")
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    return F.aggregate(F.split(text, "[\t ]"), F.lit(0).cast("long"), lambda a, w: a + F.coalesce(table[w], F.lit(0)).cast("long"))


def token_scores(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """A row a token with ``score`` from the lexicon (word, score), else 0, in place of the text; a row with a null text stays as one of score 0.

    Sums over it are sums over the texts. The lexicon is hash-joined, so its size doesn't matter to a token.
    """
    others = [c for c in df.columns if c != text]
    tokens = df.select(*others, F.explode_outer(F.split(text, "[\t ]")).alias("word"))
    return lookup(tokens, lexicon.groupBy("word").agg(F.max("score").cast("long").alias("score")), "word").select(*others, F.coalesce("score", F.lit(0).cast("long")).alias("score"))


def lookup(rows: DataFrame, table: DataFrame, on: str, most: int = 64 << 20) -> DataFrame:
    """A left join; the table is broadcast if its plan is bounded by ``most`` bytes."""
    small = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most
    return rows.join(F.broadcast(table) if small else table, on, "left")


def lexicon_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, score) of lines of words and, last, a score, cut at tabs or blanks; lines without a score go."""
    line = F.trim(F.col(column))
    found = lines.select(F.regexp_extract(line, "^(.*?)[\t ]+[^\t ]+$", 1).alias("word"), F.regexp_extract(line, "([^\t ]+)$", 1).try_cast("int").alias("score"))
    return found.where("word <> '' AND score IS NOT NULL")


def ip_pair(text: Column | str) -> Column:
    """``a.b.c.d-e.f.g.h`` as one long: network byte order read little-endian, the first address in the low half."""
    ends = F.split(text, "[.-]")
    return F.aggregate(F.transform(ends, lambda x, i: F.call_function("shiftleft", x.cast("long"), (i * 8).cast("int"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def int_or_zero(x: Column) -> Column:
    """A number's leading digits as atoi reads them; anything else is 0."""
    return F.coalesce(F.regexp_extract(F.trim(x), r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def low_uint64(bytes_: Column) -> Column:
    """Bytes 9..16 of an id as an unsigned little-endian number, in decimal digits."""
    h = F.hex(F.substring(bytes_, 9, 8))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, 10)
