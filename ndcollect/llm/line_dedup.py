"""Removal of repeated multi-line passages by content-defined chunks of lines, in DataFrame functions only.

A text's lines are hashed; a polynomial rolling hash over each window of ``WINDOW`` line hashes decides whether
a chunk ends there (all but one place in ``DIVISOR``). A boundary depends on the lines around it alone, so the
chunks inside a passage are the same wherever it stands. A chunk that the table has more than once is compared
byte by byte with its first occurrence (smallest doc_id, then place), and the match is extended line by line into
both neighbouring chunks, whose far ends differ where the passage begins or ends amid them. Matches of two lines
or more, not all blank, are removed. A line goes only where an earlier line is the same, so of every line that
goes one copy stays.

Chunks first meet by two 64-bit hashes, with map-side partial counts and places but without their text. Only
chunks that repeat, and their neighbours, then move bytes. Every meeting is an aggregate with partial sums or a
merge join on written tables, so a chunk that a third of all documents has is split by AQE. Two different chunks
that agree in both hashes (expected once in 2**128 pairs) are told apart by their bytes and stay.

Defined cases: a null text is empty: one empty line, nothing removed; rows that repeat id and text are one
document, all their rows lose the same lines; a null id ranks first; a text whose every line is removed becomes
empty; extra columns are ignored by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_of

WINDOW = 2
DIVISOR = 16
BASE = 1_000_003
MODULUS = (1 << 31) - 1
_DOC, _HASH = ("doc_id", "text_key"), ["h", "g"]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _rolling(hashes: Column, i: Column) -> Column:
    """The polynomial of the hashes of the ``WINDOW`` lines up to line ``i``; lines before the first count 0."""
    total, power = F.lit(0).cast("long"), 1
    for k in range(WINDOW):
        total = total + F.when(i >= k, F.get(hashes, i - k)).otherwise(F.lit(0).cast("long")) * F.lit(power)
        power = power * BASE % MODULUS
    return total % MODULUS


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lines and ends: the last line of each chunk, from 0."""
    text = text_of("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.select("*", F.transform("lines", line_hash).alias("hashes"))
    last = F.size("lines") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (_rolling(F.col("hashes"), i) % DIVISOR != 0))
    return rows.select(*_DOC, "lines", ends.alias("ends"))


def _start(place: Column) -> Column:
    return F.when(place > 0, F.get(F.col("ends"), place - 1) + 1).otherwise(F.lit(0))


def _chunk(place: Column) -> Column:
    """The lines of a chunk; none where there is no such place."""
    there = (place >= 0) & (place < F.size("ends"))
    got = F.slice(F.col("lines"), _start(place) + 1, F.get(F.col("ends"), place) - _start(place) + 1)
    return F.when(there, got).otherwise(F.array().cast("array<string>"))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def _alike(a: Column, b: Column) -> Column:
    """How many elements two arrays agree in, from the start until they differ."""
    both = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    n = F.aggregate(both, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), n).otherwise(F.lit(0))


def _on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A merge join by document, whose id may be null."""
    there = right.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).hint("merge")
    return left.join(there, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), how).drop("__id", "__key")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ranges (first and last line, from 0) of each document that loses any lines."""
    place = lambda p: F.struct(p.alias("place"), *_hashes(F.array_join(_chunk(p), "\n")))
    chunks = _lines(docs).select(*_DOC, F.explode(F.transform(F.sequence(F.lit(0), F.size("ends") - 1), place)).alias("c")).select(*_DOC, "c.*")
    own = F.struct(*_DOC, "place")
    often = materialize(chunks.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first")).where("n > 1").select(*_HASH, "first"), "lines-often")
    later = materialize(chunks.join(often.hint("merge"), _HASH).where(~own.eqNullSafe(F.col("first"))).select(*_DOC, "place", *_HASH, "first"), "lines-later")
    firsts = later.groupBy(*_HASH).agg(F.first("first").alias("f")).select("f.*", F.lit(True).alias("is_first"))
    wanted = later.select(*_DOC, "place", F.lit(False).alias("is_first")).unionByName(firsts)
    wanted = wanted.groupBy(*_DOC).agg(F.collect_set(F.struct("place", "is_first")).alias("places"))
    sides = lambda p: F.struct(p.is_first.alias("is_first"), _start(p.place).alias("start"), *(_chunk(p.place + k).alias(n) for k, n in ((-1, "before"), (0, "chunk"), (1, "after"))))
    pieces = _on(_lines(docs), wanted, "inner").select(*_DOC, F.explode(F.transform("places", sides)).alias("p")).select(*_DOC, "p.*")  # an array first: exploding places would copy the document for each
    pieces = materialize(pieces.select("*", *_hashes(F.array_join("chunk", "\n"))), "lines-pieces", "zstd")  # texts thrice
    first = materialize(pieces.where("is_first").groupBy(*_HASH).agg(F.first(F.struct("before", "chunk", "after")).alias("f")), "lines-first")
    again = pieces.where("NOT is_first").join(first.hint("merge"), _HASH).where(F.col("chunk") == F.col("f.chunk"))
    up, down = _alike(F.reverse("before"), F.reverse(F.col("f.before"))), _alike(F.col("after"), F.col("f.after"))
    again = again.select(*_DOC, "start", "before", "chunk", "after", up.alias("up"), down.alias("down"))
    run = F.concat(F.slice(F.col("before"), F.size("before") - F.col("up") + 1, F.col("up")), F.col("chunk"), F.slice(F.col("after"), F.lit(1), F.col("down")))
    again = again.select(*_DOC, (F.col("start") - F.col("up")).alias("a"), run.alias("run")).where((F.size("run") >= 2) & F.array_join("run", "\n").rlike("[^ \t\n\r]"))
    out = again.groupBy(*_DOC).agg(F.collect_set(F.struct("a", (F.col("a") + F.size("run") - 1).alias("b"))).alias("ranges"))
    out = materialize(out, "lines-removed")
    discard(often, later, pieces, first)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text (cleaned), n_lines, n_chunks, n_matches and n_removed_lines of every row."""
    rows = _on(_lines(docs), removed(docs), "left")
    ranges = F.coalesce("ranges", F.array().cast("array<struct<a:int,b:int>>"))
    gone = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r.a, r.b))))
    rows = rows.select("doc_id", "lines", F.size("ends").cast("long").alias("n_chunks"), F.size(ranges).cast("long").alias("n_matches"), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone).alias("stay"))
    text = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    return rows.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), "n_chunks", "n_matches", (F.size("lines") - F.size("stay")).cast("long").alias("n_removed_lines"))
