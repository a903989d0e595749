"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are the digits of a polynomial, evaluated modulo a prime. Chunks are hashed apart, and
the hash of ``a + b`` is ``h(a) * 256 ** len(b) + h(b)``. Texts of more than ``parallel_bytes`` are dealt out as
chunks, hashed by whatever task, and their chunk hashes combined by length-shifted arithmetic (``combine``);
shorter ones are hashed where they are. Each text is hashed once. Rows whose fingerprint and length no other
row has are settled by the fingerprint alone. The others meet their group's representative and are compared
chunk by chunk, stopping at the first difference; rows that only collide form groups of their own in a further
round, so the result never depends on the hash.

Groups are counted with map-side partial sums. The comparison is an equi-join against one representative a
group, between two written tables, so AQE can split a group that holds a third of all rows. No text is
collected and only texts that have a partner are written.

Defined cases: a null text is the empty text; a null doc_id ranks below all others; of rows that repeat both
doc_id and text one is kept; extra columns, whatever their names, are ignored by ``groups`` and kept by
``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, modest_batches, text_of, unused

PRIME = (1 << 120) + 12421  # a test checks that it is prime
CHUNK = 1 << 13


def chunk_hash(data: bytes | memoryview) -> int:
    return int.from_bytes(data, "big") % PRIME


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(hash, length) of two neighbouring pieces as one."""
    return (left[0] * pow(256, right[1], PRIME) + right[0]) % PRIME, left[1] + right[1]


def fingerprint(data: bytes, chunk: int = CHUNK) -> int:
    if len(data) <= chunk:
        return chunk_hash(data)
    view, h, step = memoryview(data), 0, pow(256, chunk, PRIME)
    for at in range(0, len(data) - len(data) % chunk, chunk):
        h = (h * step + chunk_hash(view[at : at + chunk])) % PRIME
    rest = len(data) % chunk
    return (h * pow(256, rest, PRIME) + chunk_hash(view[len(data) - rest :])) % PRIME if rest else h


def _digests(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda x: fingerprint(x).to_bytes(16, "big"))


def _in_order(parts: pd.Series) -> pd.Series:
    def one(xs) -> bytes:
        out = (0, 0)
        for x in xs:
            out = combine(out, (int.from_bytes(x["h"], "big"), int(x["n"])))
        return out[0].to_bytes(16, "big")

    return parts.map(one)


def _udf(function):
    """``function`` of a series without nulls as a column function; nulls stay."""

    def run(x: pd.Series) -> pd.Series:
        return function(x[x.notna()]).reindex(x.index)

    return F.pandas_udf(run, T.BinaryType())


def _combined(texts: DataFrame, keys: list[str], digests, chunk: int) -> DataFrame:
    """The keys and ``fp`` of texts (keys, data), with the chunks of a text hashed by different tasks. Rows of equal keys hold equal data."""
    data = F.col("data")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / chunk)).cast("int")
    pieces = (
        texts.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * chunk + 1, F.lit(chunk)))).alias("at", "piece"))
        .repartition(*keys, "at")
        .select(*keys, "at", F.octet_length("piece").cast("long").alias("n"), _udf(digests)("piece").alias("h"))
    )
    once = pieces.groupBy(*keys, "at").agg(F.first("n").alias("n"), F.first("h").alias("h"))
    parts = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "n", "h"))).alias("parts"))
    return parts.select(*keys, _udf(_in_order)(F.transform("parts", lambda p: F.struct(p.n.alias("n"), p.h.alias("h")))).alias("fp"))


def fingerprint_parallel(docs: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes and fingerprint of every text, chunk by chunk. ``doc_id`` must be unique."""
    rows = docs.select("doc_id", text_of("text").cast("binary").alias("data")).select("doc_id", "data", F.octet_length("data").cast("long").alias("n_bytes"))
    return _combined(rows, ["doc_id", "n_bytes"], _digests, chunk).withColumnRenamed("fp", "fingerprint")


def same(a: Column, b: Column, n: Column, chunk: int = 1 << 16) -> Column:
    """Whether two binaries of ``n`` bytes agree, chunk by chunk from the start until they differ."""
    last = ((F.greatest(n, F.lit(1)) - 1) / chunk).cast("int")
    return F.forall(F.sequence(F.lit(0), last), lambda i: F.substring(a, i * chunk + 1, F.lit(chunk)) == F.substring(b, i * chunk + 1, F.lit(chunk)))


_FP, _TEXT = ["fp", "n_bytes"], ["doc_id", "sha"]


def _meets(left: DataFrame, right: DataFrame, how: str, keys: list[str] = _TEXT) -> DataFrame:
    """A merge join on keys that may be null; ``left`` keeps its columns, and gets those of ``right`` that it lacks."""
    other = right.select(*(F.col(c).alias(f"other_{c}" if c in keys else c) for c in right.columns)).hint("merge")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return left.join(other, on, how).select(*left.columns, *([] if how.startswith("left_") else [c for c in right.columns if c not in keys]))


def _marks(docs: DataFrame, digests, parallel_bytes: int) -> DataFrame:
    """uid (a number of the row), doc_id, n_bytes, sha and fp of every row, written."""
    rows = _texts(docs)
    n = F.octet_length("data")
    marks = rows.select("doc_id", n.alias("n_bytes"), "sha", _udf(digests)(F.when(n <= parallel_bytes, F.col("data"))).alias("fp")).withColumn("uid", F.monotonically_increasing_id())
    marks = materialize(marks, "exact-marks")
    huge = marks.where("fp IS NULL")
    if huge.isEmpty():
        return marks
    prints = materialize(_combined(rows.where(n > parallel_bytes), _TEXT, digests, max(1, parallel_bytes // 4)), "exact-huge")
    return materialize(marks.where("fp IS NOT NULL").unionByName(_meets(huge.drop("fp"), prints, "inner")), "exact-marks")


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text_of("text").cast("binary").alias("data"))
    return rows.select("doc_id", "data", F.sha2("data", 256).alias("sha"))


def _grouped(marks: DataFrame) -> DataFrame:
    """Groups of equal fingerprint and length: the row that stays, by its id, number and text, and their size."""
    rows = marks.groupBy(*_FP).agg(F.max(F.struct("doc_id", "uid", "sha")).alias("keep"), F.count(F.lit(1)).alias("size"))
    return rows.select(*_FP, F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"), F.col("keep.sha").alias("keep_sha"), "size")


def groups(docs: DataFrame, *, digests=_digests, parallel_bytes: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. ``digests`` gives the fingerprints of a series."""
    modest_batches(docs.sparkSession)
    marks = _marks(docs, digests, parallel_bytes)
    shared = materialize(_grouped(marks).where("size > 1"), "exact-groups")
    out = ["uid", "doc_id", "sha", "keep_id", "keep_uid", "size"]
    alone = marks.join(shared.hint("merge"), _FP, "left_anti").select("uid", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("size"))
    level = materialize(marks.join(shared.hint("merge"), _FP), "exact-level")
    texts = materialize(_meets(_texts(docs), level.select(*_TEXT, *_FP).distinct(), "inner"), "exact-texts")
    parts = [alone]
    while True:
        own = texts.join(shared.hint("merge"), _FP).where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
        first = materialize(own.groupBy(*_FP).agg(F.first("data").alias("first")), "exact-first")
        differ = texts.join(first.hint("merge"), _FP).where(~same(F.col("data"), F.col("first"), F.col("n_bytes"))).select(*_TEXT, *_FP).distinct()
        differ = materialize(differ, "exact-differ")
        if differ.isEmpty():
            parts.append(level.select(*out))
            break
        # Rows that only collided: they leave their group, and those of them that agree form new ones.
        apart = materialize(_meets(level, differ, "left_semi", [*_TEXT, *_FP]), "exact-apart")
        gone = apart.groupBy(*_FP).agg(F.count(F.lit(1)).alias("gone"))
        stay = _meets(level, differ, "left_anti", [*_TEXT, *_FP]).join(gone, _FP, "left")
        parts.append(stay.withColumn("size", F.col("size") - F.coalesce("gone", F.lit(0))).select(*out))
        shared = materialize(_grouped(apart), "exact-groups")
        level = materialize(apart.select(*marks.columns).join(shared.hint("merge"), _FP), "exact-level")
        texts = materialize(_meets(texts, level.select(*_TEXT, *_FP).distinct(), "left_semi", [*_TEXT, *_FP]), "exact-texts")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns and one row of each text: one of the largest doc_id."""
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = materialize(groups(docs, **options).where("NOT kept").select("doc_id", F.col("text_sha256").alias("sha"), own.alias("again")).distinct(), "exact-gone")
    return without(docs, gone, F.sha2(text_of("text").cast("binary"), 256))


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, a key of the text, again); where ``again`` is set, one of the rows stays."""
    name, other, theirs, again = unused(docs.columns, "__key", "__id", "__theirs", "__again")
    gone = gone.toDF(other, theirs, again)
    on = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(name) == F.col(theirs))
    left = docs.withColumn(name, key).join(gone.where(~F.col(again)).hint("merge"), on, "left_anti")
    twice = gone.where(F.col(again))
    if not twice.isEmpty():
        left = left.join(twice.hint("merge"), on, "left_anti").unionByName(left.join(twice.hint("merge"), on, "left_semi").dropDuplicates(["doc_id", name]))
    return left.drop(name)
