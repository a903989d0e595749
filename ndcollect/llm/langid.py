"""Language identification by interpolated Kneser-Ney character models.

One 5-gram character model per language, all held in sorted arrays of packed 12-bit symbols (a letter is one of
them, or two where its code point is 3,072 or more, so no two letters are confused): a row
of the table has the log probability of that n-gram under every language, so one binary search serves them
all. The language of lowest length-normalised cross-entropy wins. Models learn from a bounded sample of
labelled rows (``sample_docs`` per language, chosen by a hash of the id; whole texts). A fifth of the sample
is set aside: it calibrates the score's temperature and, per language, the cross-entropy above which a text
is rejected as being in none of the languages.

n-grams are counted on the executors and summed by a partial aggregate; the driver gets counts of distinct
n-grams of the bounded sample. Prediction is one narrow pass over whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null
label are never learned from; with no labelled row at all every text is ``und``; ties go to the
alphabetically first language; repeated rows are predicted alike; extra columns are ignored by ``predict``
and kept by ``keep_identified``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_mod, materialize, merged, modest_batches, text_of

ORDER = 5
BITS = 12
SLICE = 512 << 10  # bytes of text worked on at once
_DIRECT = 3072  # letters below are one symbol, the others two
_LOW = 512
SYMBOLS = 1 << BITS
_tables: list[np.ndarray] = []


def _fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 for what isn't a letter or mark, else the code of the lower-case letter; the second code of
    letters that need two; whether it is a letter. Letters from ``_DIRECT`` on are numbered in order: one code has
    the number's high part, another its low part, from ranges of their own, so no two letters share their codes."""
    if not _tables:
        kinds = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
        low = np.fromiter((ord(chr(i).lower()[0]) if k in "LM" else 0 for i, k in enumerate(kinds)), np.int64, len(kinds))
        wide = np.unique(low[low >= _DIRECT])
        assert len(wide) <= _LOW * (SYMBOLS - _DIRECT - _LOW)
        number = np.searchsorted(wide, low)
        two = low >= _DIRECT
        first = np.where(two, _DIRECT + _LOW + number // _LOW, low).astype(np.uint16)
        second = np.where(two, _DIRECT + number % _LOW, 0).astype(np.uint16)
        _tables.extend((first, second, np.fromiter((k == "L" for k in kinds), bool, len(kinds))))
    return tuple(_tables)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 5-grams, the first of each text, and whether it has a letter. Runs of other characters are one 0."""
    fold, second, letter = _fold()
    points = np.frombuffer(("\0" + "\0".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(size) - size
    x = fold[points]
    letters = np.add.reduceat(letter[points], starts) > 0
    wide = np.flatnonzero(x >= _DIRECT + _LOW)
    if len(wide):
        starts = starts + np.searchsorted(wide, starts)
        x = np.insert(x, wide + 1, second[points[wide]])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    keep[starts] = True
    kept = np.cumsum(keep)
    starts = kept[starts] - 1
    x = x[keep].astype(np.uint64)
    place = np.arange(len(x), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(x))))
    key = x.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(x)
        before[k:] = x[:-k]
        before[place < k] = 0
        key |= before << np.uint64(BITS * k)
    return key, starts, letters


@dataclass
class LanguageModels:
    languages: list[str]
    symbols: int = 1
    keys: list[np.ndarray] = field(default_factory=list)  # by order, from 1
    logp: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # of a symbol that no language has
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: nats per symbol under each language, the number of symbols, and whether it has a letter."""
        key, starts, letters = grams(texts)
        total = np.zeros((len(key), len(self.languages)), np.float32)
        open_ = np.ones(len(key), bool)
        open_[starts] = False
        at = np.flatnonzero(open_)
        q = key[at]
        for n in range(ORDER, 0, -1):
            keys = self.keys[n - 1]
            i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = keys[i] == q
            total[at[hit]] += self.logp[n - 1][i[hit]]
            at, q = at[~hit], q[~hit]
            if not len(at):
                break
            if n == 1:
                total[at] += self.floor
                break
            context = q >> np.uint64(BITS)
            keys = self.keys[n - 2]
            i = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            hit = keys[i] == context
            total[at[hit]] += self.back[n - 2][i[hit]]
            q = q & np.uint64((1 << BITS * (n - 1)) - 1)
        n_symbols = np.diff(np.append(starts, len(key))) - 1
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        return -sums / np.maximum(n_symbols, 1)[:, None], n_symbols, letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts), [0.0] * len(texts)
        h, n, letters = self.entropy(texts)
        best = h.argmin(1)
        low = h.min(1)
        score = 1 / np.exp(-(h - low[:, None]) * (self.temperature * np.sqrt(np.maximum(n, 1)))[:, None]).sum(1)
        limit = self.mean[best] + self.spread[best] / np.sqrt(np.clip(n, 1, 400))
        rejected = ~letters | (low > limit)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters)], [float(s) if ok else 0.0 for s, ok in zip(score, letters)], rejected.tolist(), low.tolist()


def _lookup(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return i, keys[i] == q


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
    """Interpolated Kneser-Ney models from sorted 5-gram keys and their counts, by language."""
    languages = sorted(counts)
    model = LanguageModels(languages)
    if not languages:
        return model
    # By language and order: keys and (below the highest order) continuation counts.
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        own = [counts[lang]]
        for n in range(ORDER - 1, 0, -1):
            own.insert(0, np.unique(own[0][0] & np.uint64((1 << BITS * n) - 1), return_counts=True))
        levels.append(own)
    union: list[np.ndarray] = [np.unique(np.concatenate([own[-1][0] for own in levels]))]
    for n in range(ORDER - 1, 0, -1):
        above = union[0]
        union.insert(0, np.unique(np.concatenate([above & np.uint64((1 << BITS * n) - 1), above >> np.uint64(BITS)])))
    model.symbols = len(union[0]) + 1
    lower: np.ndarray | None = None
    model.floor = np.zeros(len(languages), np.float32)
    model.back = [np.zeros((len(u), len(languages)), np.float32) for u in union]
    for n in range(1, ORDER + 1):
        keys = union[n - 1]
        if lower is None:
            base = np.full((len(keys), len(languages)), 1 / model.symbols)
        else:
            base = lower[np.searchsorted(union[n - 2], keys & np.uint64((1 << BITS * (n - 1)) - 1))]
        p = base.copy()
        context = keys >> np.uint64(BITS) if n > 1 else np.zeros_like(keys)
        for l, own in enumerate(levels):
            k, c = own[n - 1]
            n1, n2 = int((c == 1).sum()), int((c == 2).sum())
            discount = min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 else 0.5
            ctx = k >> np.uint64(BITS) if n > 1 else np.zeros_like(k)
            first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
            seen, total, types = ctx[first], np.add.reduceat(c, first).astype(float), np.diff(np.append(first, len(ctx)))
            gamma = discount * types / total
            i, hit = _lookup(seen, context)
            j, has = _lookup(k, keys)
            own_count = np.where(has, np.maximum(c[j] - discount, 0), 0.0)
            p[:, l] = np.where(hit, own_count / total[i] + gamma[i] * base[:, l], base[:, l])
            if n == 1:
                model.floor[l] = np.log(gamma[0] / model.symbols)
            else:
                i, hit = _lookup(seen, union[n - 2])
                model.back[n - 2][hit, l] = np.log(gamma[i[hit]])
        model.keys.append(keys)
        model.logp.append(np.log(p).astype(np.float32))
        lower = p
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in merged(batches, "text", SLICE):
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            key, starts, _ = grams([t for t, l in zip(texts, langs) if l == lang])
            keys, n = np.unique(np.delete(key, starts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])


def fit(docs: DataFrame, learn: Column | None = None, *, sample_docs: int = 2000) -> LanguageModels:
    """Models from about ``sample_docs`` rows per language of those that ``learn`` admits (default: all).

    The sample is the rows with the smallest hash of id and language; its size follows the bound, not the table.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(learn) if learn is not None else rows
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not per:
        return build({})
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(per.items()) for x in (lang, min(1.0, sample_docs / n)))), F.col("lang")), F.lit(0.0))
    sample = materialize(rows.select("doc_id", "lang", "text").where(draw < rate).select("lang", "text", (F.pmod(F.xxhash64("text", "doc_id"), F.lit(5)) == 0).alias("apart")).repartition(spark.sparkContext.defaultParallelism), "lang-sample")
    learned, apart = sample.where("NOT apart"), sample.where("apart")
    counted = learned.select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    keys, n, langs = counted["key"].to_numpy().view(np.uint64), counted["n"].to_numpy(), np.array(counted["lang"].to_pylist(), object)
    counts = {}
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(keys[own])]
        counts[lang] = keys[own], n[own]
    model = build(counts)
    _calibrate(model, apart, learned)
    return model


def _calibrate(model: LanguageModels, apart: DataFrame, learned: DataFrame) -> None:
    """Temperature and rejection limits from the rows set aside (the learned ones where a language has none)."""
    n_lang = len(model.languages)
    model.mean, model.spread = np.full(n_lang, np.inf), np.zeros(n_lang)
    if not n_lang:
        return
    shared = apart.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", SLICE):
            h, n, letters = shared.value.entropy([t or "" for t in batch.column("text").to_pylist()])
            ok = pa.array(letters & (n > 0))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], names=["lang", "n", "h"]).filter(ok)

    got = apart.select("lang", "text").mapInArrow(measure, "lang string, n long, h array<double>").toArrow()
    if not got.num_rows:
        got = learned.select("lang", "text").mapInArrow(measure, "lang string, n long, h array<double>").toArrow()
    index = {l: i for i, l in enumerate(model.languages)}
    rows = [(index[l], n, h) for l, n, h in zip(got["lang"].to_pylist(), got["n"].to_pylist(), got["h"].to_pylist()) if l in index]
    if not rows:
        return
    y, n, h = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    gap = (h - h.min(1, keepdims=True)) * np.sqrt(n)[:, None]
    best = None
    for t in 2.0 ** np.arange(-4, 5):
        loss = (np.log(np.exp(-gap * t).sum(1)) + gap[np.arange(len(y)), y] * t).mean() + 1e-4 * t
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = float(best[1])
    right = h.argmin(1)
    for l in range(n_lang):
        own = right == l
        if not own.any():
            continue
        x, m = h[own, l], np.sqrt(np.clip(n[own], 1, 400))
        model.mean[l] = np.average(x, weights=m)
        model.spread[l] = max(1.25 * np.quantile((x - model.mean[l]) * m, 0.999), 2.0)


def predict(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected, cross_entropy (nats per symbol) of every row."""
    return _annotate(docs.select("doc_id", text_of("text").alias("text")), model).drop("text")


def _annotate(docs: DataFrame, model: LanguageModels) -> DataFrame:
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", SLICE):
            lang, score, rejected, h = shared.value.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(h, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "rejected", "cross_entropy"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(n: int = 5) -> Column:
    return id_mod("doc_id", n) == 0


def keep_identified(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """``docs`` with its columns, without the rows whose text is rejected."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", SLICE):
            rejected = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])[2]
            yield batch.filter(pa.array([not r for r in rejected]))

    return docs.mapInArrow(run, docs.schema)
