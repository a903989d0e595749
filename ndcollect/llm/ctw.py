"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a tree whose nodes are the contexts of 0 to ``DEPTH``
preceding bytes. A node estimates its bit by Krichevsky-Trofimov counts, and its weighted probability is half
its own estimate and half the product of its children's, so every depth takes part by the evidence of the
training texts. Scoring keeps the trained counts: a bit's probability is, from the root down, the mixture of
the nodes' estimates under the posterior weights. A text is its bytes and an end byte (0xFF, never in UTF-8),
the context before its start is that same byte, so scores are log probabilities of whole texts. With ``plain``,
a text is read as the base score reads it: A-Z in lower case, words parted by one space.

The model grows with the corpus and is never held in one place:

1. documents are dealt into blocks of a bounded share of the input; each block yields its distinct
   (DEPTH + 1)-grams and words with their training counts (map-side sums);
2. counts are summed by gram, dealt by the three latest context bytes, where the trees from depth three on
   are weighed by vectorised recursion;
3. depths zero to two have at most 65,536 * 255 nodes: each is summed on one executor, and they are broadcast;
4. each block gets back the log probability of just its own grams and words, and scores its documents.

Grams and words travel as packed arrays, one for each block and part: a few bytes an entry. There are as many
parts as blocks, up to ``most_parts``, so rows grow with the input from there on. No task takes more than
``GROUP`` blocks of one part at a time: counts are summed in rounds, group by group, and answers are given group
by group, so a part of very frequent contexts is many tasks and what one holds is bounded by its distinct grams.

Defined cases: a null text is empty and has the score of an immediate end; with no training text the model is
uniform (each bit one half) and the base score divides by one; repeated rows are scored alike; rows with a
null id take part under the hash of the empty text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, materialize, mix64, modest_batches, scratch, text_bytes, text_of

DEPTH = 6
STOP = 3  # from this depth on, trees are weighed by part; what is above is small
END = 255
_DOC_BITS = 64 - 8 * (DEPTH + 1)  # what a key leaves of a 64-bit word numbers the documents of a slice
_LOG2 = np.log(2.0)


def contexts(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """A key for every byte of every text and its end: latest context byte first, the byte itself last.

    Returns the keys and the offsets of each text's keys (its bytes and one end).
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    x = np.full(len(data) + depth * (n + 1), END, np.uint8)
    shift = np.repeat(np.arange(1, n + 1) * depth, sizes)
    x[np.arange(len(data)) + shift] = data
    starts = offsets[:-1] + depth * np.arange(1, n + 1)
    x = x.astype(np.uint64)
    key = x[depth:].copy()
    for k in range(1, depth + 1):
        key |= x[depth - k : len(x) - k] << np.uint64(8 * (depth + 1 - k))
    wanted = np.ones(len(key), bool)  # of the ``depth`` ends after a text only the first is scored
    ends = starts + sizes - depth
    for k in range(1, depth):
        at = ends + k
        wanted[at[at < len(key)]] = False
    return key[wanted], np.concatenate([[0], np.cumsum(sizes + 1)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    p = x.copy()
    for k in range(1, 8):
        p *= x + k
    return s - np.log(p)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - np.log(np.pi)


class _Level:
    """Distinct (context of d bytes, byte) keys, sorted, with counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n

    def nodes(self, k: int):
        """For bit k: first key of each node, node of each key, the key's bit, zeros and ones of each node."""
        prefix = self.key >> np.uint64(8 - k)
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(prefix))))
        bit = (self.key >> np.uint64(7 - k)) & np.uint64(1)
        ones = np.add.reduceat(np.where(bit == 1, self.n, 0), first)
        total = np.add.reduceat(self.n, first)
        return first, of, bit.astype(np.int64), total - ones, ones


def _shorten(level: _Level) -> tuple[_Level, np.ndarray]:
    """The level of contexts one byte shorter, and where each key of ``level`` goes."""
    key = ((level.key >> np.uint64(16)) << np.uint64(8)) | (level.key & np.uint64(255))
    own, to = np.unique(key, return_inverse=True)
    return _Level(own, np.bincount(to, level.n, len(own))), to


def weigh(key: np.ndarray, n: np.ndarray, depth: int = DEPTH, stop: int = 2) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Weigh the trees over sorted distinct keys that hold whole contexts of ``stop`` bytes.

    Returns, by key and bit, the probability of the key's bit mixed over depths ``stop`` and more, and the sums
    that depth ``stop - 1`` needs by (latest bytes, bit prefix): log weights of the children, zeros and ones.
    """
    levels, maps = [_Level(key, n.astype(float))], []
    for _ in range(depth - stop):
        shorter, to = _shorten(levels[-1])
        levels.append(shorter)
        maps.append(to)
    p = np.empty((len(key), 8), np.float32)
    up: dict[str, list[np.ndarray]] = {"node": [], "logw": [], "n0": [], "n1": []}
    for k in range(8):
        first, of, bit, n0, n1 = levels[0].nodes(k)
        logw = log_kt(n0, n1)
        mixed = (np.where(bit == 1, n1[of], n0[of]) + 0.5) / (n0 + n1 + 1)[of]
        at = np.arange(len(key))
        for level, to in zip(levels[1:], maps):
            at = to[at]
            below_first = first
            first, of, bit, n0, n1 = level.nodes(k)
            children = np.bincount(of[to[below_first]], logw, len(first))
            own = log_kt(n0, n1)
            logw = np.logaddexp(own, children) - _LOG2
            beta = np.exp(own - _LOG2 - logw)
            kt = (np.where(bit == 1, n1[of], n0[of]) + 0.5) / (n0 + n1 + 1)[of]
            share = beta[of]
            mixed = (share * kt)[at] + (1 - share)[at] * mixed
        p[:, k] = mixed
        # Without the last context byte; the bit prefix keeps its leading 1.
        prefix = levels[-1].key[first]
        context = prefix >> np.uint64(16)
        bits = ((prefix & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - k)
        node, to = np.unique((context << np.uint64(8)) | bits, return_inverse=True)
        up["node"].append(node)
        for name, v in (("logw", logw), ("n0", n0), ("n1", n1)):
            up[name].append(np.bincount(to, v, len(node)))
    return p, {name: np.concatenate(v) for name, v in up.items()}


class Roots:
    """Depths below ``STOP`` of all trees, from summed (node, log weight of the children, zeros, ones) of the deepest of them."""

    def __init__(self, node: np.ndarray, logw: np.ndarray, n0: np.ndarray, n1: np.ndarray, depths: int = 2):
        own, to = np.unique(node.astype(np.int64), return_inverse=True)
        logw, n0, n1 = (np.bincount(to, np.asarray(v, float), len(own)) for v in (logw, n0, n1))
        self.node: list[np.ndarray] = []
        self.share: list[np.ndarray] = []
        self.kt: list[np.ndarray] = []
        for d in range(depths, -1, -1):
            kt = log_kt(n0, n1)
            weight = np.logaddexp(kt, logw) - _LOG2
            self.node.append(own)
            self.share.append(np.exp(kt - _LOG2 - weight).astype(np.float32))
            self.kt.append((n1 + 0.5) / (n0 + n1 + 1))  # in 32 bits it would be 1 from 2**24 ones on, and a zero impossible
            if d:
                own, to = np.unique(((own >> 16) << 8) | (own & 255), return_inverse=True)
                logw, n0, n1 = np.bincount(to, weight, len(own)), np.bincount(to, n0, len(own)), np.bincount(to, n1, len(own))

    def log10(self, key: np.ndarray, p: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 of the probability of each key's byte, from its bits' mixtures over the deeper levels."""
        byte = (key & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(key))
        for k in range(8):
            bits = (byte | 256) >> (8 - k)
            bit = (byte >> (7 - k)) & 1
            q = p[:, k].astype(float)
            for j, d in enumerate(range(len(self.node) - 1, -1, -1)):
                node = ((key >> np.uint64(8 * (depth + 1 - d))).astype(np.int64) << 8) | bits
                at = np.searchsorted(self.node[j], node)
                share, kt = self.share[j][at], self.kt[j][at]
                q = share * np.where(bit == 1, kt, 1 - kt) + (1 - share) * q
            out += np.log10(q)
        return out


# Arrays travel between tasks packed: sorted keys as differences, bytes of equal weight together, compressed.


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1) if len(x) else b""


def _unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _words(data: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased words of all texts, and how many each text has."""
    words: list[bytes] = []
    n = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = data[a:b].split()
        words += own
        n.append(len(own))
    return words, np.array(n, np.int64)


def _word_keys(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), np.uint64)


_END_WORD = b" "
_GRAM, _WORD = 0, 1
_REQUEST = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_SPLIT = 4
GROUP = 256  # blocks of one part that a task takes together


def _part_of(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    if kind == _WORD:
        return (keys % np.uint64(parts)).astype(np.int64)
    groups = np.uint64(parts // _SPLIT)
    latest = mix64(keys >> np.uint64(8 * (DEPTH - 1)))  # the two latest bytes
    third = (keys >> np.uint64(8 * (DEPTH - 2))) & np.uint64(255)
    return ((latest % groups) * np.uint64(_SPLIT) + third % np.uint64(_SPLIT)).astype(np.int64)


def _slices(rows: pa.Table, most: int = 1 << _DOC_BITS, most_bytes: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and learn flags of a few documents at a time; a longer document comes alone."""
    for batch in by_bytes(rows.select(["text", "learn"]).combine_chunks().to_batches(max_chunksize=most), "text", most_bytes):
        yield *text_bytes(batch.column("text")), np.asarray(batch.column("learn").to_pylist(), bool)


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as their tokens: A-Z in lower case, words parted by one space."""
    low = data.tobytes().lower()
    texts = [b" ".join(low[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _sorted_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and for every place in key order the document and the index of its key."""
    key, ends = contexts(data, offsets)
    doc = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    both = np.sort((key << np.uint64(_DOC_BITS)) | doc)
    key = both >> np.uint64(_DOC_BITS)
    new = np.r_[True, key[1:] != key[:-1]]
    return key[new], (both & np.uint64((1 << _DOC_BITS) - 1)).astype(np.int64), np.cumsum(new) - 1


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, to = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(to, np.concatenate(counts), len(own)).astype(np.int64)


def _request(parts: int, plain: bool, most_held: int = 1 << 21):
    def run(key, rows):
        grams, words = ([], []), ([], [])
        held = 0
        for data, offsets, learn in _slices(rows):
            if plain:
                data, offsets = _plain(data, offsets)
            own, doc, of = _sorted_places(data, offsets)
            grams[0].append(own)
            grams[1].append(np.bincount(of, learn[doc], len(own)).astype(np.int64))
            held += len(own)
            if held > most_held:
                grams, held = tuple([x] for x in _merge(*grams)), 0
            low = data.tobytes().lower()
            count: Counter[bytes] = Counter()
            seen: set[bytes] = set()
            for a, b, l in zip(offsets[:-1], offsets[1:], learn):
                own_words = low[a:b].split()
                count.update(own_words) if l else seen.update(own_words)
            count[_END_WORD] += int(learn.sum())
            for w in seen - count.keys():
                count[w] = 0
            words[0].append(_word_keys(list(count)))
            words[1].append(np.fromiter(count.values(), np.int64, len(count)))
        out = []
        for kind, (keys, counts) in ((_GRAM, grams), (_WORD, words)):
            own, n = _merge(keys, counts)
            part = _part_of(kind, own, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[cuts[p] : cuts[p + 1]]
                if len(at):
                    out.append((key[0].as_py(), kind, p, _pack_keys(own[at]), _pack(n[at])))
        return _table(out, _REQUEST)

    return run


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_TOTALS = T.StructType([T.StructField("part", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("tokens", T.LongType()), T.StructField("distinct", T.LongType())])


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _merge([_unpack_keys(k) for k in rows.column("keys").to_pylist()], [_unpack(c, np.int64) for c in rows.column("counts").to_pylist()])


def _merge_group(key, rows):
    own, n = _merged(rows)
    return _table([(key[1].as_py(), None, key[0].as_py(), _pack_keys(own), _pack(n))], _REQUEST)


def _summed(requests: DataFrame, blocks: int) -> DataFrame:
    """Keys and counts by part and group of blocks, in rounds until a part has at most ``GROUP`` rows."""
    while blocks > GROUP:
        blocks = -(-blocks // GROUP)
        grouped = requests.withColumn("block", F.floor(F.col("block") / GROUP)).groupBy("part", "block")
        requests = materialize(grouped.applyInArrow(_merge_group, _REQUEST), "ctw-sums")
    return requests


def _count_words(key, rows):
    """A part's words and their counts over the whole corpus."""
    own, n = _merged(rows)
    return _table([(key[0].as_py(), _pack_keys(own), _pack(n), int(n.sum()), int((n > 0).sum()))], _TOTALS)


def _answer_words(key, totals, requests):
    out = []
    if totals.num_rows and requests.num_rows:
        own, n = _unpack_keys(totals.column("keys")[0].as_py()), _unpack(totals.column("counts")[0].as_py(), np.int64)
        for b, packed in zip(requests.column("block").to_pylist(), requests.column("keys").to_pylist()):
            out.append((b, _WORD, key[0].as_py(), packed, _pack(n[np.searchsorted(own, _unpack_keys(packed))])))
    return _table(out, _REQUEST)


def _by_group(model: DataFrame, requests: DataFrame, blocks: int, answer) -> DataFrame:
    """Answers to requests, a task for each part and group of blocks; the part's model meets each group."""
    groups = -(-blocks // GROUP)
    each = model.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    asked = requests.withColumn("group", F.floor(F.col("block") / GROUP))
    return each.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(answer, _REQUEST)


_TREES = T.StructType([T.StructField("part", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("mixed", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("logw", T.BinaryType()), T.StructField("n0", T.BinaryType()), T.StructField("n1", T.BinaryType())])


def _weigh_part(key, rows):
    own, n = _merged(rows)
    p, up = weigh(own, n, stop=STOP)
    node, to = np.unique(up["node"].astype(np.int64), return_inverse=True)
    sums = [np.bincount(to, up[x], len(node)) for x in ("logw", "n0", "n1")]
    return _table([(key[0].as_py(), _pack_keys(own), _pack(p.ravel()), _pack(node), *(_pack(x) for x in sums))], _TREES)


def _answer(roots):
    def run(key, trees, requests):
        out = []
        if trees.num_rows and requests.num_rows:
            own = _unpack_keys(trees.column("keys")[0].as_py())
            log = roots.value.log10(own, _unpack(trees.column("mixed")[0].as_py(), np.float32).reshape(-1, 8)).astype(np.float32)
            for b, packed in zip(requests.column("block").to_pylist(), requests.column("keys").to_pylist()):
                out.append((b, _GRAM, key[0].as_py(), packed, _pack(log[np.searchsorted(own, _unpack_keys(packed))])))
        return _table(out, _REQUEST)

    return run


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("learn", T.BooleanType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _score(tokens: int, distinct: int, plain: bool):
    def run(key, rows, answers):
        got = {}
        for kind, dtype in ((_GRAM, np.float32), (_WORD, np.int64)):
            own = [(_unpack_keys(k), _unpack(v, dtype)) for i, k, v in zip(answers.column("kind").to_pylist(), answers.column("keys").to_pylist(), answers.column("counts").to_pylist()) if i == kind]
            keys = np.concatenate([k for k, _ in own]) if own else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            got[kind] = keys[order], (np.concatenate([v for _, v in own]) if own else np.zeros(0, dtype))[order]
        columns: list[list] = [[] for _ in range(5)]
        for data, offsets, learn in _slices(rows):
            columns[0] += np.diff(offsets).tolist()
            if plain:
                data, offsets = _plain(data, offsets)
            own, doc, of = _sorted_places(data, offsets)
            log = got[_GRAM][1][np.searchsorted(got[_GRAM][0], own)].astype(float)
            score = np.bincount(doc, log[of], len(offsets) - 1)
            words, per = _words(data.tobytes().lower(), offsets)
            distinct_words = list({*words, _END_WORD})
            counts = got[_WORD][1][np.searchsorted(got[_WORD][0], _word_keys(distinct_words))]
            count = dict(zip(distinct_words, counts.tolist()))
            c = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
            base = np.log10((c + 1) / (tokens + 1 * (distinct + 1)))
            ends = np.cumsum(per)
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])
            last = count[_END_WORD]
            columns[1] += (per + 1).tolist()
            columns[2] += (total((c > 0).astype(np.int64)) + int(last > 0)).tolist()
            columns[3] += (total(base) + np.log10((last + 1) / (tokens + 1 * (distinct + 1)))).tolist()
            columns[4] += score.tolist()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("learn"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "learn", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, learn: Column, *, plain: bool = False, block_bytes: int = 12 << 20, most_parts: int = 4096) -> DataFrame:
    """doc_id, learn, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    ``learn`` marks the rows whose texts train the model; both scores are log10 probabilities of the text. With
    ``plain`` they are of the same thing, its tokens; ``n_bytes`` are those of the text as it is.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select("doc_id", text_of("text").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size, many = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    blocks = max(1, -(-(size or 0) // block_bytes), -(-many // 200_000))
    parts = _SPLIT * max(2, min(-(-blocks // _SPLIT), most_parts // _SPLIT))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    with scratch(spark) as keep:  # what the answers are made from goes once they are written
        requests = materialize(dealt.groupBy("block").applyInArrow(_request(parts, plain), _REQUEST), "ctw-requests")
        words, grams = (requests.where(F.col("kind") == k) for k in (_WORD, _GRAM))
        totals = materialize(_summed(words, blocks).groupBy("part").applyInArrow(_count_words, _TOTALS), "ctw-words")
        tokens, distinct = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        trees = materialize(_summed(grams, blocks).groupBy("part").applyInArrow(_weigh_part, _TREES), "ctw-trees")
        roots = spark.sparkContext.broadcast(_collect_roots(trees))
        answers = _by_group(trees.select("part", "keys", "mixed"), grams, blocks, _answer(roots))
        answers = materialize(answers.unionByName(_by_group(totals, words, blocks, _answer_words)), "ctw-answers")
        keep.append(answers)
    schema = T.StructType([docs.schema["doc_id"], *SCORES.fields[1:]])
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(tokens, distinct, plain), schema)
    return out.select("*", F.lit(tokens).cast("long").alias("train_tokens"), (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


_NODE_SUMS = "node binary, logw binary, n0 binary, n1 binary"


def _fold(key, rows):
    """The sums of the nodes of the parts that share their two latest context bytes."""
    node, to = np.unique(np.concatenate([_unpack(x, np.int64) for x in rows.column("node").to_pylist()]), return_inverse=True)
    sums = [np.bincount(to, np.concatenate([_unpack(x, np.float64) for x in rows.column(c).to_pylist()]), len(node)) for c in ("logw", "n0", "n1")]
    return pa.Table.from_arrays([pa.array([_pack(x)], pa.binary()) for x in (node, *sums)], names=["node", "logw", "n0", "n1"])


def _collect_roots(trees: DataFrame) -> Roots:
    """The nodes of depths below ``STOP``, each summed on an executor: there are at most 65,536 * 255 whatever the corpus."""
    once = trees.select(F.floor(F.col("part") / _SPLIT).alias("latest"), "node", "logw", "n0", "n1").groupBy("latest").applyInArrow(_fold, _NODE_SUMS)
    held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], *([np.zeros(0)] for _ in range(3))]
    for row in once.toLocalIterator():
        for column, data, dtype in zip(held, row, (np.int64, np.float64, np.float64, np.float64)):
            column.append(_unpack(data, dtype))
    return Roots(*map(np.concatenate, held))
