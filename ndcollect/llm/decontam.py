"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton accepts every run of consecutive words of any item. Each document streams its words through
it; the state and the matched length say, at every word, the longest run of words ending there that some
item contains. A run of ``window`` words (or a whole item that is shorter) is a hit.

The test items are a stated query set: they are dealt into blocks of at most ``block_words`` words, one
automaton is built and broadcast for each block, so what is broadcast is bounded whatever the benchmark's
size; an item larger than a block is cut into pieces that overlap by a window less one word. With one block
the documents are read once and not shuffled. With several, every document gets a number, each block reads them
again and writes the numbers, spans and items of those it hits, and these meet the documents in one merge join.

Defined cases: a null or empty text has no words and is clean; an item without words matches nothing;
rows of one item id count as one item; rows with a null item id are one item without an id: their windows hit
and count, but add nothing to the ids; equal items with different ids are all reported; extra columns of the
inputs, whatever their names, are ignored by ``match`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, modest_batches, text_of, tidy, unused

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 65 <= b <= 90 or b in _WORD else 32 for b in range(256))
_WORD_SPAN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NAMELESS = ""  # in place of a null item id; ids are kept behind a "=" meanwhile


def words_of(text: str | None) -> list[bytes]:
    """Words of lower-cased text: runs of digits, letters and whatever is beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """Of many word sequences at once. States are numbered; 0 is the start."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = array("i", [-1])
        self.length = array("i", [0])
        owners: list[set[str]] = [set()]
        short: dict[int, dict[int, set[str]]] = {}
        whole: list[tuple[str, list[int]]] = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                whole.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w, owners)
                    owners[last].add(item)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):  # an item that owns a state owns what its suffix link leads to
            if self.length[s] >= window and self.link[s] > 0 and self.length[self.link[s]] >= window:
                owners[self.link[s]] |= owners[s]
        for item, ids in whole:
            if len(ids) < window:
                s = 0
                for w in ids:
                    s = self.next[s][w]
                short.setdefault(s, {}).setdefault(len(ids), set()).add(item)
        #: By state: the state of its last ``window`` words (-1: shorter), and the short items that end with it.
        self.top = array("i", [-1] * len(self.next))
        self.ends: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.top[s] = s if self.length[up] < window else self.top[up]
            self.ends[s] = self.ends[up] + tuple((m, tuple(sorted(x))) for m, x in sorted(short.get(s, {}).items()))
        self.owners = {s: tuple(sorted(owners[s])) for s in order if self.top[s] == s}

    def _new(self, length: int, owners: list[set[str]], like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        owners.append(set() if like is None else set(owners[like]))
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int, owners: list[set[str]]) -> int:
        """The state for the words of ``p`` and ``w``, parted from ``q`` where ``q`` holds longer runs too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, owners, q)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int, owners: list[set[str]]) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w, owners)
        new, p = self._new(self.length[last] + 1, owners), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][w], w, owners)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, [start, end) and apart from each other, and the items that hit."""
        window, following, link, length, top, ends = self.window, self.next, self.link, self.length, self.top, self.ends
        get = self.vocabulary.get
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[str] = set()
        s = matched = 0
        for i, w in enumerate([get(w, -1) for w in words]):
            if w < 0:
                s = matched = 0
                continue
            t = following[s].get(w)
            if t is None:
                s = link[s]
                while w not in following[s]:  # the start has every word of the vocabulary
                    s = link[s]
                matched = length[s] + 1
                s = following[s][w]
            else:
                s = t
                matched += 1
            hit = 0
            if matched >= window:
                hit = window
                states.add(top[s])
            for m, whose in ends[s]:
                if m <= matched:
                    items.update(whose)
                    hit = max(hit, m)
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for t in states:
            items.update(self.owners[t])
        return spans, items


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pack(spans: list[tuple[int, int]]) -> bytes:
    return array("q", [x for s in spans for x in s]).tobytes()


def _unpack(data: bytes | None) -> list[tuple[int, int]]:
    x = array("q", data or b"")
    return list(zip(x[::2], x[1::2]))


def _scanned(automaton: SuffixAutomaton, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    spans, items = [], []
    for text in texts:
        own, whose = automaton.scan(words_of(text.as_py()))
        spans.append(_pack(own))
        items.append(sorted(whose))
    return pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))


def _pass(block, at: int):
    """Batches with their spans and items as two more columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_scanned(block.value, batch.column(at))], names=[*batch.schema.names, *unused(batch.schema.names, "__spans", "__items")])
        tidy()

    return run


def _hits(block):
    """Numbers, spans and items of the documents that a block hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = _scanned(block.value, batch.column("text"))
            hit = pa.RecordBatch.from_arrays([batch.column("number"), spans, items], names=["number", "spans", "items"])
            yield hit.filter(pa.array([x > 0 for x in map(len, items.to_pylist())], pa.bool_()))
        tidy()

    return run


def _together(at: int):
    """Of a document's spans and items by block, the union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_pack(union_spans([s for part in found or [] for s in _unpack(part)])) for found in batch.column(at).to_pylist()]
            items = [sorted({i for part in found or [] for i in part}) for found in batch.column(at + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names[: at + 2])

    return run


def _pieces(benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """item and text of the benchmark's items, long ones in overlapping pieces, dealt into ``block``, and the number of blocks."""
    rows = benchmark.select(F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit(_NAMELESS)).alias("item"), F.split(text_of("text"), _BETWEEN).alias("w"))
    total = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    n, step = max(1, -(-total // block_words)), max(1, block_words - window + 1)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))
    cut = rows.select("item", F.posexplode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(F.col("w"), i + 1, step + window - 1)))).alias("at", "text"))
    return cut.withColumn("block", F.pmod(F.xxhash64("item", "at"), F.lit(n))), n


def match(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """doc_id, text, spans (packed pairs of word positions) and items (sorted ids behind a ``=``) of every document."""
    return _match(docs.select("doc_id", "text"), benchmark, window, block_words)


def _match(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, then=None, then_schema=None) -> DataFrame:
    """``docs`` with spans and items; ``then`` (of ``then_schema``) takes the batches of these in the same worker."""
    spark = docs.sparkSession
    modest_batches(spark)
    pieces, n = _pieces(benchmark, window, block_words)

    def block(k: int):
        rows = pieces.where(F.col("block") == k).select("item", "text").distinct().collect()
        return spark.sparkContext.broadcast(SuffixAutomaton([(r[0], words_of(r[1])) for r in rows], window))

    names = docs.columns
    spans, items, number = unused(names, "__spans", "__items", "__number")
    schema = docs.select("*", F.lit(None).cast("binary").alias(spans), F.lit(None).cast("array<string>").alias(items)).schema
    if n == 1:
        step = _pass(block(0), names.index("text"))
        return docs.mapInArrow(_chain(step, then) if then else step, then_schema if then else schema)
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "decontam-numbered")
    found: DataFrame | None = None
    for k in range(n):
        automaton = block(k)
        hits = materialize(numbered.select(F.col(number).alias("number"), "text").mapInArrow(_hits(automaton), "number long, spans binary, items array<string>"), "decontam-hits")
        automaton.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy(F.col("number").alias(number)).agg(F.collect_list("spans").alias(spans), F.collect_list("items").alias(items))  # at most one of each a block
    met = numbered.join(found.hint("merge"), number, "left").select(*(F.col(f"`{c}`") for c in (*names, spans, items)))
    step = _together(len(names))
    return met.mapInArrow(_chain(step, then) if then else step, then_schema if then else schema)


def _chain(first, second):
    return lambda batches: second(first(batches))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_hit, n_items, sha, coverage = [], [], [], [], []
        for text, spans, items in zip(batch.column(1), batch.column(2), batch.column(3)):
            n_words.append(len(words_of(text.as_py())))
            n_hit.append(sum(b - a for a, b in _unpack(spans.as_py())))
            ids = items.as_py() or []
            n_items.append(len(ids))
            sha.append(hashlib.sha256(",".join(sorted(x[1:] for x in ids if x != _NAMELESS)).encode()).hexdigest())
            coverage.append(n_hit[-1] / n_words[-1] if n_words[-1] else 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(coverage, pa.float64())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "coverage"],
        )


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit share ``coverage``."""
    fields = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, coverage double"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}"
    return _match(docs.select("doc_id", "text"), benchmark, window, block_words, _digest, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; other characters stay."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD_SPAN.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _cut_pass(at: int, width: int, chars: int | None, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts, sizes = [], [], []
            for i, (text, packed) in enumerate(zip(batch.column(at), batch.column(width))):
                spans, text = _unpack(packed.as_py()), text.as_py()
                if spans and sum(b - a for a, b in spans) > coverage * len(words_of(text)):
                    continue
                kept.append(i)
                texts.append(cut(text, spans) if spans else text)
                sizes.append(len(texts[-1]) if spans else None)
            rows = batch.take(pa.array(kept, pa.int64()))
            columns = list(rows.columns[:width])
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                old = columns[chars].to_pylist()
                columns[chars] = pa.array([o if s is None else s for o, s in zip(old, sizes)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, coverage: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """``docs`` with its columns: hit spans are cut out of ``text`` (``n_chars``, where present, follows), and a
    document of whose words more than ``coverage`` are hit goes. Clean rows come back unchanged."""
    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None
    return _match(docs, benchmark, window, block_words, _cut_pass(names.index("text"), len(names), chars, coverage), docs.schema)
