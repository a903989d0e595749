"""Toxicity scores of texts restored by a noisy-channel decoder.

Writers hide words: ``1d10t`` (look-alikes), ``i d i o t``, ``i.d.i.o.t`` or ``st upid`` (spacing), ``idiooot``
(repetition), ``$$tupid`` or ``idio*`` (marks at the ends). A suspicious token or run of single characters
becomes a lattice: each character may stand for itself, for letters that it looks like, for nothing (a
separator), or repeat the letter before it. Viterbi decoding under a character 4-gram model picks the likeliest
reading of all: every context is kept. Tokens of plain letters of which no two neighbours are equal have one
path and need no decoding; equal tokens are decoded once a task. Neighbouring tokens, all short but for one,
are read as one word, too, where a known beginning runs over their border.

Restored words and their beginnings (4 to 8 letters, for stems with changing endings) are weighed by the
lower bound of their log odds between toxic and clean texts. A document has its strongest hit and the sum of
its others; a logistic fit on rows set aside turns them into a probability.

Both models learn from all labelled rows (equal texts once): every count is one of whole texts, summed over all
tasks. What is broadcast follows the alphabet (runs of up to four letters) and the features that tell toxic from
clean texts, not the rows. Toxic texts are decoded whole. Clean ones are counted twice: first words as they are
written, which bounds a feature's weight from above; then with the lattices that may spell a feature which that
bound leaves. Scoring is one narrow pass over whole texts. There, too, a lattice none of whose paths spells the
beginning of a weighed feature is left undecoded: no reading of it could be a hit.

Defined cases: null and empty texts have no hits and get the score of a text without any; rows without a label, with a
null label or a null id are not learned from; a doc_id that is labelled twice counts as toxic if any label
says so; without both classes to learn from, every score is the toxic share; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, discard, fewer, id_mod, materialize, merged, modest_batches, scratch, text_of, tidy

#: Look-alikes: what a character may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou"}
SEPARATORS = set(" .-_*~'`,:;/\\|^\"·•")
_STRIP = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»“”„‘’…–—"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!+|])(?:[ .\-_*~,:;/]+(?:[^\W_]|[@$!+|])){2,}(?!\w)")
_BETWEEN = re.compile(r"([ .\-_*~,:;/])[ .\-_*~,:;/]+")
_REPEAT, _DOUBLED = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
_SHORT, _PIECES, _JOINED = 3, 8, 5  # letters of a short piece, pieces of a parted word, letters of a beginning that shows one
_ORDER = 4
_EDGE = " "
_HELD, _LETTERS = 200_000, 1 << 19  # counts that a task holds before it hands them on, and letters of words whose runs it counts at once


def letter_grams(words: Counter[str]) -> Counter[str]:
    """Counts of the runs of one to four letters (with edges) of words."""
    longest: Counter[str] = Counter()  # the longest run up to each letter; the others are its ends
    for word, n in words.items():
        w = _EDGE + word + _EDGE
        for i in range(2, len(w) + 1):
            longest[w[max(0, i - _ORDER) : i]] += n
    out: Counter[str] = Counter()
    for run, n in longest.items():
        for k in range(len(run)):
            out[run[k:]] += n
    return out


class CharacterModel:
    """Interpolated absolute-discounting n-grams of words' letters, between edges."""

    def __init__(self, words: Counter[str], discount: float = 0.6, grams: Counter[str] | None = None):
        self.counts: list[dict[str, Counter[str]]] = [{} for _ in range(_ORDER)]
        for gram, n in (letter_grams(words) if grams is None else grams).items():
            self.counts[len(gram) - 1].setdefault(gram[:-1], Counter())[gram[-1]] += n
        self.totals = [{c: (sum(x.values()), len(x)) for c, x in level.items()} for level in self.counts]
        self.letters = max(30, len(self.counts[0].get("", {})))
        self.discount = discount
        self._known: dict[tuple[str, str], float] = {}

    def log(self, context: str, letter: str) -> float:
        got = self._known.get((context, letter))
        if got is None:
            p = 1 / self.letters
            for k in range(min(_ORDER - 1, len(context)) + 1):
                c = context[len(context) - k :]
                if c not in self.totals[k]:
                    break
                total, kinds = self.totals[k][c]
                p = (max(self.counts[k][c][letter] - self.discount, 0) + self.discount * kinds * p) / total
            if len(self._known) > 300_000:
                self._known.clear()
            got = self._known[context, letter] = math.log(max(p, 1e-12))
        return got

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}


#: Channel costs (natural logarithms).
_SAME, _LOOK, _DROP, _AGAIN, _BREAK = -0.05, -1.0, -0.7, -0.4, -2.0


_options: dict[str, tuple[tuple[tuple[str, float], ...], bool, bool]] = {}


def _stands_for(c: str) -> tuple[tuple[tuple[str, float], ...], bool, bool]:
    """The letters that a character may stand for and their costs, whether it may stand for nothing, and whether it may part words."""
    got = _options.get(c)
    if got is None:
        letters = (((c, _SAME),) if c.isalpha() else ()) + tuple((x, _LOOK) for x in LEET.get(c, ""))
        got = _options[c] = letters, c in SEPARATORS or c in LEET and not c.isalnum() or not letters, c in SEPARATORS
    return got


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest reading of an obfuscated token: letters, and spaces where separators part words.

    Linear in the token's length: a path is its latest letters and a chain of cells (before, letter), and the
    best path to each context of three letters is kept. A character stands for five letters at most, so the
    contexts are some hundreds where marks stand side by side, and a few elsewhere.
    """
    log = model.log
    states: dict[str, tuple[float, tuple | None]] = {_EDGE: (0.0, None)}
    for c in token:
        letters, dropped, parts = _stands_for(c)
        following: dict[str, tuple[float, tuple | None]] = {}
        for context, (score, path) in states.items():
            offers = [((context + x)[1 - _ORDER :], score + cost + log(context, x), (path, x)) for x, cost in letters]
            if path:
                offers += [(context, score + _AGAIN, path) for x, _ in letters if path[1] == x]
                if parts and context[-1] != _EDGE:
                    offers.append((_EDGE, score + _BREAK + log(context, _EDGE), (path, _EDGE)))
            if dropped:
                offers.append((context, score + _DROP, path))
            for key, s, way in offers:
                if key not in following or following[key][0] < s:
                    following[key] = (s, way)
        states = following
    _, path = max(((s + log(context, _EDGE), way) for context, (s, way) in states.items()), key=lambda x: x[0], default=(0.0, None))
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out)).strip()


def _plain(token: str) -> str:
    return token.strip(_STRIP)


def suspicious(core: str) -> bool:
    """Whether a stripped, lower-cased token has more than one path: look-alikes or marks among letters, or repeats."""
    if core.isalpha():
        return _DOUBLED.search(core) is not None
    return any(c.isalpha() for c in core)


@dataclass
class Scorer:
    characters: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    fit: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    rate: float = 0.0
    _words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    _hits: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)
    _starts: set[str] | None = None
    _begun: set[str] | None = None
    _fours: set[str] | None = None
    _paths: tuple[set[str], set[str]] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_words": {}, "_hits": {}, "_starts": None, "_begun": None, "_fours": None, "_paths": None}

    def forget(self) -> None:
        """Drop what was looked up: a worker that keeps the scorer needn't keep its words."""
        self._words.clear()
        self._hits.clear()
        self.characters._known.clear()
        tidy()

    def may_hit(self, token: str) -> bool:
        """Whether any path of a token's lattice spells a weighed feature from the beginning of a word on."""
        if self._paths is None:
            ends = {f[1:] for f in self.weights}
            self._paths = {e[:k] for e in ends for k in range(1, len(e) + 1)}, ends
        begun, ends = self._paths
        states = {""}
        for c in token:
            letters, dropped, parts = _stands_for(c)
            following = set(states) if dropped else set()
            if parts:
                following.add("")
            for s in states:
                for x, _ in letters:
                    if s[-1:] == x:
                        following.add(s)
                    if (longer := s + x) in begun:
                        if longer in ends:
                            return True
                        following.add(longer)
            if not following:
                return False
            states = following
        return False

    def _decoded(self, token: str) -> list[str]:
        return [] if self.weights and not self.may_hit(token) else decode(token, self.characters).split()

    def restore(self, token: str) -> tuple[str, ...]:
        """Readings of a token: without its marks at the ends, and decoded where it is suspicious. Once features
        are weighed, decoded readings that can't be among them are left out."""
        core = _plain(token)
        if not core:
            return ()
        got: tuple[str, ...] = (core,)
        if core == token:
            return tuple(dict.fromkeys([core, *self._decoded(core)])) if suspicious(core) else got
        at = token.find(core)
        ends = token[:at], token[at + len(core) :]
        edged = any(c in LEET for end in ends for c in end)  # $$tupid; other marks can only be dropped
        if edged or suspicious(core):
            got = tuple(dict.fromkeys([core, *(self._decoded(token) if edged else ()), *self._decoded(core)]))
        if ends[1][:1] in LEET:
            got += (core + ends[1][0],)  # idio*: a beginning with some letter after it
        return got

    def tokens(self, text: str) -> set[str]:
        """The distinct tokens of a text, with runs of single characters as tokens of their own."""
        low = text.lower()
        return {*low.split(), *(_BETWEEN.sub(r"\1", x) for x in _SPACED.findall(low))}

    def restored(self, text: str) -> set[str]:
        out: set[str] = set()
        for t in self.tokens(text):
            got = self._words.get(t)
            if got is None:
                if len(self._words) > 300_000:
                    self._words.clear()
                got = self._words[t] = self.restore(t)
            out.update(got)
        return out

    def hits(self, token: str) -> tuple[tuple[str, float], ...]:
        if self._fours is None:
            self._fours = {f[1:5] for f in self.weights}
        found = []
        for w in self.restore(token):
            if w[:4] in self._fours:
                best = max((self.weights[f] for f in features(w) if f in self.weights), default=0.0)
                if best > 0:
                    found.append((w, best))
        return tuple(found)

    def weighed(self, token: str) -> tuple[str, ...]:
        """The features that a token's readings have; once features are weighed, those among them."""
        if not self.weights:
            return tuple({f for w in self.restore(token) for f in features(w)})
        if self._fours is None:
            self._fours = {f[1:5] for f in self.weights}
        return tuple({f for w in self.restore(token) if w[:4] in self._fours for f in features(w) if f in self.weights})

    def joined(self, text: str) -> dict[str, float]:
        """Words parted into pieces, all short but for one at most, of which a known beginning runs over the first border."""
        if self._starts is None:
            self._starts = {f[1 : 1 + _JOINED] for f in self.weights if len(f) > _JOINED}
            self._begun = {x[:k] for x in self._starts for k in range(1, _JOINED + 1)}
        words = [w if w.isalnum() or w[0].isalnum() and w[-1].isalnum() else _plain(w) for w in text.lower().split()]
        words = [w for w in words if w]
        sizes, starts, found = list(map(len, words)), self._starts, {}
        begun = self._begun
        for i in [i for i, w in enumerate(words[:-1]) if w[:_JOINED] in begun] if starts else ():
            n = sizes[i]
            if n > _SHORT and sizes[i + 1] > _SHORT:
                continue
            w, long = words[i], n > _SHORT
            for k in range(i + 1, min(i + _PIECES, len(words))):
                if sizes[k] > _SHORT:
                    if long:
                        break
                    long = True
                w += words[k]
                if len(w) < _JOINED:
                    continue
                if w[:_JOINED] not in starts:
                    break
                best = max((self.weights[f] for f in features(w) if len(f) > max(n + 1, _JOINED) and f in self.weights), default=0.0)
                if best > 0:
                    found[w] = best
                    break
        return found

    def found(self, text: str) -> dict[str, float]:
        """The restored words of a text that count, and their weights."""
        own, known = self.joined(text), self._hits
        for t in self.tokens(text):
            got = known.get(t)
            if got is None:
                if len(known) > 300_000:
                    known.clear()
                got = known[t] = self.hits(t)
            if got:
                own.update(got)
        return own

    def evidence(self, text: str) -> tuple[float, float]:
        own = self.found(text)
        if not own:
            return 0.0, 0.0
        top = max(own.values())
        return top, math.log1p(sum(own.values()) - top)

    def score(self, texts: Iterable[str]) -> np.ndarray:
        x = _terms(np.array([self.evidence(t) for t in texts]).reshape(-1, 2))
        if not self.weights:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.fit), -30, 30)))


def features(word: str) -> Iterator[str]:
    yield "=" + word
    for k in range(4, 9):
        if len(word) > k:
            yield "^" + word[:k]


def _terms(evidence: np.ndarray) -> np.ndarray:
    """Regressors: a constant, whether there is a hit, the strongest hit, and the others."""
    top, rest = evidence[:, 0], evidence[:, 1]
    return np.column_stack([np.ones(len(top)), top > 0, top, rest])


def logistic(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], terms: int, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method: ``sums`` gives the log likelihood's gradient and information at coefficients."""
    beta = np.zeros(terms)
    for _ in range(50):
        grad, info = sums(beta)
        step = np.linalg.solve(info + ridge * np.eye(terms), grad - ridge * beta)
        beta += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _sums(rows: DataFrame, share: Column) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Gradient and information over all rows (toxic, top, rest, and how many texts have them), each text weighing ``share``."""
    x = [F.lit(1.0), (F.col("top") > 0).cast("double"), F.col("top"), F.col("rest")]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        p = rows.select("*", (F.col("n") * share).alias("w"), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("p"))
        error, spread = F.col("w") * (F.col("toxic") - F.col("p")), F.col("w") * F.col("p") * (1 - F.col("p"))
        got = list(p.agg(*[F.sum(error * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(spread * x[i] * x[j]).alias(f"h{i}{j}") for i, j in pairs]).first())
        info = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got[len(x) :]):
            info[i, j] = info[j, i] = v
        return np.array(got[: len(x)]), info

    return at


def _rows(counts: Counter[str], **fixed: int) -> pa.RecordBatch:
    """Counts as rows (key, n), with fixed numbers before them; the counter is empty then."""
    n = len(counts)
    out = pa.RecordBatch.from_arrays([*(pa.array(np.full(n, v, np.int32)) for v in fixed.values()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[*fixed, "key", "n"])
    counts.clear()
    return out


def _as_written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of letters of all texts (kind 0), and of the clean texts that have a feature in a word as it is written (kind 1)."""
    words: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    known: dict[str, tuple[str, ...]] = {}

    def runs() -> Iterator[pa.RecordBatch]:
        plain: Counter[str] = Counter()
        part, size = Counter(), 0
        for token, n in words.items():
            c = _plain(token)
            if c.isalpha() and not _REPEAT.search(c):
                plain[c] += n
        words.clear()
        for c, n in plain.items():
            part[c], size = n, size + len(c)
            if size > _LETTERS:
                yield _rows(letter_grams(part), kind=0)
                part, size = Counter(), 0
        yield _rows(letter_grams(part), kind=0)

    for batch in by_bytes(batches, "text", 1 << 20):
        for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            tokens = t.lower().split()
            words.update(tokens)
            if y:
                continue
            own: set[str] = set()
            for token in {*tokens}:
                got = known.get(token)
                if got is None:
                    if len(known) > _HELD // 2:
                        known.clear()
                    core = _plain(token)
                    got = known[token] = tuple(features(core)) if core else ()
                own.update(got)
            clean.update(own)
            if len(clean) > _HELD:
                yield _rows(clean, kind=1)
        if len(words) > _HELD:
            yield from runs()
    yield from runs()
    yield _rows(clean, kind=1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, min_texts: int = 6, least: float = 2.0) -> Scorer:
    """A scorer from all labelled rows that ``learn`` (of doc_id) admits.

    A feature is weighed if ``min_texts`` toxic texts have it and the lower bound of its log odds is above ``least``.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, learn, min_texts, least)


def _fit(docs: DataFrame, labels: DataFrame, learn: Column | None, min_texts: int, least: float) -> Scorer:
    spark = docs.sparkSession
    modest_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if learn is not None:
        known, docs = known.where(learn), docs.where(learn)
    known = materialize(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "toxic-labels")
    size = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    empty = Scorer(CharacterModel(Counter()), rate=n1 / (n0 + n1) if n0 + n1 else 0.0)
    if not n0 or not n1:
        return empty
    labelled = materialize(docs.select(F.col("doc_id"), text_of("text").alias("text")).join(known.where("toxic IN (0, 1)").hint("merge"), "doc_id").select("text", "toxic"), "toxic-labelled", "zstd")
    texts = materialize(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(4)) == 0), "toxic-texts", "zstd")
    discard(labelled)
    learned, apart = texts.where("NOT apart").select("text", "toxic"), texts.where("apart").select("text", "toxic")

    written = materialize(learned.mapInArrow(_as_written, "kind int, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "toxic-written")
    grams = written.where("kind = 0").select("key", "n").toArrow()
    scorer = Scorer(CharacterModel(Counter(), grams=Counter(dict(zip(grams["key"].to_pylist(), grams["n"].to_pylist())))), rate=empty.rate)
    m = {r[0]: r[1] for r in learned.groupBy("toxic").count().collect()}
    m0, m1 = m.get(0, 0), m.get(1, 0)

    def having(rows: DataFrame) -> DataFrame:
        """How many of the texts have a feature, decoded: any, or those weighed so far."""
        shared = spark.sparkContext.broadcast(scorer)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, counts = _of_texts(shared.value), Counter()
            for batch in by_bytes(batches, "text", 1 << 20):
                for t in batch.column("text").to_pylist():
                    counts.update(of(t))
                    if len(counts) > _HELD:
                        yield _rows(counts)
            yield _rows(counts)
            shared.value.forget()

        return rows.select("text").mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))

    def weighed(toxic: DataFrame, clean: DataFrame) -> DataFrame:
        """Features, their toxic texts and weights; a weight falls as clean texts are added."""
        a, b = F.col("n1") + 0.5, F.coalesce("n", F.lit(0)) + 0.5
        weight = F.log(a / (m1 + 1)) - F.log(b / (m0 + 1)) - F.sqrt(1 / a + 1 / b)
        return toxic.join(clean, "key", "left").select("key", "n1", weight.alias("weight")).where(F.col("weight") > least)

    toxic = having(learned.where("toxic = 1")).where(F.col("n") >= min_texts).withColumnRenamed("n", "n1")
    likely = materialize(weighed(toxic, written.where("kind = 1").select("key", "n")), "toxic-likely")
    scorer.weights = dict.fromkeys(likely.select("key").toArrow()["key"].to_pylist(), 1.0)
    if scorer.weights:
        best = weighed(likely.select("key", "n1"), having(learned.where("toxic = 0"))).toArrow()
        scorer = Scorer(scorer.characters, dict(zip(best["key"].to_pylist(), best["weight"].to_pylist())), rate=empty.rate)
    if not scorer.weights:
        return scorer
    shared = spark.sparkContext.broadcast(scorer)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            x = [shared.value.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "top", "rest"])
        shared.value.forget()

    shown = materialize(fewer(apart.mapInArrow(weigh, "toxic int, top double, rest double").groupBy("toxic", "top", "rest").agg(F.count("*").alias("n"))), "toxic-evidence")
    a = {r[0]: r[1] for r in shown.groupBy("toxic").agg(F.sum("n")).collect()}
    if len(a) < 2:
        return Scorer(scorer.characters, rate=empty.rate)
    share, mean = {0: n0 / a[0], 1: n1 / a[1]}, (n0 + n1) / (a[0] + a[1])
    scorer.fit = tuple(float(b) for b in logistic(_sums(shown, F.when(F.col("toxic") == 1, share[1] / mean).otherwise(share[0] / mean)), 4))
    return scorer


def _of_texts(scorer: Scorer) -> Callable[[str], set[str]]:
    """The features of a text, each token's looked up once."""
    known: dict[str, tuple[str, ...]] = {}

    def of(text: str) -> set[str]:
        out: set[str] = set()
        for t in scorer.tokens(text):
            got = known.get(t)
            if got is None:
                if len(known) > _HELD // 2:
                    known.clear()
                got = known[t] = scorer.weighed(t)
            out.update(got)
        return out

    return of


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), restored_hits (restored words that count, sorted)."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in merged(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            s = own.score(texts)
            found = [sorted(own.found(x)) if p >= threshold else [] for x, p in zip(texts, s)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "restored_hits"])
        own.forget()

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("restored_hits", T.ArrayType(T.StringType()))])
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, schema)


def held_out() -> Column:
    return id_mod("doc_id", 3) == 1
