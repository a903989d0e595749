import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ndcollect.llm import ctw, langid, toxicity
from ndcollect.llm import queries as llm_queries
from ndcollect.llm.common import id_mod

SYLLABLES = {"aa": "ba ko ti lu mer dan".split(), "bb": "sch ung eit ver ich ol".split(), "cc": "eau oui ré tion ment ç".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n, seed=1):
    rng = random.Random(seed)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [(i, sentence(rng, g, rng.randrange(3, 80))) for i, g in enumerate(langs)], langs


def test_language_id_held_out_accuracy_and_rejection(docs_of):
    rows, langs = corpus(300)
    extra = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "ЖЩЪ ЫЭЮ ЖЖЩ ЪЫЭ ЮЖЩ " * 30), (1004, rows[0][1] * 2000), (None, rows[0][1])]
    docs = docs_of(rows + extra, langs + [None] * len(extra))
    model = langid.fit(docs, ~langid.held_out(5))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    test = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == langs[i] for i in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(got[i].rejected for i in test) <= 0.03 * len(test)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1002].score == 0 and got[1002].rejected
    assert got[1003].rejected and got[1004].lang_pred == langs[0] == got[None].lang_pred
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {1000, 1001, 1002, 1003} & {r.doc_id for r in kept.collect()}


def test_language_id_without_labels(docs_of):
    docs = docs_of([(1, "abc"), (2, None)], [None, None])
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in got} == {"und"} and langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def test_kneser_ney_is_a_distribution():
    rows, langs = corpus(40)
    key, starts, _ = langid.grams([t for (_, t), g in zip(rows, langs) if g == "aa"])
    model = langid.build({"aa": np.unique(np.delete(key, starts), return_counts=True)})
    symbols = model.keys[0]
    context = key[10] >> np.uint64(langid.BITS)  # four symbols
    total = 0.0
    for s in symbols:
        q, log, n = (context << np.uint64(langid.BITS) | s) & np.uint64((1 << 60) - 1), 0.0, langid.ORDER
        while True:
            i = np.searchsorted(model.keys[n - 1], q)
            if i < len(model.keys[n - 1]) and model.keys[n - 1][i] == q:
                log += model.logp[n - 1][i][0]
                break
            c = q >> np.uint64(langid.BITS)
            i = np.searchsorted(model.keys[n - 2], c)
            if i < len(model.keys[n - 2]) and model.keys[n - 2][i] == c:
                log += model.back[n - 2][i][0]
            n -= 1
            q &= np.uint64((1 << langid.BITS * n) - 1)
        total += math.exp(log)
    assert 0.9 < total < 1 + 1e-4  # the rest is for symbols never seen


def brute_kneser_ney(texts, order=5):
    """Log probabilities of a model of code sequences, by dictionaries: probability(context, symbol) and the symbols."""
    counts = Counter()
    for t in texts:
        for i in range(1, len(t)):
            counts[tuple(([0] * order + t)[i : i + order + 1][-order:])] += 1
    levels = [counts]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts = []
    for level in levels:
        n1, n2 = (sum(c == k for c in level.values()) for k in (1, 2))
        discounts.append(min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 else 0.5)

    def p(context, symbol, n, total_symbols):
        if n == 0:
            return 1 / total_symbols
        own = {g: c for g, c in levels[n - 1].items() if g[:-1] == context}
        lower = p(context[1:], symbol, n - 1, total_symbols)
        if not own:
            return lower
        total, d = sum(own.values()), discounts[n - 1]
        return (max(own.get((*context, symbol), 0) - d, 0) + d * len(own) * lower) / total

    return p


def test_kneser_ney_against_dictionaries():
    rng = random.Random(9)
    learned = [sentence(rng, "aa", 6) for _ in range(12)] + ["日本語の文 ひらがな", "漢字 日本 a 文"]
    asked = [learned[0], sentence(rng, "aa", 4), sentence(rng, "cc", 3), "a", "Ba-ba 7 ko", "日本a 語-文", "中"]

    def codes(t):  # runs of anything but letters are one 0
        (fold, second, _), out = langid._fold(), [0]
        for x in (int(x) for c in t for x in (fold[ord(c)], second[ord(c)])[: 1 + (second[ord(c)] > 0)]):
            if x or out[-1]:
                out.append(x)
        return out

    key, starts, _ = langid.grams(learned)
    model = langid.build({"aa": np.unique(np.delete(key, starts), return_counts=True)})
    p = brute_kneser_ney([codes(t) for t in learned])
    h, n, _ = model.entropy(asked)
    for t, got, m in zip(asked, h[:, 0], n):
        c = codes(t)
        padded = [0] * 4 + c
        want = -sum(math.log(p(tuple(padded[i : i + 4]), padded[i + 4], 5, model.symbols)) for i in range(1, len(c)))
        assert m == len(c) - 1 and got == pytest.approx(want / m, rel=1e-4)


def test_no_two_letters_share_their_symbols():
    first, second, letter = langid._fold()
    low = np.array([ord(chr(i).lower()[0]) for i in np.flatnonzero(letter)])
    codes = first[letter].astype(np.int64) << 16 | second[letter]
    assert len(np.unique(codes)) == len(np.unique(low)) and first.max() < langid.SYMBOLS


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def brute_ctw(train, texts, depth):
    """Weighted trees by plain recursion over dictionaries."""
    counts = Counter()

    def walk(text):
        data = bytes([255]) * depth + text + b"\xff"
        for i in range(depth, len(data)):
            yield data[i - depth : i][::-1], data[i]

    for t in train:
        for context, byte in walk(t):
            for d in range(depth + 1):
                for k in range(8):
                    counts[context[:d], (byte | 256) >> (8 - k), byte >> (7 - k) & 1] += 1
    nodes = {(c, p) for c, p, _ in counts}
    children = {}
    for c, p in nodes:
        if c:
            children.setdefault((c[:-1], p), []).append((c, p))
    memo = {}

    def weight(node):
        if node not in memo:
            own = kt(counts[(*node, 0)], counts[(*node, 1)])
            memo[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weight(x) for x in children.get(node, []))) - math.log(2)
        return memo[node]

    def bit(context, p, b, d=0):
        node = (context[:d], p)
        n = counts[(*node, 0)], counts[(*node, 1)]
        own = (n[b] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        share = math.exp(kt(*n) - math.log(2) - weight(node)) if node in nodes else 0.5
        return share * own + (1 - share) * bit(context, p, b, d + 1)

    return [sum(math.log10(bit(c, (y | 256) >> (8 - k), y >> (7 - k) & 1)) for c, y in walk(t) for k in range(8)) for t in texts]


@pytest.mark.parametrize("group", [256, 3])
def test_ctw_against_plain_recursion(docs_of, monkeypatch, group):
    monkeypatch.setattr(ctw, "GROUP", group)
    rows, _ = corpus(60, 4)
    rows += [(100, None), (101, ""), (102, "ÄÖ é\t\n xyz"), (103, "Aa aA \x0b q"), (None, "null id"), rows[3]]
    docs = docs_of(rows)
    got = {(r.doc_id, r.n_bytes): r for r in ctw.score(docs, id_mod("doc_id", 7) != 2, block_bytes=2000).collect()}
    learn = [(t or "").encode() for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, s in zip(rows, texts, brute_ctw(learn, texts, ctw.DEPTH)):
        assert got[i, len(t)].score == pytest.approx(s, rel=1e-4)
    count = Counter(w for t in learn for w in [*t.lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    for (i, _), t in zip(rows, texts):
        tokens = [*t.lower().split(), b" "]
        r = got[i, len(t)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in tokens))


def test_lm_scoring_scores_the_tokens_that_the_base_scores(docs_of, spark, tmp_path):
    rows, _ = corpus(60, 4)
    odd = [(i, t.encode().upper().decode().replace(" ", "\t \n") + "\x0b" if zlib.crc32(str(i).encode()) % 7 == 2 else t) for i, t in rows] + [(200, None), (201, " \n")]
    docs_of(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in llm_queries.op7_lm_scoring(spark, str(tmp_path)).collect()}
    texts = [b" ".join((t or "").encode().lower().split()) for _, t in odd]
    learn = [t for (i, _), t in zip(odd, texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    for (i, t), s in zip(odd, brute_ctw(learn, texts, ctw.DEPTH)):
        assert got[i].score == pytest.approx(s, rel=1e-4) and got[i].n_bytes == len((t or "").encode())
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 4 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_ctw_is_finite_after_very_many_equal_bits():
    key, byte = np.array([0x6162000000000061], np.uint64) >> np.uint64(8 * (7 - ctw.DEPTH)), int("61", 16)
    key = (key & ~np.uint64(255)) | np.uint64(byte)
    latest = int(key[0]) >> (8 * (ctw.DEPTH - 1))
    node = np.array([latest << 8 | (byte | 256) >> (8 - k) for k in range(8)])
    n1 = np.where(np.arange(8) == 0, 1 << 26, 1)  # never a zero in the first bit, which is the key's
    roots = ctw.Roots(node, np.full(8, -1e9), np.where(np.arange(8) == 0, 0, 1), n1)
    assert -30 < roots.log10(key, np.full((1, 8), 1e-8, np.float32))[0] < -7


def test_ctw_of_next_to_nothing(docs_of):
    docs = docs_of([(1, "abc"), (2, None)])
    assert ctw.score(docs, id_mod("doc_id", 7) == 99).count() == 2
    assert ctw.score(docs.limit(0), id_mod("doc_id", 7) != 2).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 10, 1e3, 1e9])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


BAD = ["idiot", "moron", "scum"]


def toxic_corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.choice(list(SYLLABLES)), 30).split()
        y = int(rng.random() < 0.3)
        if y:
            w[rng.randrange(len(w))] = rng.choice(BAD) if rng.random() < 0.7 else "lowei" + rng.choice(SYLLABLES["bb"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity_held_out_and_obfuscation(spark, docs_of):
    rows, labels = toxic_corpus(900)
    odd = [(2000, "ko ti 1d10t lu"), (2001, "ko ti i d i o t lu"), (2002, "you m.o.r.o.n!"), (2003, "scuuuum ba"), (2004, None), (2005, ""), (2006, "ba ko ti " * 5000), (None, "idiot")]
    docs = docs_of(rows + odd)
    table = spark.createDataFrame([*labels, (2000, 1, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(docs, table, ~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score(docs, scorer).collect()}
    test = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == labels[i][2] for i in test) >= 0.97 * len(test)
    assert [got[i].predicted for i in (2000, 2001, 2002, 2003, None)] == [1] * 5
    assert [got[i].predicted for i in (2004, 2005, 2006)] == [0] * 3 and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_with_one_class(spark, docs_of):
    docs = docs_of([(1, "abc"), (2, None)])
    for rows in ([], [(1, 1, 0)]):
        scorer = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert {r.score for r in toxicity.score(docs, scorer).collect()} == {0.0}


def test_toxicity_learns_from_every_labelled_text(spark, docs_of):
    """Over 8,000 clean and 3,000 toxic texts: letters, weights and the fit by plain loops over all of them."""
    rows, labels = toxic_corpus(12_500)
    rows = [(i, " ".join(t.split()[-8:])) for i, t in rows]
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(docs, table)
    distinct = {}
    for (_, t), (_, _, y) in zip(rows, labels):
        distinct[t] = max(y, distinct.get(t, 0))
    apart = {r.text for r in docs.selectExpr("text", "pmod(xxhash64(text), 4) = 0 AS apart").where("apart").collect()}
    learned = {t: y for t, y in distinct.items() if t not in apart}
    assert sum(y == 0 for y in distinct.values()) > 8000
    words = Counter(c for t in learned for c in map(toxicity._plain, t.lower().split()) if c.isalpha() and not toxicity._REPEAT.search(c))
    assert scorer.characters.counts == toxicity.CharacterModel(words).counts

    reader, n = toxicity.Scorer(scorer.characters), (Counter(), Counter())
    for t, y in learned.items():
        n[y].update({f for w in reader.restored(t) for f in toxicity.features(w)})
    m = Counter(learned.values())
    weights = {f: np.log((k + 0.5) / (m[1] + 1)) - np.log((n[0][f] + 0.5) / (m[0] + 1)) - np.sqrt(1 / (k + 0.5) + 1 / (n[0][f] + 0.5)) for f, k in n[1].items() if k >= 6}
    weights = {f: w for f, w in weights.items() if w > 2}
    assert scorer.weights.keys() == weights.keys() and all(abs(scorer.weights[f] - w) < 1e-9 for f, w in weights.items())

    x = toxicity._terms(np.array([scorer.evidence(t) for t in distinct if t in apart]))
    y = np.array([distinct[t] for t in distinct if t in apart], float)
    shares = Counter(y for _, _, y in labels)
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    beta, p = np.array(scorer.fit), 1 / (1 + np.exp(-np.clip(x @ np.array(scorer.fit), -30, 30)))
    assert np.abs(x.T @ (weight / weight.mean() * (y - p)) - 0.05 * beta).max() < 1e-3  # no slope is left


def all_readings(token, model):
    """The best score of the full lattice, path by path, and its readings."""
    paths = {(toxicity._EDGE, ""): 0.0}  # the whole text before a place, and its reading
    for c in token:
        letters = ([(c, toxicity._SAME)] if c.isalpha() else []) + [(x, toxicity._LOOK) for x in toxicity.LEET.get(c, "")]
        following = {}
        for (text, out), s in paths.items():
            offers = [(text + x, out + x, s + cost + model.log(text[-3:], x)) for x, cost in letters]
            offers += [(text, out, s + toxicity._AGAIN) for x, _ in letters if out and out[-1] == x]
            if c in toxicity.SEPARATORS or c in toxicity.LEET and not c.isalnum() or not letters:
                offers.append((text, out, s + toxicity._DROP))
                if out and c in toxicity.SEPARATORS and text[-1] != " ":
                    offers.append((" ", out + " ", s + toxicity._BREAK + model.log(text[-3:], " ")))
            for t, o, v in offers:
                following[t, o] = max(following.get((t, o), -1e9), v)
        paths = following
    ends = [(s + model.log(t[-3:], " "), o.strip()) for (t, o), s in paths.items()]
    return {o for s, o in ends if s > max(ends)[0] - 1e-9}


def test_decoder_finds_the_best_path_of_the_full_lattice():
    rng = random.Random(4)
    model = toxicity.CharacterModel(Counter({"".join(rng.choice("aeioubdgklmnst") for _ in range(rng.randrange(3, 9))): rng.randrange(1, 50) for _ in range(400)}))
    tokens = ["".join(rng.choice("*#%&*#15bdkt.@") for _ in range(6)) for _ in range(60)] + ["b**d#&t", "m**#n", "s**%&k"]
    assert [t for t in tokens if toxicity.decode(t, model) not in all_readings(t, model)] == []


def test_hidden_spellings_are_hits():
    model = toxicity.CharacterModel(Counter({"idiot": 50, "stupid": 50, "ass": 50, "the": 500, "upon": 90, "that": 90, "is": 200, "it": 200, "so": 90, "hello": 40}))
    scorer = toxicity.Scorer(model, {"=idiot": 5.0, "^idio": 4.0, "=stupid": 5.0, "^stupi": 4.0, "=ass": 5.0})
    hidden = ["stuupid", "a$$", "$$tupid", "*diot", "idio*", "idio!", "i d i o t", "i  d  i  o  t", "i . d . i . o . t", "st upid", "stup id", "st up id", '"$$tupid",']
    assert [t for t in hidden if scorer.evidence(f"so {t} that it")[0] == 0] == []
    assert [t for t in ["hello!", "so it is the st", "(hello) that!", "i. it, a is", "idio", "as it is", "$5 *the*", "upon id"] if scorer.evidence(t)[0] > 0] == []


def test_decoder_reads_what_is_hidden():
    model = toxicity.CharacterModel(Counter({"idiot": 5, "the": 50, "moron": 3, "loser": 4, "that": 9}))
    hidden = {"1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiooot": "idiot", "l0s3r": "loser", "m*r*n": "moron", "plain": "plain"}
    assert {w: toxicity.decode(w, model) for w in hidden} == hidden
