import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ndcollect.llm import exact_dedup, jaccard, line_dedup

LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "a"), (5, None), (6, ""), (7, LONG), (8, LONG), (9, LONG + "x"), (None, None)]


def brute(rows):
    out, stays = [], set()
    for i, t in rows:
        group = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        kept = i == keep and (t or "") not in stays
        if kept:
            stays.add(t or "")
        out.append((i, keep, len(group), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_exact_groups(docs_of):
    assert result(exact_dedup.groups(docs_of(ROWS))) == brute(ROWS)


def test_exact_groups_do_not_depend_on_the_hash(docs_of):
    def weak(pieces):
        return pieces.map(lambda x: b"same" if len(x) < 1000 else b"long")

    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "ef"), (5, "cd"), (6, "cd"), (7, "zz"), (8, "longer")]
    assert result(exact_dedup.groups(docs_of(rows), digests=weak)) == brute(rows)
    assert result(exact_dedup.groups(docs_of([*rows, (3, "ab"), (3, "zz"), (None, "cd")]), digests=weak)) == brute([*rows, (3, "ab"), (3, "zz"), (None, "cd")])


@pytest.mark.parametrize("parallel_bytes", [4, 5000])
def test_exact_groups_of_texts_hashed_in_parallel(docs_of, parallel_bytes):
    rows = [*ROWS, (20, LONG[:-1]), (None, LONG), (21, "é" * 40), (22, "é" * 40), (9, LONG + "x")]
    assert result(exact_dedup.groups(docs_of(rows), parallel_bytes=parallel_bytes)) == brute(rows)


def test_exact_deduplicate_keeps_columns_and_largest(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 3, 6, 8, 9], key=repr)
    odd = docs.withColumn("__key", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("data", F.lit(3))
    assert exact_dedup.deduplicate(odd).columns == odd.columns and exact_dedup.deduplicate(odd).count() == 5
    assert sorted((r.doc_id for r in exact_dedup.deduplicate(docs_of([(None, "q"), (None, "q"), (1, "r"), (1, None), (1, "")])).collect()), key=repr) == [1, 1, None]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_fingerprints_compose():
    data = random.Random(1).randbytes(50_000)
    whole = exact_dedup.fingerprint(data)
    assert whole == int.from_bytes(data, "big") % exact_dedup.PRIME == exact_dedup.fingerprint(data, 777)
    parts, at = (0, 0), 0
    for n in (1, 4000, 0, 30_000, 15_999):
        parts = exact_dedup.combine(parts, (exact_dedup.chunk_hash(data[at : at + n]), n))
        at += n
    assert parts == (whole, len(data))


def test_modulus_is_prime():
    n = exact_dedup.PRIME
    assert all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11, 13)) and pow(256, (n - 1) // 2, n) in (1, n - 1)


def test_parallel_fingerprints(docs_of):
    rows = [(1, LONG), (2, ""), (3, None), (4, "é" * 1000)]
    got = {r.doc_id: (r.n_bytes, int.from_bytes(r.fingerprint, "big")) for r in exact_dedup.fingerprint_parallel(docs_of(rows), 4096).collect()}
    assert got == {i: (len((t or "").encode()), exact_dedup.fingerprint((t or "").encode())) for i, t in rows}


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                old, new = label[a], label[b]
                label = [new if z == old else z for z in label]
    out = []
    for k, (i, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, min(members, default=None), links[k]))
    return sorted(out, key=repr)


def near_rows(groups, copies, seed):
    rng = random.Random(seed)
    rows = [(900_000, None), (900_001, " \n "), (900_002, "one two"), (900_003, "One  two"), (None, "one two"), (900_004, "one two three")]
    k = 0
    for _ in range(groups):
        base = words(rng, 120).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + j, words(rng, 60)) for j in range(40)]
    return [*rows, rows[7]]


@pytest.mark.parametrize("groups,copies,bucket", [(30, 4, 1000), (1, 120, 20)])
def test_jaccard_against_brute_force(docs_of, groups, copies, bucket):
    rows = near_rows(groups, copies, groups)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(docs_of(rows), bucket=bucket).collect()), key=repr)
    want = brute_links(rows)
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want]
    assert got == want


def test_jaccard_deduplicate(docs_of):
    t = words(random.Random(3), 100)
    docs = docs_of([(4, t), (2, t + " more"), (3, t), (8, "other"), (None, t), (9, None)])
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 8, 9}
    odd = docs_of([(4, t), (4, t), (4, "something else"), (5, t), (None, t), (None, "no id"), (None, "no id"), (6, None), (6, None)]).withColumn("__gone", F.lit(1)).withColumn("node", F.lit(2))
    left = jaccard.deduplicate(odd)
    assert left.columns == odd.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(4, t), (4, "something else"), (None, "no id"), (6, None), (6, None)], key=repr)
    assert jaccard.links(docs.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.999, 0.8, 3) >= 14 and jaccard.survival(0.8, 1) > jaccard.survival(0.8, 3) > 0.3


def brute_lines(rows):
    w, d, p = line_dedup.WINDOW, line_dedup.DIVISOR, line_dedup.MODULUS
    docs = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        cuts = [0, *(k + 1 for k in range(len(lines)) if k == len(lines) - 1 or sum(h[k - j] * pow(line_dedup.BASE, j, p) for j in range(w) if k >= j) % p % d)]
        docs[i, t or ""] = lines, list(zip(cuts[:-1], cuts[1:]))
    rank = lambda doc: ((doc[0] is not None, doc[0] or 0), doc[1])
    places = sorted(((doc, k) for doc, (_, chunks) in docs.items() for k in range(len(chunks))), key=lambda x: (*rank(x[0]), x[1]))
    first, gone = {}, {doc: set() for doc in docs}
    for doc, k in places:
        lines, chunks = docs[doc]
        a, b = chunks[k]
        other, j = first.setdefault("\n".join(lines[a:b]), (doc, k))
        if (other, j) == (doc, k):
            continue
        theirs, c = docs[other][0], docs[other][1]
        up = down = 0
        while k and j and up < min(a - chunks[k - 1][0], c[j][0] - c[j - 1][0]) and lines[a - up - 1] == theirs[c[j][0] - up - 1]:
            up += 1
        while k + 1 < len(chunks) and j + 1 < len(c) and down < min(chunks[k + 1][1] - b, c[j + 1][1] - c[j][1]) and lines[b + down] == theirs[c[j][1] + down]:
            down += 1
        run = lines[a - up : b + down]
        if len(run) > 1 and "".join(run).strip(" \t\n\r"):
            gone[doc] |= set(range(a - up, b + down))
    return sorted(((i, "\n".join(x for k, x in enumerate(docs[i, t or ""][0]) if k not in gone[i, t or ""]), len(gone[i, t or ""])) for i, t in rows), key=repr)


def test_lines_against_brute_force(docs_of):
    rng = random.Random(5)
    passage = [words(rng, 12) for _ in range(14)]
    rows = [(i, "\n".join([words(rng, 8) for _ in range(rng.randrange(6))] + passage[: rng.randrange(5, 14)] + [words(rng, 5)])) for i in range(20)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n".join(["same"] * 400)), (104, "\n".join(["same"] * 400)), (None, "\n".join(passage)), rows[0], (105, "x" * 200_000)]
    docs = docs_of(rows)
    got = sorted(((r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.deduplicated(docs).collect()), key=repr)
    assert got == brute_lines(rows) and any(n > 0 for *_, n in got)
    before = {line for _, t in rows for line in (t or "").split("\n")}
    assert {line for _, t, _ in got for line in t.split("\n")} | {""} == before | {""}  # of every line a copy stays
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_most_planted_passages_go(docs_of):
    """Passages of two lines or more in documents that share nothing else: all but a first copy should go."""
    rng = random.Random(11)
    passages = [[words(rng, 30) for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    rows = [(i, "\n".join([words(rng, 9) for _ in range(rng.randrange(1, 6))] + passages[i % 60] + [words(rng, 9) for _ in range(rng.randrange(1, 6))])) for i in range(180)]
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.deduplicated(docs_of(rows)).collect()}
    planted, lost = sum(len(passages[i % 60]) for i in range(60, 180)), sum(got[i] for i in range(60, 180))
    assert not any(got[i] for i in range(60)) and 0.8 * planted < lost <= planted


def test_native_operators_run_no_python(docs_of, capsys):
    line_dedup.deduplicated(docs_of([(1, "a\nb"), (2, "a\nb")])).where(F.lit(True)).explain()
    assert "Python" not in capsys.readouterr().out
