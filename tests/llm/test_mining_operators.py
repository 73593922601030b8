"""Leaked evaluation cases, centroid groups, collocations."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import centroids, decontamination, phrases, queries

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CASES = "id string, raw string, expected string, spans int, digest string"


# --- decontamination ---------------------------------------------------------------------


def said_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_leaks(jobs, cases, window=10):
    windows = collections.defaultdict(set)
    for case, text in cases:
        w = said_words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(case)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in jobs:
        w, hit, names = said_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        spans, last = [], None
        for i in sorted(hit):
            if last is None or i > last + 1:
                spans.append([i, i])
            spans[-1][1] = last = i
        out.append((doc, len(w), len(hit), tuple(map(tuple, spans)), tuple(sorted(n for n in names if n is not None))))
    return sorted(out, key=str)


def leaks(spark, jobs, cases, **params):
    j = spark.createDataFrame([(d, t, 1, "x") for d, t in jobs], "doc_id bigint, raw_text string, n_words int, runs string").repartition(4)
    c = spark.createDataFrame([(i, t, "keep", 1, "x") for i, t in cases], CASES)
    found = decontamination.contamination(j, c, **params)
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(map(tuple, r["spans"])), tuple(r["case_ids"])) for r in found.collect()], key=str)


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])  # broadcast, and the way beyond it
def test_leaks_equal_brute_force(spark, limit):
    rng = random.Random(5)
    vocabulary = ["La", "cour", "a", "jugé", "que", "le", "BAIL", "est", "nul", "ß", "İx", "Ⅳ", "12", "日本"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    cases = [(f"c{i}", say(rng.choice([1, 2, 5, 9, 10, 11, 30]) if i < 6 else rng.choice([10, 12, 40]))) for i in range(14)]
    cases = [c for c in cases if len(said_words(c[1])) > 1 or c[0] == "c0"]
    cases += [("same", cases[-1][1].lower()), (None, say(15)), ("empty", ""), ("none", None), ("signs", "?!"), cases[2], ("z,é", cases[-3][1] + " fin")]
    jobs = []
    for i in range(60):
        text = say(rng.randint(0, 60))
        for _ in range(i % 3):
            words = said_words(rng.choice(cases)[1])
            at = rng.randint(0, max(len(words) - 9, 0))
            text += ", " + "-".join(words[at : at + rng.randint(7, 14)]).upper() + " | " + say(rng.randint(0, 5))
        jobs.append((i, text))
    jobs += [jobs[3], jobs[3], (3, "une autre " + (jobs[3][1] or "")), (None, jobs[4][1]), (None, None), (90, None), (91, ""), (92, "... "), (93, " ".join([cases[1][1]] * 300))]
    assert leaks(spark, jobs, cases, broadcast_bytes=limit) == brute_leaks(jobs, cases)


def test_leaks_of_empty_tables(spark):
    assert leaks(spark, [], [("a", "un deux")]) == []
    assert leaks(spark, [(1, "un deux"), (2, None)], []) == [(1, 2, 0, (), ()), (2, 0, 0, (), ())]


def test_every_shared_window_has_a_shared_fingerprint(spark):
    rng = random.Random(7)
    rows = []
    for n in range(120):
        shared = [str(rng.randint(0, 5)) for _ in range(10)]
        texts = [" ".join([str(rng.randint(0, 5)) for _ in range(rng.randint(0, 20))] + shared + [str(rng.randint(0, 5)) for _ in range(rng.randint(0, 20))]) for _ in "ab"]
        rows.append((n, *texts))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    least = lambda c: F.transform(decontamination.fingerprints(F.col(c), 10), lambda f: f["least"])
    assert df.filter(F.arrays_overlap(least("a"), least("b"))).count() == 120
    assert df.select(F.size(decontamination.fingerprints(F.lit("a b c"), 10))).first()[0] == 0


# --- centroid groups ---------------------------------------------------------------------


def brute_groups(rows, size, count, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:count]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            part = [v for (_, v), o in zip(kept, own) if o == k]
            if part:
                centres[k] = [sum(x) // len(part) for x in zip(*part)]
    last = [nearest(v) for _, v in kept]
    inertia = collections.Counter()
    for d, k in last:
        inertia[k] += d
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), tuple(centres[k])) for (i, _), (d, k) in zip(kept, last)], key=str)


def groups(spark, rows, **params):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, key string").repartition(3)
    return sorted([(*r[:5], tuple(r[5])) for r in centroids.centroid_groups(df, **params).collect()], key=str)


@pytest.mark.parametrize("size,spread", [(64, 1.0), (3, 0.02), (5, 40.0)])
def test_groups_equal_brute_force(spark, size, spread):
    rng = np.random.default_rng(size)
    middles = rng.normal(0, spread, (6, size))
    rows = [(i, (middles[i % 6] + rng.normal(0, spread / 3, size)).astype("f4").tolist()) for i in range(150)]
    rows += [rows[0], rows[0], rows[1], (None, rows[5][1]), (None, rows[5][1]), (900, None), (901, []), (902, rows[2][1][:-1]), (903, [None] * size), (904, [float("nan")] * size),
             (905, [float("inf")] * size), (906, [0.0] * size), (0, rows[7][1])]
    assert groups(spark, rows, size=size, count=7) == brute_groups(rows, size, 7, 3)


def test_groups_of_few_and_equal_vectors(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(1, [1.0, 2.0])], size=2) == brute_groups([(1, [1.0, 2.0])], 2, 16, 3)
    same = [(i, [0.5, -0.5]) for i in range(40)]
    assert groups(spark, same, size=2, count=4, rounds=2) == brute_groups(same, 2, 4, 2)
    with pytest.raises(Exception, match="too large"):
        groups(spark, [(1, [3e7, 0.0])], size=2)


def test_rounds_write_no_rows(spark, monkeypatch):
    """Every round is one pass over the same cells and vectors, so more rounds cut lineage no more often."""
    calls, real = [], centroids.checkpointed
    monkeypatch.setattr(centroids, "checkpointed", lambda df: calls.append(1) or real(df))
    rows = [(i, [i % 7 / 3, i % 5 / 2]) for i in range(60)]
    seen = []
    for rounds in (1, 3):
        calls.clear()
        assert groups(spark, rows, size=2, count=4, rounds=rounds) == brute_groups(rows, 2, 4, rounds)
        seen.append(len(calls))
    assert seen[0] == seen[1]


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-200, 200, (500, 8))
    borders = [np.quantile(vectors[:, d], np.arange(1, 16) / 16, method="lower").astype(int).tolist() for d in range(8)]
    cells = centroids.Cells(borders, vectors.min(0).tolist(), vectors.max(0).tolist())
    packed = cells.of(vectors)
    assert packed.shape == (500, 4)
    at = cells.unpacked(packed)
    for c in rng.integers(-250, 250, (9, 8)):
        low, high = cells.tables(c)
        exact = ((vectors - c) ** 2).sum(1)
        assert (sum(low[d, at[:, d]] for d in range(8)) <= exact).all() and (exact <= sum(high[d, at[:, d]] for d in range(8))).all()
    centres = rng.integers(-200, 200, (9, 8))
    open_ = cells.candidates(packed, centres)
    assert open_[np.arange(500), ((vectors[:, None] - centres) ** 2).sum(2).argmin(1)].all() and open_.sum(1).min() == 1


# --- collocations ------------------------------------------------------------------------


def brute_phrases(rows, least, most, cover=80):
    f = collections.defaultdict(collections.Counter)
    for language, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            for size in (1, 2, 3, 4):
                for i in range(len(w) - size + 1):
                    f[language or "und"][tuple(w[i : i + size])] += 1
    out = []
    for language, count in f.items():
        all_ = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in all_.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        found = []
        for p, a in all_.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < cover * a:
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        n = sum(a for p, a in count.items() if len(p) == 1)
        out += [(language, at, p.decode(), -a, l, r, n, -s) for at, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def mined(spark, rows, **params):
    df = spark.createDataFrame([(n, t, l, 3, "x") for n, (l, t) in enumerate(rows)], "doc_id bigint, raw_text string, language string, n int, chunk string").repartition(3)
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **params).collect())


def talk(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("every", [1, 3, 32])
def test_phrases_equal_brute_force(spark, every):
    rng = random.Random(every)
    words = ["La", "cour", "d'appel", "de", "Paris", "le", "bail", "É", "-", "x"]
    rows = [(rng.choice(["fr", "fr", "de", None, "und"]), talk(rng, rng.randint(0, 90), words)) for _ in range(80)]
    rows += [rows[0]] * 40 + [("fr", None), ("fr", ""), (None, " , ."), ("fr", "bail " * 3000), ("en", " ".join(rng.choice(words) for _ in range(20_000)))]
    for least, most in ((30, 2000), (3, 15)):
        assert mined(spark, rows, least=least, most=most, every=every) == brute_phrases(rows, least, most)


def test_phrases_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("fr", None), (None, "a b")]) == []


def window_of(*texts, **params):
    import pyarrow as pa

    return list(phrases.words_of(pa.array(texts, pa.string()), **params))


def test_words_do_not_depend_on_the_window():
    rng = random.Random(4)
    texts = [None, "", "A b", "c", talk(rng, 300, ["La", "é", "xy"]), "end", "x" * 500, " ", "one. TWO", "y z " * 60]
    want = [(i, w) for i, t in enumerate(texts) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOW)) for w in re.findall("[^ \t]+", p)]
    for window in (1, 7, 64, 1 << 20):
        parts = window_of(*texts, window=window)
        assert [(r, t) for p in parts for r, t in zip(p.row.tolist(), p.texts(np.arange(len(p.row)), np.arange(len(p.row))).to_pylist())] == want


def test_chunks_own_each_word_once():
    rng = random.Random(2)
    for n in [*range(1, 20), 500, 3000]:
        [words] = window_of(" ".join(str(rng.randint(0, 30)) for _ in range(n)))
        start, end, last = phrases.cut_chunks(words, 4)
        owned = [i for a, b, z in zip(start, end, last) for i in range(a, b if z else b - 3)]
        assert owned == list(range(n)) and end[-1] == n and last.tolist() == [False] * (len(last) - 1) + [True]
    text = " ".join(str(rng.randint(0, 9)) for _ in range(2000))

    def cut(t):
        [words] = window_of(t)
        start, end, _ = phrases.cut_chunks(words, 8)
        return set(words.texts(start, end - 1).to_pylist())

    assert len(cut(text) - cut("new front " + text)) <= 1  # cuts follow the content


# --- queries -----------------------------------------------------------------------------


def test_queries_give_the_contract_columns(spark):
    want = {
        "op11_winnowing_decontamination": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
        "op12_va_file_centroids": [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")],
        "op13_prefix_free_phrases": [("lang", "string"), *[(c, "bigint") for c in ("rank",)], ("phrase", "string"), *[(c, "bigint") for c in "alrn"], ("score", "bigint")],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes == columns
        assert name in queries.ORACLES
