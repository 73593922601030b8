"""The stages of the corpus pipeline on planted rows, beside brute force."""

import base64

import numpy as np
import pytest

import corpus_pipeline
from scriptorium.llm import neardup, quality
from tests.llm.test_text_operators import ENGLISH, FRENCH, speech

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(list("etaoinshrdlu"), draw.integers(2, 9))) for _ in range(n)]


def changed(words, seed, n):
    out = list(words)
    for at in np.random.default_rng(seed).choice(len(out), n, replace=False):
        out[at] = f"new{seed}x{at}"
    return out


def brute_groups(texts, least=0.8):
    """id -> smallest id that chains of pairs with Jaccard similarity ``least`` reach."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def near_copies():
    """Copies with one to six changed words, boilerplate, a chain, a crowd around one text."""
    texts = []
    for k in range(12):
        base = prose(k, 200)
        texts += [" ".join(base), " ".join(base).upper(), *(" ".join(changed(base, 50 * k + n, n)) for n in (1, 3, 4, 6))]
    common = prose(99, 150)
    texts += [" ".join(common + prose(1000 + k, 100)) for k in range(50)]
    crowd = prose(77, 200)
    texts += [" ".join(changed(crowd, 3000 + k, k % 4)) for k in range(60)]
    for k in range(8):
        texts.append(" ".join(crowd))
        crowd = changed(crowd, 4000 + k, 3)
    return dict(enumerate([*texts, None, "", "  ", "a b", "A  b"]))


@pytest.mark.parametrize("bucket", [2, 32])
def test_near_copies_of_changed_words_go(spark, bucket):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS).repartition(3)
    want = set(brute_groups(texts).values())
    kept = neardup.drop_copies(docs, text="text", groups=neardup.similar_groups, bucket=bucket)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    if bucket == 32:
        kept = corpus_pipeline.distinct(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("bucket,block", [(4, 3), (8, 16), (32, 256)])
def test_a_crowd_of_partly_similar_texts(spark, bucket, block):
    """Hundreds of texts around one, many under 0.8 to each other: buckets far above ``bucket``, in grids of blocks."""
    base = prose(5, 120)
    texts = {i: " ".join(changed(base, 7000 + i, 1 + i % 7)) for i in range(220)}
    texts |= {1000 + i: " ".join(prose(400 + i, 90)) for i in range(40)} | {2000: None, 2001: "", 2002: " ".join(base)}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS).repartition(4)
    ids, groups = neardup.similar_groups(docs, doc_id="doc_id", text="text", bucket=bucket, block=block)
    got = {r["doc_id"]: r["first"]["doc_id"] for r in ids.join(groups, "code").select("doc_id", "first").collect()}
    assert got == brute_groups(texts)


def test_joining_links_join_what_all_pairs_would():
    draw = np.random.default_rng(2)
    for n in range(60):
        base = np.unique(draw.integers(-(1 << 62), 1 << 62, 40))
        sets = [np.unique(np.concatenate((draw.choice(base, draw.integers(30, 41), replace=False), draw.integers(0, 99, draw.integers(0, 6))))) for _ in range(14)] + [np.empty(0, np.int64)]
        codes, labels = np.arange(15) * 3 - 7, np.where(draw.random(15) < 0.3, 1, np.arange(15) + 50)
        firsts = int(draw.integers(0, 16))
        links = neardup.joining_links(codes, labels, sets, firsts, 0.8)
        def groups(pairs):
            own = labels.tolist()
            for i, j in pairs:
                own = [own[i] if x == own[j] else x for x in own]
            return [[a == b for b in own] for a in own]
        alike = [(i, j) for i in range(firsts) for j in range(15) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        at = {c: i for i, c in enumerate(codes.tolist())}
        assert groups([(at[a], at[b]) for a, b in links]) == groups(alike) and len(links) < 15


def test_bands_follow_the_ratios_of_all_texts(spark):
    """Texts of few repeated syllables lie inside the fixed limits but far from the others."""
    good = {i: " ".join(prose(i, 700)) for i in range(150)}
    draw = np.random.default_rng(1)
    syllables = ["".join(draw.choice(list("etaoin"), 2)) for _ in range(24)]
    bad = {1000 + i: " ".join("".join(draw.choice(syllables, 2)) for _ in range(800)) for i in range(12)}
    copies = {2000 + i: good[0] for i in range(300)}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in {**good, **bad, **copies}.items()] + [(9000, None, "en", "s", 1)], DOCS).repartition(3)
    fixed = quality.Compression(quality.Bands()).judge
    assert all(fixed(t.encode())[3] for t in bad.values())
    bands = quality.learn_bands(docs, text="text")
    kinds = {}
    for t in good.values():
        kinds.setdefault(quality.length_class(len(t)), []).append(quality.Compression(bands).ratio(t.encode()))
    k = max(kinds, key=lambda x: len(kinds[x]))
    low, high = np.percentile(kinds[k], [25, 75])
    gap = 2 * max(high - low, 0.01)
    found = [b[1:] for b in bands.whole if quality.length_class(b[0]) == k][-1]
    assert found == pytest.approx((low - gap, high + gap), abs=0.002)
    kept = {r["doc_id"] for r in corpus_pipeline.readable(spark, docs, "").collect()}
    assert kept == {*good, *copies}
    assert quality.learn_bands(docs.limit(0), text="text") == quality.Bands()


def test_length_classes():
    for size in range(1, 5000):
        k = quality.length_class(size)
        assert 2 ** (k / 2) <= size * (1 + 1e-12) and size < 2 ** ((k + 1) / 2) * (1 + 1e-12)


def test_noise_and_untaught_languages_go(spark):
    draw = np.random.default_rng(4)
    rows = [(i, speech("fr" if i % 3 else "en", i), ("fr" if i % 3 else "en") if i % 5 else None, "s", 1) for i in range(300)]
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem"
    junk = [base64.b64encode(draw.bytes(400)).decode(), "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz   "), 600)), polish, "все люди рождаются свободными", "12 34 !!", "", None]
    rows += [(1000 + i, t, "en" if t == "" else None, "s", 1) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()} == set(range(300))


def test_the_end_of_a_text_is_a_chunk_too():
    judge = quality.Compression(quality.Bands()).judge
    good = " ".join(prose(5, 500)).encode()
    assert judge(good[:1024])[1:] == (1, 0, True) and judge(good[:1023])[1:] == (0, 0, True)
    ratio, chunks, bad, passes = judge(good[:1400] + b"ab " * 200)
    assert 0.36 <= ratio <= 0.74 and (chunks, bad, passes) == (2, 1, False)
    assert judge(good[:2000])[1:] == (2, 0, True) and judge(good[:2048])[1:] == (2, 0, True)


def test_stages_keep_odd_rows_and_columns(spark):
    """Clashing columns, repeated rows, null ids; each stage beside a plain loop over its rows."""
    def said(n):
        return " ".join(np.random.default_rng(n).choice((FRENCH if n % 2 else ENGLISH).split(), 60))

    schema = DOCS + ", detected string, quality int"
    rows = [(i, said(i), "fr" if i % 2 else "en", "s", 1, "d", 2) for i in range(40)]
    rows += [rows[0], (None, said(50), None, None, None, None, None), (100, "a " * 100, "en", "s", 1, "d", 2), (101, None, "en", "s", 1, "d", 2)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    known = corpus_pipeline.known_language(spark, docs, "")
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} >= {*range(40), None} and 101 not in {r["doc_id"] for r in known.collect()}
    good = corpus_pipeline.readable(spark, known, "")
    judge = quality.Compression(quality.learn_bands(known, text="text")).judge
    want = [r for r in known.collect() if not quality.base_fails(quality.measures(r["text"].encode())) and judge(r["text"].encode())[3]]
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == sorted(map(str, want)) and 100 not in {r["doc_id"] for r in want} and len(want) > 30
    once = corpus_pipeline.distinct(spark, good, "")
    assert once.columns == docs.columns
    numbered = {-1 if r["doc_id"] is None else r["doc_id"]: r["text"] for r in want}
    assert once.count() == len(set(brute_groups(numbered).values()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.packed(spark, once, "").select("doc_id").distinct().count() == once.select("doc_id").distinct().count()


def test_near_copies_meet_by_their_fingerprints_too(spark):
    """With bands that no two different texts share, the groups of SimHash fingerprints are what is left; links are verified."""
    base = prose(11, 900)
    near = " ".join([*base[:-1], "other"])
    short = " ".join(prose(12, 20))
    texts = {1: " ".join(base), 2: near, 3: near + " " + near, 4: short, 5: None}
    assert (neardup.simhash(texts[1].encode(), 5) ^ neardup.simhash(near.encode(), 5)).bit_count() <= 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    kept = neardup.drop_copies(docs, text="text", groups=neardup.similar_groups, bands=1, rows=5000)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(texts).values()))
    assert 2 not in {r["doc_id"] for r in kept.collect()}
