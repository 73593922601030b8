"""Language, quality rules, near copies, pairwise quality."""

import collections

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from scriptorium.llm import language, neardup, preference, quality
from tests.llm.conftest import rows_of

FRENCH = "le compte rendu de la réunion est lu devant tous les membres et la séance est levée"
ENGLISH = "the minutes of the meeting are read before all the members and the session is closed"


def speech(lang, n):
    words = (FRENCH if lang == "fr" else ENGLISH).split()
    return " ".join(words[(n * 7 + i * i) % len(words)] for i in range(40))


def test_ngrams_by_hand():
    grams, counts = language.ngrams("Ab, ab!")
    def code(s):
        return sum(ord(c) << 21 * i for i, c in enumerate(reversed(s.replace("_", "\x01"))))
    assert dict(zip(grams.tolist(), counts.tolist())) == {code("a"): 2, code("b"): 2, code("_a"): 2, code("ab"): 2, code("b_"): 2, code("_ab"): 2, code("ab_"): 2}


def test_distance_is_out_of_place():
    own = language.ranked(*language.ngrams("aab"), 300).tolist()
    ranker = language.Ranker({"xx": own, "yy": own[::-1]}, 300)
    d = ranker.distances("aab")
    n = len(own)
    assert d[0] == 0 and d[1] == pytest.approx(sum(abs(i - (n - 1 - i)) for i in range(n)) / (n * 300))


def test_language_on_held_out_rows(spark):
    rows = [(i, speech("fr" if i % 3 else "en", i), "fr" if i % 3 else "en") for i in range(200)]
    jobs = spark.createDataFrame(rows, "doc_id bigint, raw_text string, language string")
    profiles = language.learn_profiles(jobs, sample=20)
    assert sorted(profiles) == ["en", "fr"]
    out = language.identify_language(jobs, profiles).withColumn("held", language.held_out("doc_id")).collect()
    assert {r["held"] for r in out} == {True, False}
    assert all(r["detected"]["lang_pred"] == r["language"] and 0 <= r["detected"]["score"] <= 1 for r in out)


def test_language_learns_nothing_from_held_out_rows(spark):
    jobs = spark.createDataFrame([(i, speech("en", i), "en") for i in range(80)], "doc_id bigint, raw_text string, language string")
    other = jobs.withColumn("raw_text", F.when(language.held_out("doc_id"), "zzz qqq").otherwise(F.col("raw_text")))
    assert language.learn_profiles(jobs) == language.learn_profiles(other)


def test_language_of_odd_rows(odd_jobs, no_jobs):
    profiles = language.learn_profiles(odd_jobs)
    out = language.identify_language(odd_jobs, profiles, to="shard")  # replaces a column of that name
    assert out.count() == odd_jobs.count()
    for r in out.collect():
        letters = r["raw_text"] is not None and any(c.isalpha() for c in r["raw_text"])
        assert (r["shard"]["lang_pred"] == "und") == (not letters)
    assert language.learn_profiles(no_jobs) == {}
    assert {r["detected"]["lang_pred"] for r in language.identify_language(odd_jobs, {}).collect()} == {"und"}
    assert language.identify_language(no_jobs, profiles).count() == 0


def brute_measures(text):
    raw = (text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", raw) if w]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    seen, doubled = set(), 0
    for line in raw.split("\n"):
        if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in raw), doubled, len(hit)


def test_measures_against_brute_force():
    draw = np.random.default_rng(0)
    signs = ["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\x1c", " ", "日"]
    texts = ["".join(draw.choice(signs, draw.integers(0, 200))) for _ in range(300)] + [speech("fr", 1) * 2, "a b c d e " * 3]
    for t in texts:
        assert quality.measures(t.encode()) == brute_measures(t)


def test_bands_reject_repeats_and_noise():
    judge = quality.Compression(quality.Bands()).judge
    noise = "".join(map(chr, np.random.default_rng(1).integers(33, 0x2000, 3000)))
    plain = " ".join(speech("en", i) for i in range(3))
    assert not judge(("same old line again " * 200).encode())[3] and not judge(noise.encode())[3]
    assert judge(b"") == (None, 0, 0, True)
    data = plain.encode()
    assert judge(data)[0] == len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data)


def test_chunk_limits_see_a_bad_part():
    draw = np.random.default_rng(3)
    good = " ".join("".join(draw.choice(list("etaoinshrdlu"), draw.integers(2, 9))) for _ in range(900))
    judge = quality.Compression(quality.Bands()).judge
    assert judge(good[:4096].encode())[3]
    mixed = good[:4096] + "zz " * 700
    assert judge(mixed.encode())[2] >= 2 and not judge(mixed.encode())[3]


def test_quality_of_odd_rows(odd_jobs, no_jobs):
    out = quality.quality_rules(odd_jobs, to="n").collect()
    assert len(out) == odd_jobs.count()
    for r in out:
        got = tuple(r["n"][m] for m in quality.MEASURES)
        assert got == brute_measures(r["raw_text"])
        assert r["n"]["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (r["n"]["base_failed"] and r["n"]["kept"])
    assert quality.quality_rules(no_jobs).count() == 0


def brute_simhash(text):
    import xxhash

    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    """doc -> smallest doc, for (doc, code) pairs, by union over all pairs."""
    parent = {c: c for _, c in codes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, c in codes:
        if d is not None:
            least[find(c)] = min(d, least.get(find(c), d))
    return sorted(((d, f"{c:016x}", least.get(find(c))) for d, c in codes), key=str)


def test_hash_is_sparks_own(spark):
    import xxhash

    got = spark.range(1).select(F.xxhash64(F.lit("un deux trois"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("un deux trois", 42)


def test_near_duplicates_of_odd_rows(odd_jobs, no_jobs):
    codes = [(r["doc_id"], brute_simhash(r["raw_text"])) for r in odd_jobs.collect()]
    assert rows_of(neardup.near_duplicates(odd_jobs), "doc_id", "fingerprint", "component_id") == brute_components(codes)
    assert neardup.near_duplicates(no_jobs).count() == 0
    kept = neardup.drop_copies(odd_jobs)
    assert kept.columns == odd_jobs.columns
    assert kept.count() == len({x[2] for x in brute_components(codes)})
    assert neardup.drop_copies(no_jobs).count() == 0


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_groups_do_not_depend_on_the_bucket_limit(spark, bucket):
    """Chains, stars and clouds of fingerprints, with one hot group of a third of all rows."""
    draw = np.random.default_rng(7)
    codes = [int(x) for x in draw.integers(0, 1 << 64, 150, np.uint64)]
    for start in codes[:6]:
        at = start
        for _ in range(25):  # a chain whose ends are far apart
            at ^= sum(1 << int(b) for b in draw.choice(64, 2, replace=False))
            codes.append(at)
    centre = codes[20]
    codes += [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 64, (150, 2))] + [centre] * 150
    pairs = list(enumerate(codes))
    df = spark.createDataFrame([(d, c - (1 << 64) if c >= 1 << 63 else c) for d, c in pairs], "doc_id bigint, code bigint")
    links = neardup.close_pairs(df.select("code").distinct(), bucket=bucket)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 and r["a"] < r["b"] for r in links.collect())
    roots = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    signed = {d: c - (1 << 64) if c >= 1 << 63 else c for d, c in pairs}
    group = collections.defaultdict(list)
    for d, c in signed.items():
        group[roots.get(c, c)].append(d)
    got = {d: min(g) for g in group.values() for d in g}
    assert got == {d: least for d, _, least in brute_components(pairs)}


def test_blocks_miss_no_pair():
    """Any two bits may differ: some choice of blocks stays equal."""
    from itertools import combinations

    for blocks in (4, 5, 6):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in c) for c in combinations(range(blocks), blocks - 2)]
        assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_ranking_orders_pairs_and_sets_the_threshold():
    draw = np.random.default_rng(2)
    good, bad = draw.normal(1, 1, (300, len(preference.FEATURES))), draw.normal(-1, 1, (100, len(preference.FEATURES)))
    rows, accepted = np.concatenate((good, bad)), np.r_[np.ones(300, int), np.zeros(100, int)]
    ranking = preference.fit(rows, accepted, pairs=5000)
    score = ranking.score(rows)
    assert ((score >= 0.7) == (accepted == 1)).mean() > 0.98
    assert (score >= 0.7).sum() == 300  # the quantile at the share of refused rows
    gap = (good[:50, None] - bad[None, :50]).reshape(-1, rows.shape[1])
    w = np.array(ranking.weights) / np.array(ranking.scale)
    assert (gap @ w > 0).mean() > 0.99


def test_ranking_is_learned_from_all_pairs_of_all_cases(spark):
    """Against Newton steps over every pair in memory, and the exact place of the threshold."""
    draw = np.random.default_rng(5)
    lines = ["the chair opened the meeting, and %d members heard it.", "OFFER %d $$ ### buy buy buy buy", "notes of %d | pages"]
    def text(kind):
        return "\n".join(lines[k] % draw.integers(1000) for k in draw.choice(3, draw.integers(2, 12), p=[0.6, 0.2, 0.2] if kind else [0.3, 0.4, 0.3]))
    rows = [(i, text(i % 2), i % 2) for i in range(1000)]
    jobs = spark.createDataFrame(rows, "doc_id bigint, raw_text string, accepted int").repartition(7)
    ranking = preference.learn_ranking(jobs, jobs)
    f = np.array([preference.features(t.encode()) for _, t, _ in rows])
    accepted = np.array([a for *_, a in rows])
    exact = preference.fit(f, accepted)
    assert np.abs(ranking.raw(f) - exact.raw(f)).max() < 6e-3
    assert ranking.threshold == pytest.approx(exact.threshold, abs=2e-3)
    raw = np.sort(ranking.raw(f))
    assert ranking.threshold == pytest.approx((raw[499] + raw[500]) / 2, abs=1e-12)


def test_value_at_a_place(spark):
    values = [float(v) for v in np.random.default_rng(3).exponential(1, 3000)] + [0.25] * 2000
    rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    for place in (0, 1, 700, 2500, 4999):
        assert preference.value_at(rows, "x", place, few=20, parts=10) == sorted(values)[place]


def test_quality_scores_of_odd_rows(spark, odd_jobs, no_jobs):
    cases = spark.createDataFrame([(9, 1), (10, 1), (12, 1), (13, 0), (15, 0), (15, 0), (4, 7), (None, 1), (5, None)], "doc_id bigint, accepted int")
    ranking = preference.learn_ranking(odd_jobs, cases)
    out = preference.score_jobs(odd_jobs, ranking, to="size").collect()
    assert len(out) == odd_jobs.count() and all(0 <= r["size"] <= 1 for r in out)
    by = {r["doc_id"]: r["size"] for r in out if r["doc_id"] is not None}
    assert by[9] == by[10] and by[0] == by[1] == by[2] and by[9] > by[13]
    nothing = preference.learn_ranking(no_jobs, cases.limit(0))
    assert all(r["preference"] == pytest.approx(0.7) for r in preference.score_jobs(odd_jobs, nothing).collect())
    assert preference.score_jobs(no_jobs, ranking).count() == 0
