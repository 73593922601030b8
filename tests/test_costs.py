"""Work that a result needs once is done once, and grows with the rows."""

import random
import re
import time

from pyspark.sql import functions as F

from scriptorium.functions import align as A, text as T
from scriptorium.functions.edits import place_headings
from scriptorium.operators import joins as J, lexicon as L, validate as V


def test_short_texts_are_aligned_without_set_up():
    rng = random.Random(3)
    pairs = []
    for _ in range(3000):
        x = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(60)]
        pairs.append((x, [w for w in x if rng.random() > 0.05]))
    start = time.process_time()
    for x, y in pairs:
        A.edit_steps(x, y)
    assert time.process_time() - start < 2.5


def test_patterns_of_names_are_compiled_once(monkeypatch):
    names = [{"pattern": rf"(?i)(?<!\w)name{n}(?!\w)", "key": f"name{n}", "term": f"name{n}"} for n in range(700)]
    made, real = [], re.compile
    monkeypatch.setattr(re, "compile", lambda p, *flags: made.append(p) or real(p, *flags))
    for _ in range(3):
        assert [t for _, t in A._sweep("a name5 and NAME699", names)] == ["name5", "name699"]
    assert len(made) <= 700


def test_prefixes_are_tried_for_dotted_names_only(spark):
    names = spark.createDataFrame([("mars", "mars", "mars"), ("ARS", "ARS", "ars")], "term string, name string, name_key string").withColumn("verified", F.lit(True))
    blocks = spark.createDataFrame([(1, "m a m a r s"), (2, "l'A.R.S. et mars")], "id long, text string")
    got = {r["id"]: [x["term"] for x in r["recognised"]] for r in L.shield_trusted(blocks, "text", names).collect()}
    assert got == {1: ["ARS"], 2: ["ARS", "mars"]}


def test_a_document_of_many_headings_is_walked_once(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("Partie "), i.cast("string"), F.lit(" : le texte"))).alias("p"))
    wanted = F.transform("p", lambda x, i: F.struct(F.concat(F.lit("T"), i.cast("string")).alias("heading"), x.alias("quote")))
    start = time.time()
    text = rows.select(place_headings(F.array_join("p", "\n\n"), wanted).alias("t")).first()["t"]
    assert text.count("## T") == 19_999 and "## T19999\n\nPartie 20000" in text
    assert time.time() - start < 15


def test_clips_meet_segments_not_their_words(spark, monkeypatch):
    words = [(float(t), t + 0.5, f"w{t}", None) for t in range(4)]
    seg = spark.createDataFrame(
        [(1, 1, 0.0, 4.0, "w0 w1 w2 w3", words), (1, 2, None, None, "sans temps", [(9.0, 9.5, " neuf ", None), (None, 1.0, "x", None)])],
        "doc_id long, seg_idx long, start double, end double, text string, words array<struct<start:double,end:double,text:string,confidence:double>>")
    clips = spark.createDataFrame([(1, 1, 0.0, 0.4), (1, 2, 8.8, 20.0), (1, 3, 50.0, 60.0)], "doc_id long, clip long, clip_start double, clip_end double")
    sent, real = [], J.interval_join
    monkeypatch.setattr(J, "interval_join", lambda a, b, *rest, **more: sent.append(b.count()) or real(a, b, *rest, **more))
    got = {r["clip"]: (r["seg_ids"], [w["text"] for w in r["words"]], r["text"]) for r in J.retry_selection(clips, seg).collect()}
    assert got == {1: ([1], ["w0"], "w0"), 2: ([], [" neuf "], "neuf"), 3: ([], [], "")}
    assert sent == [2]
    twice = J.retry_selection(clips.filter("clip = 1").withColumn("clip_end", F.lit(1.0)), seg.unionByName(seg)).first()
    assert twice["seg_ids"] == [1, 1] and twice["text"] == "w0 w0 w1 w1"


def test_a_text_that_comes_twice_holds_a_needle_once(spark):
    texts = spark.createDataFrame([(1, "a", "le code civil"), (1, "a", "le code civil"), (1, None, "code"), (2, "a", "code civil"), (None, "a", "code")], "doc_id long, bid string, text string")
    needles = spark.createDataFrame([(1, "code civil", 7), (1, "e", 8), (1, "", 9), (2, "zz", 9), (1, "e", 10), (None, "code", 1)], "doc_id long, n string, tag int")
    got = sorted((r["doc_id"], r["bid"] or "", r["n"], r["tag"]) for r in L.contains_join(texts, ["doc_id", "bid"], "text", needles, "n", on=["doc_id"]).collect())
    assert got == [(1, "", "e", 8), (1, "", "e", 10), (1, "a", "code civil", 7), (1, "a", "e", 8), (1, "a", "e", 10)]


def test_blocks_of_texts_and_needles_meet_fully(spark, monkeypatch):
    monkeypatch.setattr(L, "TEXT_BLOCK", 3)
    monkeypatch.setattr(L, "NEEDLE_BLOCK", 2)
    texts = [(1, i, f"t{i} u{i % 7}") for i in range(40)]
    needles = [(1, f"u{k}") for k in range(7)] + [(1, "t1")]
    got = L.contains_join(spark.createDataFrame(texts, "doc_id long, id long, text string"), ["doc_id", "id"], "text", spark.createDataFrame(needles, "doc_id long, n string"), "n", on=["doc_id"])
    assert sorted((r["id"], r["n"]) for r in got.collect()) == sorted((i, n) for _, i, t in texts for _, n in needles if n in t)


def test_refused_candidates_are_aligned_once(spark):
    pairs = spark.createDataFrame([(1, 1, "b", "le juge dit non", "le juge")], "doc_id long, seg_idx long, block_id string, raw string, candidate string")
    out = V.rejection_findings(V.accept_or_fallback(V.validate(pairs, keys=["doc_id", "seg_idx"])))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"_aligned\(", plan)) == 1 and out.count() == 1


def test_loops_of_words_against_all_places(spark):
    def brute(words):
        return any(words[i : i + k] * n == words[i : i + k * n] for k in range(1, 21) for n in [6 if k < 4 else 3] for i in range(len(words) - k * n + 1))

    rng = random.Random(4)
    texts = []
    for _ in range(400):
        base = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))]
        k, n = rng.randint(1, 22), rng.randint(1, 7)
        texts.append(" ".join(base + [rng.choice("abcdefgh") for _ in range(k)] * n + base))
    df = spark.createDataFrame([(t, brute(t.split())) for t in texts] + [(None, False)], "t string, want boolean")
    rows = df.select("want", T.repetition_loop("t").alias("got")).collect()
    assert all(r["got"] is r["want"] for r in rows) and {r["want"] for r in rows} == {True, False}
    # no list functions evaluated word by word
    assert "lambda" not in df.select(T.repetition_loop("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_pair_spans_are_read_once(spark):
    """The pairs of ``pair_segments`` are kept before they are met and sought again."""
    from scriptorium.operators import joins as J

    pairs = spark.range(3).selectExpr("1L as doc_id", "concat('p', id) as block_id", "id * 2.0D as start", "id * 2.0D + 1 as end")
    seg = spark.createDataFrame([(1, 1, 0.0, 1.5), (1, 2, 1.5, 2.5)], "doc_id long, seg_idx long, start double, end double")
    out = J.pair_segments(pairs, seg)
    assert sorted(map(tuple, out.collect())) == [(1, "p0", 1), (1, "p1", 2), (1, "p2", 2)]
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
