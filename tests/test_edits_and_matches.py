"""Alignment, tolerant edits and lexicon joins against brute force."""

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import align as A, edits as EDITS
from scriptorium.functions.align import _align, _spans, locate
from scriptorium.functions.edits import _annotate, insert_links, place_headings
from scriptorium.functions import text as T
from scriptorium.operators import claims as C, edits as E, joins as J, lexicon as L, sequence as Q


def library_runs(x, y):
    return [(m.a, m.b, m.size) for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size]


@pytest.mark.parametrize("small", [0, 30, A.SMALL])
def test_runs_equal_those_of_the_library(monkeypatch, small):
    monkeypatch.setattr(A, "SMALL", small)
    for seed in range(300):
        rng = random.Random(seed)
        items = rng.choice([1, 2, 3, 10, 100])
        x = [rng.randint(0, items) for _ in range(rng.randint(0, 120))]
        y = [rng.randint(0, items) for _ in range(rng.randint(0, 120))] if seed % 3 == 0 else list(x)
        for _ in range(rng.randint(0, 20)):
            i = rng.randint(0, len(y))
            y[i : i + rng.randint(0, 4)] = [rng.randint(0, items) for _ in range(rng.randint(0, 4))]
        assert A.matching_runs(x, y) == library_runs(x, y)
        assert A.edit_steps(x, y) == SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        assert A.likeness(x, y) == SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_long_and_repeated_texts_are_aligned_in_time():
    """A hundred thousand words a side with thousands of changes, and a loop of one word: hours by search of all pairs."""
    rng = random.Random(1)
    x = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(100_000)]
    y = list(x)
    for _ in range(5000):
        i = rng.randint(0, len(y))
        y[i : i + rng.randint(0, 3)] = [rng.choice(x) for _ in range(rng.randint(0, 3))]
    start = time.process_time()
    steps = A.edit_steps(x, y)
    assert A.edit_steps(["spam"] * 100_000, ["spam"] * 60_000 + ["x"] + ["spam"] * 20_000)[0] == ("equal", 0, 60_000, 0, 60_000)
    assert time.process_time() - start < 30
    made = [w for tag, i1, i2, j1, j2 in steps for w in (x[i1:i2] if tag == "equal" else y[j1:j2])]
    assert made == y and sum(i2 - i1 for tag, i1, i2, _, _ in steps if tag == "equal") > 85_000


words = st.lists(st.sampled_from(["le", "juge", "dit", "non", "12", "oui"]), max_size=12).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_alignment_rebuilds_the_revision(raw, clean):
    a, b = [w for w, *_ in _spans(raw)], [w for w, *_ in _spans(clean)]
    ops = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    built = [w for tag, i1, i2, j1, j2 in ops for w in (a[i1:i2] if tag == "equal" else b[j1:j2])]
    assert built == b
    added, longest, rs, re_, *_ = _align(raw, clean)
    assert added == sum(j2 - j1 for t, _, _, j1, j2 in ops if t in ("insert", "replace")) and longest <= added
    assert (rs is None) or raw[rs:re_].strip()


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_annotation_leaves_the_rest_alone(text, citation):
    out, notes = _annotate(text, [{"citation": citation, "replacement": None, "tail": ": x"}])
    if notes == [None]:
        assert out == text
    else:
        assert out.split("\n\n")[0].replace("[^v1]", "") == text.rstrip()
        start, end = locate(text, citation)
        assert out[:end] == text[:end] and out[end:].startswith("[^v1]")


def test_corrections_follow_each_other():
    edits = [{"citation": "ADN", "replacement": "ARN", "tail": ": a"}, {"citation": "Paris", "replacement": None, "tail": ": b"},
             {"citation": "absent", "replacement": None, "tail": ": c"}]
    out, notes = _annotate("L'ADNx de Paris.", [{**edits[0], "citation": "ADNx"}, *edits[1:]])
    assert out == "L'ARN[^v1] de Paris[^v2].\n\n[^v1]: a\n[^v2]: b\n" and notes == [1, 2, None]


def test_headings_and_links(spark):
    text = "Premier paragraphe ici.\n\nDeuxième paragraphe plus loin.\n\n\nTroisième et dernier paragraphe."
    wanted = [("Fin", "Troisième et dernier"), ("Non", "Deuxième paragraphe"), ("Court", "ici")]
    rows = spark.createDataFrame([(text, wanted, [("juge", "Juge")]), (None, None, None), (text, wanted[1::-1], [("paragraphe", "P")])],
                                 "t string, s array<struct<heading:string,quote:string>>, p array<struct<quote:string,title:string>>")
    got = rows.select(place_headings("t", "s").alias("h"), insert_links(F.lit("le juge et la loi \\E"), F.col("p")).alias("l")).collect()
    assert got[0]["h"].count("## ") == 1 and "\n\n\n## Fin\n\nTroisième" in got[0]["h"] and got[0]["l"] == "le [[Juge|juge]] et la loi \\E"
    assert got[1]["h"] == "" and got[2]["h"].index("## Non") < got[2]["h"].index("## Fin") and got[2]["l"] == "le juge et la loi \\E"


def test_pieces_are_literal(spark):
    rows = [("a\\E.b$ a\\E.b", "a\\E.b", 9), ("aaa", "", 1), ("a.b", "c", 0), ("xx x xx", "x", 4), (".$.", "$", 0)]
    df = spark.createDataFrame(rows, "t string, p string, at int")
    got = [tuple(r) for r in df.select(T.count_of(F.col("t"), F.col("p")), Q.nearest_occurrence(F.col("t"), F.col("p"), F.col("at"))).collect()]
    assert got == [(2, 7), (0, -1), (0, -1), (5, 3), (1, 1)]
    one = df.select("t", F.lit("b").alias("block_id"), F.lit(1).alias("doc_id")).limit(1)
    dec = spark.createDataFrame([(1, "b", "\\E.b$", "z")], "doc_id int, block_id string, citation string, proposition string")
    assert C.replace_in_blocks(one.withColumnRenamed("t", "text"), dec).first()["text"] == "az a\\E.b"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd"))), min_size=1, max_size=20))
def test_bags_match_brute_force(spark, rows):
    def brute(left, right):
        rest, seen, out = list(right), set(), []
        for x in left:
            if x in rest:
                rest.remove(x)
            else:
                if x not in seen:
                    out.append(x)
                seen.add(x)
        lost = sum(max(0, left.count(x) - right.count(x)) for x in set(left))
        return out, lost / len(left) if left else 0.0

    df = spark.createDataFrame(rows, "l array<string>, r array<string>")
    got = df.select(T.bag_missing(F.col("l"), F.col("r")), T.missing_ratio(F.col("l"), F.col("r"))).collect()
    assert [tuple(g) for g in got] == [brute(l, r) for l, r in rows]


NAMES = "term string, pos string, category string, verified boolean, name string"


def lexicon(spark, terms):
    rows = [(t, f"{i:04d}", "texte", True, t) for i, t in enumerate(terms)]
    from scriptorium.functions import text as T
    return spark.createDataFrame(rows, NAMES).withColumn("name_key", T.norm_key("name"))


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_names_match_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = sorted({make(rng.randint(4, 7)) for _ in range(25)} | {make(n) for n in (17, 18, 19, 20, 24, 30)})

    def bend(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice([[], ["z"], [t[k], "z"]])
        return "".join(t)

    seen = sorted({bend(rng.choice(terms)) for _ in range(300)} - {""})
    seen = [w for w in seen if len(w) >= 4]
    df = spark.createDataFrame([(w,) for w in seen], "word string")
    got = {r["word"]: r["term"] for r in L.fuzzy_pairs(df, lexicon(spark, terms)).collect()}
    want = {w: next((t for t in terms if t != w and edit_distance(w, t) <= 2), None) for w in seen}
    assert got == {w: t for w, t in want.items() if t}
    assert any(len(t) > 18 for t in got.values())


def test_containment_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, i % 3, " ".join(rng.choice(["code", "civil", "l'art", "440", "decode", "…", "a-b"]) for _ in range(8))) for i in range(60)]
    needles = [(k % 3, n) for k, n in enumerate(["code", "de", "e civ", "code civil", "art 440 code", "…", " ", "l'art 440", "zz", "-", "il l'"])]
    t = spark.createDataFrame(texts, "id long, doc_id long, text string")
    n = spark.createDataFrame(needles, "doc_id long, n string")
    got = sorted((r["id"], r["n"]) for r in L.contains_join(t, ["id", "doc_id"], "text", n, "n", on=["doc_id"]).collect())
    assert got == sorted((i, n) for i, d, x in texts for e, n in needles if d == e and n in x)


def test_trusted_names_are_masked(spark):
    names = lexicon(spark, ["ARS", "Juge des tutelles", "juge", "élu"])
    text = "Les mars, l'A.R.S. et le Juge  des tutelles ; un elu, un juge."
    row = L.shield_trusted(spark.createDataFrame([(1, text)], "id long, text string"), "text", names).first()
    assert len(row["masked"]) == len(text) and "mars" in row["masked"]
    assert [r["term"] for r in row["recognised"]] == ["ARS", "Juge des tutelles", "élu", "juge"]


YEAR = 366 * 86_400.0


def brute_sources(pairs, segs):
    want = []
    for d, b, ps, pe in pairs:
        own = [r for r in segs if r[0] == d]
        hits = [i for _, i, x, y in own if y > ps and x < pe]
        near = sorted((abs(r[2] - ps), r[1]) for r in own)[:1]
        want += [(d, b, i) for i in hits or [i for _, i in near]]
    return sorted(want)


@pytest.mark.parametrize("width", [7.0, 60.0])
def test_intervals_and_nearest_match_brute_force(spark, width):
    """A hot document, a span of a year, wrong ends, equal starts, gaps of hours, documents without segments."""
    rng = random.Random(4)
    segs, pairs = [], []
    for d, n in ((1, 400), (2, 30), (3, 1), (4, 0), (5, 60)):
        times = [round(rng.random() * n * 5, 1) + (9000 if d == 5 and i % 2 else 0) for i in range(n)]
        times = [times[i - 1] if i % 9 == 8 else t for i, t in enumerate(times)]
        segs += [(d, i, t, t + round(rng.random() * 4, 1)) for i, t in enumerate(times, 1)]
        pairs += [(d, f"p{k}", s, s + rng.choice([0.0, 1.5, 300.0])) for k, s in enumerate(round(rng.random() * n * 6 - 20, 1) for _ in range(max(n // 2, 4)))]
    segs += [(1, 900, 10.0, 10.0 + YEAR), (1, 901, 50.0, 20.0), (2, 902, 5.0, 1e300), (5, 903, -YEAR, -YEAR + 1)]
    pairs += [(1, "year", 100.0, YEAR), (2, "late", 9 * YEAR, 9 * YEAR + 1), (3, "early", -9 * YEAR, -9 * YEAR + 1), (1, "inverted", 30.0, 12.0), (1, "tie", 5000.0, 5000.0)]
    s = spark.createDataFrame(segs, "doc_id long, seg_idx long, start double, end double").repartition(3)
    p = spark.createDataFrame(pairs, "doc_id long, block_id string, start double, end double").repartition(3)
    assert sorted(map(tuple, J.pair_segments(p, s, width=width).collect())) == brute_sources(pairs, segs)
    nulls = spark.createDataFrame([(1, "x", None, 5.0), (1, "y", None, None)], p.schema)
    assert J.pair_segments(nulls, s).count() == 0 and J.pair_segments(p.limit(0), s).count() == 0 and J.pair_segments(p, s.limit(0)).count() == 0
    closed = J.interval_join(
        p.toDF("doc_id", "block_id", "ps", "pe"), s, ["doc_id"], ("ps", "pe"), ("start", "end"), tol=0.5, closed=True, width=width)
    want = sorted((d, b, i) for d, b, ps, pe in pairs for e, i, x, y in segs if d == e and y >= ps - 0.5 and x <= pe + 0.5)
    assert sorted((r["doc_id"], r["block_id"], r["seg_idx"]) for r in closed.collect()) == want


def test_clips_take_the_words_inside_them(spark):
    words = lambda *w: [(a, b, t, None) for a, b, t in w]
    segs = [
        (1, 1, 0.0, 4.0, "le juge vient", words((0.0, 1.0, " le"), (1.2, 2.0, "juge"), (3.0, 4.0, "vient "))),
        (1, 2, 5.0, 9.0, "puis il part", words((5.0, 6.0, "puis"), (6.0, 7.0, "il"), (8.0, 9.0, "part"))),
        (2, 1, 0.0, 4.0, " sans mots ", None), (2, 2, 4.2, 6.0, "ni fin", []), (3, 1, 0.0, 1.0, None, None),
    ]
    s = spark.createDataFrame(segs, "doc_id long, seg_idx long, start double, end double, text string, words array<struct<start:double,end:double,text:string,confidence:double>>")
    clips = [(1, "a", 2.5, 5.4), (1, "b", 20.0, 30.0), (2, "a", 1.0, 3.9), (2, "b", 4.9, 5.0), (3, "a", 0.0, 1.0), (4, "a", 0.0, 1.0)]
    c = spark.createDataFrame(clips, "doc_id long, clip string, clip_start double, clip_end double")
    got = {(r["doc_id"], r["clip"]): (r["seg_ids"], [w["text"] for w in r["words"]], r["text"]) for r in J.retry_selection(c, s).collect()}
    assert got == {
        (1, "a"): ([1, 2], ["juge", "vient ", "puis"], "juge vient puis"), (1, "b"): ([], [], ""), (2, "a"): ([1, 2], [], "sans mots ni fin"),
        (2, "b"): ([2], [], "ni fin"), (3, "a"): ([1], [], ""), (4, "a"): ([], [], ""),
    }


def test_retimed_words_keep_their_times(spark):
    w = [(0.0, 1.0, "le", 0.9), (1.0, 2.0, "juge", 0.8), (2.0, 3.0, "vient", 0.7)]
    b = spark.createDataFrame(
        [(1, 1, "b1", 0.0, 4.0, "le juge vient", w)],
        "doc_id long, pos long, block_id string, start double, end double, text string, words array<struct<start:double,end:double,text:string,confidence:double>>",
    )
    e = spark.createDataFrame([(1, "b1", "le bon juge vient", 1)], "doc_id long, block_id string, text string, seq int")
    got = E.set_text(b, e).first()["words"]
    assert [(x["text"], x["start"], x["confidence"]) for x in got] == [("le", 0.0, 0.9), ("bon", 1.0, None), ("juge", 1.0, 0.8), ("vient", 2.0, 0.7)]


def test_verdicts_are_applied_safely(spark):
    docs = spark.createDataFrame([(1, "Le PIB de 2020 et la CNCP.")], "doc_id long, text string")
    v = spark.createDataFrame([
        (1, 1, "organisme", "CNCP", "corrige", "haute", "CNC (commission)", [("t", "https://a")], "Vu.", "web"),
        (1, 2, "date", "2020", "corrige", "haute", "2021", [("t", "https://a")], "", "web"),
        (1, 3, "nom_propre", "PIB", "introuvable", "basse", "", [], "", "web"),
        (1, 4, "nom_propre", "PIB", "confirme", "haute", "PIB", [], "", "lexique"),
    ], "doc_id long, pos long, type string, citation string, verdict string, confidence string, correct_form string, sources array<struct<title:string,url:string>>, explanation string, origin string")
    texts, marks = C.apply_verdicts(docs, v)
    body = texts.first()["text"]
    assert body.startswith("Le PIB de 2020[^v2] et la CNC (commission)[^v1].\n\n[^v1]: **« CNCP »** — corrigé en **CNC (commission)**. Vu.")
    assert C.pending_corrections(marks).first()["proposition"] == "2021"
    found = {r["raw_excerpt"]: r["severity"] for r in C.verdict_findings(marks).collect()}
    assert found == {"2020": "moyenne"}  # three letters are too short a place to note
    assert C.corrections_count(v).first()["corrections"] == 1


def test_entities_must_be_grounded(spark):
    names = lexicon(spark, ["code civil", "curatelle", "juge"])
    p = spark.createDataFrame([
        (1, "le code dit", "le code civil dit"),            # said, not heard
        (2, "le civil code dit", "le code civil dit"),      # same words, other order
        (3, "le Code  Civil dit", "le code civil dit"),     # heard
        (4, "la curatele dit", "la curatelle dit"),         # misspelt in the raw text
        (5, "la dame dit", "la dame dit"),
        (6, "il dit", "la Curatelle dit au juge"),
        (7, None, "juge"),
    ], "id long, raw string, candidate string")
    got = sorted((r["id"], r["term"]) for r in L.ungrounded_entities(p, names).collect())
    assert got == [(1, "code civil"), (2, "code civil"), (6, "curatelle"), (6, "juge"), (7, "juge")]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_cuts_are_refused_with_a_reason(spark, rows):
    w = [(float(i), i + 1.0, t, None) for i, t in enumerate("a b c d e f g h".split())]
    b = spark.createDataFrame(
        [(1, 1, "b1", 0.0, 8.0, "a b c d e f g h", "", w), (1, 2, "b2", 8.0, 9.0, "x", "", w[:1]), (1, 3, "b3", 9.0, 9.5, "", "", []), (1, 4, "b4", 9.5, 9.9, "y", "", None)],
        "doc_id long, pos long, block_id string, start double, end double, text string, raw_text string, words array<struct<start:double,end:double,text:string,confidence:double>>",
    ).withColumn("speaker", F.lit("S"))
    asked = [("b1", 6), ("b1", 7), ("b1", 3), ("b1", 3), ("b1", 0), ("b1", -2), ("b1", None), ("b1", 2), ("b1", 2), ("b2", 1), ("b3", 1), ("b4", 1), ("zz", 1)]
    e = spark.createDataFrame([(1, i, k, n) for n, (i, k) in enumerate(asked)], "doc_id long, block_id string, word_index int, seq int").repartition(3)
    got = {r["seq"]: r["reason"] for r in E.judged_cuts(b, e, rows=rows).collect()}
    size, want = {"b1": 8, "b2": 1}, {}
    for n, (i, k) in enumerate(asked):
        want[n] = {"zz": E.UNKNOWN_BLOCK, "b3": E.NO_WORDS, "b4": E.NO_WORDS}.get(i)
        if i in size:
            ok = k is not None and 0 < k < size[i]
            want[n] = None if ok else E.OUTSIDE
            size[i] = k if ok else size[i]
    assert got == want and sum(r is None for r in got.values()) == 3
    notes = spark.createDataFrame([], "doc_id long, block_id string, range_start int, range_end int")
    out = E.split_blocks(b, notes, e)[0].orderBy("pos").collect()
    assert [r["text"] for r in out] == ["a b", "c", "d e f", "g h", "x", "", "y"]
    assert E.refused_cuts(b, e).count() == 10 and E.refused_cuts(b, e.limit(0)).count() == 0


def test_turns_carry_words_and_ids(spark):
    w = lambda *t: [(0.0, 1.0, x, None) for x in t]
    segs = [(1, 1, "S", w("a")), (1, 2, "S", None), (1, 3, "S", w("b", "c")), (1, 4, "T", None), (1, 6, None, w("d")), (1, 7, None, [])]
    df = spark.createDataFrame(
        [(d, i, i * 1.0, i + 0.5, f"t{i}", s, "r", 0.5, x) for d, i, s, x in segs],
        "doc_id long, seg_idx long, start double, end double, text string, speaker string, role string, confidence double, words array<struct<start:double,end:double,text:string,confidence:double>>")
    for rows in (1, 2, 100):
        got = [(r["source_segment_ids"], None if r["words"] is None else [x["text"] for x in r["words"]]) for r in Q.speaker_turns(df, rows=rows).orderBy("pos").collect()]
        assert got == [(["segment-1", "segment-2", "segment-3"], ["a", "b", "c"]), (["segment-4"], None), (["segment-6"], ["d"]), (["segment-7"], [])]
    assert "words" not in Q.speaker_turns(df.drop("words")).columns


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_runs_of_merges_do_not_depend_on_blocks(spark, rows):
    """A document whose blocks are nearly all merged into one, beside small ones."""
    rng = random.Random(rows)
    blocks = [(d, p, f"b{p}", p * 1.0, p + 0.9, rng.choice(["", f"t{p}", f"wort {p}"]), rng.choice(["", f"r{p}"]), [(0.0, 1.0, f"w{p}", None)] if p % 3 else None)
              for d, n in ((1, 60), (2, 5), (3, 1)) for p in range(1, n + 1)]
    schema = "doc_id long, pos long, block_id string, start double, end double, text string, raw_text string, words array<struct<start:double,end:double,text:string,confidence:double>>"
    named = {(1, f"b{p}") for p in range(1, 58)} - {(1, "b40")} | {(2, "b2"), (2, "b5"), (3, "b1")}
    notes = [(d, f"b{p}", 1, None if p % 4 == 0 else 3) for d, p, *_ in blocks]
    want, moved = [], []
    for d in (1, 2, 3):
        own = [list(b) for b in blocks if b[0] == d]
        at = {b[2]: (b[2], 0) for b in own}
        for k in range(len(own) - 2, -1, -1):
            if (d, own[k][2]) in named:
                a, b = own[k], own.pop(k + 1)
                sep = " " if a[5] and b[5] else ""
                off = len(a[5]) + len(sep)
                at = {i: (a[2], o + off) if t == b[2] else (t, o) for i, (t, o) in at.items()}
                a[4], a[5], a[6], a[7] = b[4], a[5] + sep + b[5], (a[6] + " " + b[6]).strip(), (a[7] or []) + (b[7] or [])
        want += [(d, n, b[2], b[4], b[5], b[6], [w[2] for w in b[7] or []]) for n, b in enumerate(own, 1)]
        moved += [(d, at[i][0], s + at[i][1], None if e is None else e + at[i][1]) for n, i, s, e in notes if n == d]
    out, a = E.merge_with_next(
        spark.createDataFrame(blocks, schema).repartition(3), spark.createDataFrame(notes, "doc_id long, block_id string, range_start int, range_end int"),
        spark.createDataFrame(sorted(named), "doc_id long, block_id string"), rows=rows)
    assert sorted((r["doc_id"], r["pos"], r["block_id"], r["end"], r["text"], r["raw_text"], [w["text"] for w in r["words"]]) for r in out.collect()) == want
    assert sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, moved))


def brute_annotate(text, edits):
    """The rule as it is said: the first place by letters and digits, in the text as it is by then."""
    notes, lines = [], []
    for e in edits:
        places = [i for i, ch in enumerate(text) if ch.isalnum()]
        pin = "".join(ch.lower()[:1] for ch in e["citation"] if ch.isalnum())
        at = "".join(text[i].lower()[:1] for i in places).find(pin) if len(pin) >= 4 else -1
        notes.append(None if at < 0 else len(lines) + 1)
        if at >= 0:
            mark, start, end = f"[^v{len(lines) + 1}]", places[at], places[at + len(pin) - 1] + 1
            text = text[:end] + mark + text[end:] if e["replacement"] is None else text[:start] + e["replacement"] + mark + text[end:]
            lines.append(mark + e["tail"])
    return (text.rstrip() + "\n\n" + "\n".join(lines) + "\n" if lines else text), notes


@pytest.mark.parametrize("size", [1, 3, EDITS.CHUNK])
def test_ordered_edits_do_not_depend_on_pieces(monkeypatch, size):
    monkeypatch.setattr(EDITS._Pieces.__init__, "__defaults__", (size,))
    for seed in range(400):
        rng = random.Random(seed)
        letters = rng.choice(["ab", "ab ", "abv1 .", "aB-é 12v"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        edits = []
        for _ in range(rng.randint(0, 25)):
            i = rng.randint(0, len(text))
            said = text[i : i + rng.randint(3, 14)] if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
            edits.append({"citation": said, "replacement": rng.choice([None, "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))]), "tail": "x"})
        assert EDITS._annotate(text, edits) == brute_annotate(text, edits)


def test_a_text_with_most_verdicts(spark):
    """One document holds nearly all verdicts."""
    rng = random.Random(0)
    words = [f"mot{rng.randint(0, 9999)}" for _ in range(5000)]
    verdicts = [(1, n, "nom_propre", " ".join(words[i : i + 2]), rng.choice(["corrige", "infirme", "confirme"]), "haute", f"neuf {n}", [("t", "https://a")], "Vu.", "web")
                for n, i in enumerate(rng.randint(0, len(words) - 2) for _ in range(300))]
    verdicts += [(2, 1, "nom_propre", "mot un", "infirme", "haute", "", [("t", "https://a")], "Non.", "web")]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "le mot un")], "doc_id long, text string")
    v = spark.createDataFrame(verdicts, "doc_id long, pos long, type string, citation string, verdict string, confidence string, correct_form string, sources array<struct<title:string,url:string>>, explanation string, origin string")
    texts, marks = C.apply_verdicts(docs, v.repartition(4))
    got = {r["doc_id"]: r["text"] for r in texts.collect()}
    noted = sorted((r["pos"], r["note"]) for r in marks.filter("doc_id = 1").collect())
    order = [x for x in verdicts if x[0] == 1 and x[4] != "confirme"]
    edits = [{"citation": x[3], "replacement": x[6] if x[4] == "corrige" else None, "tail": ""} for x in order]
    body, notes = brute_annotate(" ".join(words), edits)
    assert got[1].split("\n\n")[0] == body.split("\n\n")[0]
    assert noted == sorted((x[1], n) for x, n in zip(order, notes) if n)


def test_thousands_of_edits_in_one_long_text():
    rng = random.Random(3)
    words = [f"mot{rng.randint(0, 9999)}" for _ in range(200_000)]
    edits = [{"citation": " ".join(words[i : i + 2]), "replacement": None if i % 2 else f"neuf {i}", "tail": ""} for i in rng.sample(range(len(words) - 1), 4000)]
    start = time.process_time()
    notes = EDITS._annotate(" ".join(words), edits)[1]
    assert time.process_time() - start < 40 and sum(n is not None for n in notes) > 3500
