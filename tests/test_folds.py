"""Blocked folds and windows against plain loops, with tiny blocks so borders matter."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import blocks as K, sequence as Q, signal as G

SEG = "doc_id long, seg_idx long, start double, end double, text string, speaker string, role string, confidence double"


def fake_segments(seed, docs=4, n=40):
    rng, rows = random.Random(seed), []
    for d in range(docs):
        t = 0.0
        for i in range(1, rng.randint(1, n) + 1):
            t += rng.choice([0.0, 0.5, 2.0])
            text = "" if rng.random() < 0.1 else "m" * rng.randint(1, 60) + rng.choice(["", ".", "!»"])
            end = t + rng.random() * 3
            rows.append((d, i, round(t, 3), round(end, 3), text, rng.choice([None, "A", "A", "B"]), "r", rng.choice([None, 0.5])))
            t = end
    return rows


def loop_paragraphs(rows, pause, low, top):
    out, cur, length, prev_end, prev_sp, doc = [], None, 0, None, None, None
    for d, i, s, e, text, sp, *_ in rows:
        if d != doc:
            if cur:
                out.append(tuple(cur))
            doc, cur, length, prev_end, prev_sp = d, None, 0, None, None
        if not text.strip():
            continue
        gap = s - prev_end if prev_end is not None else 0.0
        if cur and ((sp and prev_sp and sp != prev_sp) or (gap >= pause and length >= low) or length >= top):
            out.append(tuple(cur))
            cur, length = None, 0
        cur = [d, i, i, text] if cur is None else [d, cur[1], i, cur[3] + " " + text]
        length += len(text) + 1
        prev_end, prev_sp = e, sp
    if cur:
        out.append(tuple(cur))
    return sorted(out)


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_paragraphs_do_not_depend_on_blocks(spark, rows):
    for seed in range(3):
        data = fake_segments(seed)
        df = spark.createDataFrame(data, SEG).repartition(5)
        got = Q.paragraphs(df, pause=1.2, min_chars=60, max_chars=120, rows=rows)
        got = sorted(tuple(r) for r in got.select("doc_id", "first_idx", "last_idx", "text").collect())
        assert got == loop_paragraphs(data, 1.2, 60, 120)


@pytest.mark.parametrize("rows", [2, 1000])
def test_chunks_do_not_depend_on_blocks(spark, rows):
    data = [(1, i, float(i), i + 0.5, "x" * (i * 37 % 90 + 1) + ("." if i % 3 == 0 else ""), None, "r", None) for i in range(1, 120)]
    out = Q.chunks(spark.createDataFrame(data, SEG), max_chars=500, rows=rows).orderBy("chunk_idx").collect()
    buf, length, want = [], 0, []
    for *_, text, _s, _r, _c in data:
        buf.append(text)
        length += len(text) + 1
        if length >= 500 or (length >= 350 and text.endswith(".")):
            want.append(" ".join(buf))
            buf, length = [], 0
    if buf:
        want.append(" ".join(buf))
    assert [r["text"] for r in out] == want
    assert [r["chunk_idx"] for r in out] == list(range(len(want)))


@pytest.mark.parametrize("rows", [2, 5, 1000])
def test_turns_and_gaps_do_not_depend_on_blocks(spark, rows):
    data = fake_segments(9)
    df = spark.createDataFrame(data, SEG)
    turns = Q.speaker_turns(df, rows=rows).orderBy("doc_id", "pos").collect()
    want, prev = [], None
    for d, i, s, e, text, sp, *_ in data:
        if prev and prev[0] == d and sp and sp == prev[1]:
            want[-1][2] = i
            want[-1][3] = (want[-1][3] + " " + text).strip() if text else want[-1][3]
        else:
            want.append([d, i, i, text])
        prev = (d, sp)
    assert [[r["doc_id"], r["first"], r["last"], r["text"]] for r in turns] == want
    gaps = {(r["doc_id"], r["seg_idx"]): r["gap"] for r in Q.running_gap(df, rows).collect()}
    latest, doc = 0.0, None
    for d, i, s, e, *_ in data:
        latest = 0.0 if d != doc else latest
        doc = d
        assert gaps[d, i] == pytest.approx(max(0.0, s - latest))
        latest = max(latest, e)


def test_lead_and_lag_cross_blocks(spark):
    df = spark.createDataFrame([(1, i, i * 10) for i in range(1, 12)], "k long, i long, v long")
    lag = K.lagged(df, ["k"], ["i"], {"p": F.col("v")}, block=K.block_of("i", 3)).orderBy("i").collect()
    lead = K.lagged(df, ["k"], ["i"], {"p": F.col("v")}, block=K.block_of("i", 3), lead=True).orderBy("i").collect()
    assert [r["p"] for r in lag] == [None] + [i * 10 for i in range(1, 11)]
    assert [r["p"] for r in lead] == [i * 10 for i in range(2, 12)] + [None]


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_quiet_points_do_not_depend_on_blocks(spark, block):
    rng = random.Random(3)
    rms = [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(5, i, v) for i, v in enumerate(rms)], "k long, frame long, rms double")
    got = sorted(r["cut"] for r in G.quiet_points(df, "k", target=30, search=10, block=block).collect())
    want, cursor = [], 30
    while cursor < 500 - 15:
        low, high = max(cursor - 5, 0), min(cursor + 5, 499)
        at = min(range(low, high + 1), key=lambda i: (rms[i], i))
        if want and at <= want[-1] + 10:
            at = cursor
        want.append(at)
        cursor = at + 30
    assert got == want


def test_turns_of_short_documents_move_no_words(spark):
    from scriptorium.operators import sequence as Q

    rows = [(d, i, float(i), i + 1.0, f"t{i}", who, "r", 0.5, [f"w{i}"] if i % 4 else None) for d in (1, 2) for i, who in enumerate("AABBBCA-A", 1)]
    seg = spark.createDataFrame(rows, "doc_id long, seg_idx long, start double, end double, text string, speaker string, role string, confidence double, words array<string>")
    key = lambda df: sorted((r["doc_id"], r["pos"], r["block_id"], r["n_segments"], tuple(r["source_segment_ids"]), tuple(r["words"] or ())) for r in df.collect())
    dealt = seg.repartition(3, "doc_id")
    turns = Q.speaker_turns(dealt)
    assert key(turns) == key(Q.speaker_turns(dealt, rows=1)) == key(Q.speaker_turns(dealt, rows=2))
    # the carries are empty, so what is dealt by document is not dealt again
    assert Q.speaker_turns(dealt)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert "Join" in Q.speaker_turns(dealt, rows=2)._jdf.queryExecution().optimizedPlan().toString()
