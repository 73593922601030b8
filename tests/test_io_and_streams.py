"""Files, publication and streams."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.session import shared_dir
from scriptorium.sinks import render as R, write as X
from scriptorium.sources import readers
from scriptorium.streaming import feeds as S

EVENTS = "job_id long, event_id long, ts timestamp, status string, stage string, progress double"


def test_cases_and_notes_from_files(spark, tmp_path):
    good = '{"id":"a","raw":"r","candidate":"c","expected":"accept","tags":["x"],"source":"s"}'
    (tmp_path / "cases.jsonl").write_text(good + '\n\n{"id":"b"}\nnot json\n')
    ok, bad = readers.read_cases(spark, str(tmp_path / "cases.jsonl"))
    assert ok.first()["tags"] == ["x"]
    assert sorted(r["reason"] for r in bad.collect()) == ["JSON invalide", "champs manquants: candidate, expected, raw, source, tags"]

    vault = tmp_path / "vault" / "sub"
    vault.mkdir(parents=True)
    (vault / "a.md").write_text('---\ntitle: "Un"\naliases: [Premier, "Le un"]\ntags: x, y\n---\n# Autre\n')
    (tmp_path / "vault" / "b.md").write_text("intro\n# Deux\n")
    (tmp_path / "vault" / "c.md").write_text("rien")
    rows = {r["title"]: r for r in readers.index_notes(spark, str(tmp_path / "vault")).collect()}
    assert set(rows) == {"Un", "Deux", "c"}
    assert rows["Un"]["aliases"] == ["Premier", "Le un"] and rows["Un"]["tags"] == ["x", "y"]


def test_srt_counts_left_out_cues_and_splits_long_files(spark):
    seg = spark.createDataFrame(
        [(1, 1, 0.0, 1.5, "Bonjour", "A"), (1, 2, 1.5, 2.0, "", None), (1, 3, 2.0, 3.25, "mot " * 15, None)],
        "doc_id long, seg_idx long, start double, end double, text string, speaker string",
    )
    text = R.whole(R.render_srt(seg)).first()["content"]
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,500\nA: Bonjour\n\n3\n00:00:02,000 --> 00:00:03,250\nmot mot")
    assert max(map(len, text.split("\n"))) <= 42
    many = spark.range(1, 5001).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("seg_idx"), F.col("id").cast("double").alias("start"),
        (F.col("id") + 0.5).alias("end"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("speaker"),
    )
    pieces = R.render_srt(many)
    assert pieces.count() == 3
    assert R.whole(pieces).first()["content"].count(" --> ") == 5000


def test_pieces_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(d, s, f"{d}-{s}") for d in (1, 2) for s in range(20)], "doc_id long, seq long, content string")
    X.write_pieces(df.repartition(7), str(tmp_path / "out"))
    folder = tmp_path / "out" / "doc_id=2"
    text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert text.split() == [f"2-{s}" for s in range(20)]


def test_course_export_replaces_a_renamed_course(spark, tmp_path):
    def job(title):
        return spark.createDataFrame([(1, "f.mp3", title, "done", dt.datetime(2024, 1, 2), None), (65, "g.mp3", "G", "done", dt.datetime(2024, 1, 2), None)],
                                     "doc_id long, filename string, title string, status string, created_at timestamp, summary string")
    text = spark.createDataFrame([(1, 0, "corps"), (65, 0, "autre")], "doc_id long, part long, content string")
    for title in ("Vieux titre", "Nouveau titre"):
        X.export_courses(job(title), text, str(tmp_path / "courses"))
    paths = {r["path"] for r in spark.read.parquet(str(tmp_path / "courses")).select("path").distinct().collect()}
    assert paths == {"2024-01-02-Nouveau-titre-1.md", "2024-01-02-G-65.md"}


def test_course_export_of_some_documents_keeps_the_others(spark, tmp_path):
    schema = "doc_id long, filename string, title string, status string, created_at timestamp, summary string"
    day, root = dt.datetime(2024, 1, 2), str(tmp_path / "some")
    job = lambda d, status="done": (d, "f.mp3", f"T{d}", status, day, None)
    text = spark.createDataFrame([(d, 0, f"corps {d}") for d in (1, 2, 65)], "doc_id long, part long, content string")
    for batch in ([job(1), job(65), job(2)], [job(1)], [job(2, "queued")]):  # 1 and 65 share a bucket; 2 leaves its own
        X.export_courses(spark.createDataFrame(batch, schema), text, root)
    got = X.read_courses(spark, root).filter("content like '%corps%'")
    assert sorted(r["content"].strip() for r in got.collect()) == ["corps 1", "corps 65"]


def parts_of(spark, docs, *, note="note", cards=True, lines=None, terms=(), stubs=()):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    made = {
        "notes": frame([(d, n, f"{note} {d}.{n}") for d in docs for n in range(d)], "doc_id long, seq long, content string"),
        "flashcards": frame([(d, 0, f"cards {d}") for d in docs if cards], "doc_id long, seq long, content string"),
        "index": frame([(f"n{d}", lines or f"line {d}") for d in docs], "link string, line string"),
        "glossary": frame([(t, "x") for t in terms], "term string, content string"),
        "entities": frame(list(stubs), "path string, content string"),
        "jobs": frame([(d, "published") for d in docs], "doc_id long, status string"),
    }
    return made


def published(spark, root, name, column="content"):
    return sorted(r[column] for r in X.read_publication(spark, root, name).collect())


def test_partial_runs_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert X.read_publication(spark, root, "notes") is None and X.read_manifest(spark, root) is None
    X.write_publication(parts_of(spark, [1, 2], terms=["a", "b"], stubs=[("e.md", "first"), ("f.md", "first")]), root)
    X.write_publication(parts_of(spark, [3], terms=["c"], stubs=[("e.md", "second"), ("g.md", "second")]), root)
    assert published(spark, root, "notes") == ["note 1.0", "note 2.0", "note 2.1", "note 3.0", "note 3.1", "note 3.2"]
    assert published(spark, root, "jobs", "doc_id") == [1, 2, 3] and published(spark, root, "index", "line") == ["line 1", "line 2", "line 3"]
    assert published(spark, root, "glossary", "term") == ["c"]
    assert sorted(map(tuple, X.read_publication(spark, root, "entities").collect())) == [("e.md", "first"), ("f.md", "first"), ("g.md", "second")]
    X.write_publication(parts_of(spark, [2], note="new", cards=False, lines="again"), root)  # without cards: the old ones go
    assert published(spark, root, "notes") == ["new 2.0", "new 2.1", "note 1.0", "note 3.0", "note 3.1", "note 3.2"]
    assert published(spark, root, "flashcards") == ["cards 1", "cards 3"] and published(spark, root, "index", "line") == ["again", "line 1", "line 3"]
    before = {n: published(spark, root, n, c) for n, c in (("notes", "content"), ("flashcards", "content"), ("entities", "path"), ("jobs", "doc_id"))}
    X.compact_publication(spark, root)
    assert X.read_manifest(spark, root).count() == 1
    assert {n: published(spark, root, n, c) for n, c in (("notes", "content"), ("flashcards", "content"), ("entities", "path"), ("jobs", "doc_id"))} == before
    X.write_publication(parts_of(spark, [1], note="last"), root)
    assert published(spark, root, "notes")[0] == "last 1.0" and len(published(spark, root, "notes")) == 6


def test_a_failed_run_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "failed")
    X.write_publication(parts_of(spark, [1, 2]), root)
    broken = parts_of(spark, [1, 4], note="half")
    broken["index"] = broken["index"].withColumn("line", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        X.write_publication(broken, root, run="r2")
    assert published(spark, root, "notes") == ["note 1.0", "note 2.0", "note 2.1"] and published(spark, root, "jobs", "doc_id") == [1, 2]
    X.write_publication(parts_of(spark, [1, 4], note="whole"), root, run="r2")  # the same run again
    assert published(spark, root, "notes") == ["note 2.0", "note 2.1", "whole 1.0", *[f"whole 4.{n}" for n in range(4)]]
    assert X.lost_rows(spark, root).count() == 0


def test_a_lost_part_is_told(spark, tmp_path):
    root = str(tmp_path / "lost")
    X.write_publication(parts_of(spark, [1, 2]), root)
    fields = spark.createDataFrame([], "doc_id long, seq long, content string").schema.json()
    row = [("r9", 2, False, [("notes", 5, fields), ("briefs", 2, fields)])]
    spark.createDataFrame(row, X.MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    assert sorted(map(tuple, X.lost_rows(spark, root).select("name", "rows", "found").collect())) == [("briefs", 2, 0), ("notes", 5, 0)]
    with pytest.raises(FileNotFoundError):
        X.read_publication(spark, root, "briefs")
    assert published(spark, root, "notes") == ["note 1.0", "note 2.0", "note 2.1"]


def test_json_holds_every_part(spark):
    jobs = spark.createDataFrame([(1, "f.mp3", 2.5, 'T "q"', None, "raw\n"), (2, "g", None, None, '["a"]', "")], "doc_id long, filename string, duration double, title string, summary string, raw_text string")
    text = spark.createDataFrame([(1, 0, "AAA"), (1, 1, 'B"B\nB')], "doc_id long, part long, content string")
    seg = spark.createDataFrame([(1, i, f"s{i}") for i in range(1, 5001)], "doc_id long, seg_idx long, text string")
    found = spark.createDataFrame([(1, "haute", 1.0, "x"), (1, "haute", 1.0, "x"), (1, "basse", None, "y")], "doc_id long, severity string, start double, message string")
    files = {r["doc_id"]: json.loads(r["content"]) for r in R.whole(R.render_json(jobs, text, seg, None, found)).collect()}
    one, two = files[1], files[2]
    assert one["texte_relu"] == ["AAA", 'B"B\nB'] and [s["text"] for s in one["segments"]] == [f"s{i}" for i in range(1, 5001)]
    assert one["verification"]["haute"] == 2 and len(one["verification"]["constats"]) == 3 and one["blocs_revision"] == []
    assert two["titre"] is None and two["resume"] == ["a"] and two["texte_relu"] == [] and two["moteur"] is None


def event(job, i, seconds, status, stage="s"):
    return (job, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds), status, stage, 0.5)


def run(spark, tmp_path, batches, make, name):
    """Feed one file per micro-batch and collect what comes out."""
    src, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
    rows = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = make(spark.readStream.schema(EVENTS).parquet(src))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_status_feed_remembers_across_batches(spark, tmp_path):
    batches = [[event(1, 1, 0, "queued"), event(1, 2, 1, "queued"), event(2, 3, 2, "running")], [event(1, 4, 5, "queued"), event(1, 5, 6, "running")]]
    got = run(spark, tmp_path, batches, S.stream_status_feed, "feed")
    assert sorted(r["event_id"] for r in got) == [1, 3, 5]


def test_throttle_is_equal_in_batch_and_stream(spark, tmp_path):
    rows = [event(1, i, t, "running", "a" if t < 9 else "b") for i, t in enumerate([0, 1, 1.5, 2, 3, 3.9, 4.1, 9, 9.5, 20])]
    want = sorted(r["event_id"] for r in S.progress_throttle(spark.createDataFrame(rows, EVENTS), 2.0).collect())
    assert want == [0, 3, 6, 7, 9]
    got = run(spark, tmp_path, [rows[:4], rows[4:]], lambda s: S.stream_progress_throttle(s, 2.0), "throttle")
    assert sorted(r["event_id"] for r in got) == want


def test_feed_shows_any_change_and_drops_late_rows(spark, tmp_path):
    batches = [[event(1, 1, 0, "running", "a"), event(1, 2, 1, "running", "b"), event(2, 3, 4000, "queued")], [event(1, 4, 2, "done"), event(2, 5, 4001, "running")]]
    got = run(spark, tmp_path, batches, lambda s: S.stream_status_feed(s, watermark="10 minutes"), "late")
    assert sorted(r["event_id"] for r in got) == [1, 2, 3, 5]  # 4 lies behind the watermark


def test_interrupted_jobs_by_timer(spark, tmp_path):
    batches = [[event(1, 1, 0, "running"), event(2, 2, 0, "running")], [event(2, 3, 30, "done"), event(3, 4, 4000, "queued")], [event(3, 5, 9000, "queued")]]
    got = run(spark, tmp_path, batches, lambda s: S.stream_interrupted(s, 60, "10 seconds"), "idle")
    assert [r["job_id"] for r in got] == [1]


def test_illegal_steps(spark):
    rows = [event(1, 1, 0, "queued"), event(1, 2, 1, "running"), event(1, 3, 2, "queued"), event(1, 4, 3, "published")]
    got = S.stage_progression(spark.createDataFrame(rows, EVENTS)).filter("not legal").collect()
    assert [r["event_id"] for r in got] == [4]


def test_streamed_findings_use_the_lexicon_and_can_run_again(spark, tmp_path):
    from test_edits_and_matches import lexicon

    schema = "doc_id long, block_id string, start double, raw string, clean string"
    src = str(tmp_path / "pairs")
    spark.createDataFrame([(1, "b", 0.0, "la DIPM dit 12", "la DIPEM dit")], schema).write.parquet(src)
    out = str(tmp_path / "found")
    for _ in range(2):
        q = S.write_findings(spark.readStream.schema(schema).parquet(src), lexicon(spark, ["DIPM"]), out, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    kinds = sorted((r["kind"], r["severity"]) for r in spark.read.parquet(out).collect())
    assert kinds == [("chiffre", "haute"), ("lexique", "basse"), ("terme", "haute")]


def test_streams_read_a_table_in_parts(spark, tmp_path):
    from scriptorium.plans import stream_queries as Q

    rows = [(i, i % 3, dt.datetime(2024, 1, 1, 0, i), "view", 1.0) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    docs = spark.createDataFrame([(i, f"Oui. Il dit {i + 10}.", "fr", "web") for i in range(12)], "doc_id long, text string, lang string, source string")
    cases = spark.createDataFrame([(1, "dipm acteur")], "item_id long, text string")
    whole, parts, none = (str(tmp_path / x) for x in ("whole", "parts", "none"))
    for folder, n, keep in ((whole, 1, True), (parts, 4, True), (none, 1, False)):
        for name, df in (("events", events), ("documents", docs), ("benchmark", cases)):
            df.filter(F.lit(keep) | F.lit(name == "benchmark")).repartition(n).write.parquet(f"{folder}/{name}.parquet")
    os.mkdir(tmp_path / "file")
    for name in ("events", "documents", "benchmark"):
        [part] = (tmp_path / "whole" / f"{name}.parquet").glob("part-*.parquet")
        (tmp_path / "file" / f"{name}.parquet").write_bytes(part.read_bytes())
    keys = ["view:0", "view:1", "view:2"]
    got = lambda d: sorted(tuple(r) for r in Q.stream_findings(spark, d).collect())
    for folder in (str(tmp_path / "file"), whole, parts):
        assert sorted(r["key"] for r in Q.stream_claim_dedupe(spark, folder).collect()) == keys
    assert got(parts) == got(str(tmp_path / "file")) != []
    assert got(none) == [] and Q.stream_claim_dedupe(spark, none).count() == 0


def test_checkpoint_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named if named else os.path.isdir(shared_dir(spark))


def test_anchors_of_one_common_title_count_over_all_parts(spark):
    courses = [(f"cours/2024/promotion/matin/{n:04d}.md", "# Droit\n\ntexte" if n % 3 else f"# Titre {n % 5}\n") for n in range(300)]
    out = R.compile_master(spark.createDataFrame(courses, "path string, content string").repartition(7)).filter("section = 1").orderBy("path").collect()
    seen = {}
    for (path, content), row in zip(sorted(courses), out):
        title = content.split("\n")[0][2:]
        slug = title.lower().replace(" ", "-")
        seen[slug] = seen.get(slug, 0) + 1
        assert row["path"] == path and row["content"] == f"- [{title}](#{slug}{'' if seen[slug] == 1 else f'-{seen[slug]}'})"
