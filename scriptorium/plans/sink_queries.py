"""Rendered files as pieces, and index upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import findings as N, joins as J, library as Y
from ..operators.claims import verdict_entities
from ..session import shared_dir
from ..sinks import render as R, write as X
from ..sources import bindings as B
from . import sqlkit as S
from .claims_queries import ENT, VERD, verdicts
from .findings_queries import PLAIN
from .registry import query, with_
from .sequence_queries import TURNS, WRAP

SEC = R.SECTION


def editorial(spark, d):
    jobs = B.jobs(spark, d)
    return jobs.select("doc_id", F.lit(0).cast("bigint").alias("part"), F.coalesce("clean_text", "raw_text").alias("content"))


CUES = "cues AS (SELECT s.doc_id, s.seg_idx, s.\"start\", s.\"end\", done || line AS t FROM r JOIN seg s ON s.doc_id = r.doc_id AND s.seg_idx = r.seg_idx WHERE i = len(w))"
_cue = lambda sep: f"{S.timecode(chr(34) + 'start' + chr(34), sep)} || ' --> ' || {S.timecode(chr(34) + 'end' + chr(34), sep)}"


@query("render_srt", with_(B.SEG, WRAP, CUES) + f"SELECT doc_id, (seg_idx - 1) // 2048 AS seq, string_agg(seg_idx || chr(10) || {_cue(',')} || chr(10) || t || chr(10), chr(10) ORDER BY seg_idx) AS content FROM cues GROUP BY ALL")
def render_srt(spark, d):
    return R.render_srt(B.segments(spark, d))


@query("render_vtt", with_(B.SEG, WRAP, CUES) + f"""SELECT doc_id, {SEC} + (seg_idx - 1) // 2048 AS seq, string_agg({_cue('.')} || chr(10) || t || chr(10), chr(10) ORDER BY seg_idx) AS content FROM cues GROUP BY ALL
   UNION ALL SELECT DISTINCT doc_id, 0, 'WEBVTT' || chr(10) FROM seg""")
def render_vtt(spark, d):
    return R.render_vtt(B.segments(spark, d))


@query("render_txt", with_(B.JOBS) + "SELECT doc_id, 0::BIGINT AS seq, coalesce(clean_text, raw_text) AS content FROM jobs")
def render_txt(spark, d):
    return R.render_txt(editorial(spark, d))


COURSE = f"""
course AS (SELECT doc_id, 0::BIGINT AS seq, '# ' || coalesce(title, filename) AS content FROM jobs
  UNION ALL SELECT doc_id, 2 * {SEC}, chr(10) || '## En bref' || chr(10) || chr(10) || '- point ' || doc_id || chr(10) || '- ' || tags[1] FROM jobs WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 3 * {SEC}, chr(10) || coalesce(clean_text, raw_text) FROM jobs)
"""


@query("render_course", with_(B.JOBS, COURSE) + "SELECT * FROM course")
def render_course(spark, d):
    return R.render_course(B.jobs(spark, d), editorial(spark, d))


LINES = f"""
fl AS (SELECT doc_id, 4 * {SEC} + 1 + CASE severity WHEN 'haute' THEN 0 WHEN 'moyenne' THEN 1 ELSE 2 END * {1 << 36} + round_even("start" * 1000, 0)::BIGINT AS seq,
  '- **' || split_part({S.timecode('"start"')}, ',', 1) || '** (' || severity || ') — ' || message AS line FROM find)
"""


@query(
    "render_markdown",
    with_(B.SEG, B.PAIR, PLAIN, B.JOBS, COURSE, LINES)
    + f"""SELECT * FROM course UNION ALL SELECT doc_id, seq, line FROM fl
      UNION ALL SELECT DISTINCT doc_id, 4 * {SEC}, chr(10) || '## À contrôler' || chr(10) || chr(10) || '_Relevés par les règles ; l''enregistrement tranche._' || chr(10) FROM find""",
)
def render_markdown(spark, d):
    return R.render("md", B.jobs(spark, d), B.segments(spark, d), editorial(spark, d), N.rule_findings(B.pairs(spark, d)))


@query(
    "render_json",
    with_(B.SEG, B.PAIR, PLAIN, B.JOBS)
    + """SELECT doc_id, filename AS fichier, title AS titre, duration AS duree, CASE WHEN doc_id % 2 = 0 THEN 'point ' || doc_id || '|' || tags[1] ELSE '' END AS resume, md5(raw_text) AS brut,
      md5(coalesce(clean_text, raw_text)) AS relu, coalesce(n_segments, 0) AS n_segments, coalesce(segment_texts, md5('')) AS segment_texts, coalesce(n_segments, 0) AS n_blocks,
      coalesce(haute, 0) AS haute, coalesce(moyenne, 0) AS moyenne, coalesce(n_find, 0) AS n_findings
    FROM jobs LEFT JOIN (SELECT doc_id, count(*) AS n_segments, md5(string_agg(text, '|' ORDER BY seg_idx)) AS segment_texts FROM seg GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (severity = 'haute') AS haute, count(*) FILTER (severity = 'moyenne') AS moyenne, count(*) AS n_find FROM find GROUP BY doc_id) USING (doc_id)""",
)
def render_json(spark, d):
    """The files, joined from their pieces and parsed again."""
    seg = B.segments(spark, d).select("doc_id", "seg_idx", "start", "end", "text", "speaker")
    blocks = seg.select("doc_id", F.col("seg_idx").alias("pos"), F.concat(F.lit("segment-"), F.col("seg_idx").cast("string")).alias("block_id"), "text")
    files = R.whole(R.render_json(B.jobs(spark, d), editorial(spark, d), seg, blocks, N.rule_findings(B.pairs(spark, d))))
    shape = (
        "fichier string, titre string, duree_secondes double, resume array<string>, texte_brut string, texte_relu array<string>, segments array<struct<text:string>>, "
        "blocs_revision array<struct<block_id:string>>, verification struct<haute:bigint,moyenne:bigint,constats:array<struct<kind:string>>>"
    )
    j = files.select("doc_id", F.from_json("content", shape, {"mode": "FAILFAST"}).alias("j"))
    size = lambda c: F.size(c).cast("bigint")
    return j.select(
        "doc_id", "j.fichier", "j.titre", F.col("j.duree_secondes").alias("duree"), F.array_join("j.resume", "|").alias("resume"), F.md5("j.texte_brut").alias("brut"),
        F.md5(F.array_join("j.texte_relu", "\n\n")).alias("relu"), size("j.segments").alias("n_segments"),
        F.md5(F.array_join(F.transform("j.segments", lambda s: s["text"]), "|")).alias("segment_texts"), size("j.blocs_revision").alias("n_blocks"),
        "j.verification.haute", "j.verification.moyenne", size("j.verification.constats").alias("n_findings"),
    )


@query(
    "render_raw_turns",
    with_(B.SEG, TURNS, B.JOBS)
    + f"""SELECT doc_id, 0::BIGINT AS seq, '---' || chr(10) || 'type: brut' || chr(10) || 'titre: ' || coalesce(title, filename) || chr(10) || 'date: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, filename) || ' (brut)' || chr(10) AS content FROM jobs
      UNION ALL SELECT doc_id, {SEC} + (pos - 1) // 2048, string_agg('**[' || lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || '] ' || coalesce(speaker, 'Locuteur') || '** — ' || text || chr(10), chr(10) ORDER BY pos)
      FROM (SELECT *, floor("start")::BIGINT AS s FROM turns) GROUP BY doc_id, (pos - 1) // 2048""",
)
def render_raw_turns(spark, d):
    return R.render_raw_turns(B.jobs(spark, d), B.segments(spark, d))


@query(
    "render_flashcards",
    with_(B.SEG, B.JOBS)
    + f"""SELECT doc_id, {SEC} + (seg_idx - 1) // 2048 AS seq, string_agg(split_part(text, ' ', 1) || '::' || role, chr(10) ORDER BY seg_idx) AS content FROM seg WHERE split_part(text, ' ', 1) <> '' AND seg_idx % 3 = 0 GROUP BY ALL
      UNION ALL SELECT doc_id, 0, '---' || chr(10) || 'type: revision' || chr(10) || 'titre: ' || t || chr(10) || 'date: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# ' || t || ' — Révision' || chr(10) || chr(10) || '## Flashcards' || chr(10)
      FROM (SELECT *, coalesce(title, filename) AS t FROM jobs) WHERE doc_id IN (SELECT doc_id FROM seg)""",
)
def render_flashcards(spark, d):
    cards = B.segments(spark, d).select("doc_id", F.col("seg_idx").alias("pos"), F.when(F.col("seg_idx") % 3 == 0, F.substring_index("text", " ", 1)).otherwise(" ").alias("recto"), F.col("role").alias("verso"))
    return R.render_flashcards(B.jobs(spark, d), cards)


# the note of every document; {link} and {raw} are what a publication adds
NOTE = """
pts AS (SELECT doc_id, count(*) FILTER (verdict <> 'confirme') AS n FROM verd GROUP BY doc_id),
ents AS (SELECT doc_id, field, list('"[[' || link || ']]"' ORDER BY pos) AS l FROM (
    SELECT doc_id, CASE type WHEN 'nom_propre' THEN 'personnes' WHEN 'organisme' THEN 'organismes' WHEN 'reference_juridique' THEN 'references' END AS field, {link} AS link, min(pos) AS pos
    FROM (SELECT *, trim(citation) AS name FROM verd WHERE verdict = 'confirme') {nk} GROUP BY ALL) WHERE field IS NOT NULL GROUP BY doc_id, field),
alia AS (SELECT doc_id, list(CASE WHEN regexp_matches(a, '[:#{{}}\\[\\]&*!|>''"%@`,]') OR a <> trim(a) THEN '"' || a || '"' ELSE a END ORDER BY pos) AS l FROM (SELECT doc_id, name || ' → ' || {link} AS a, min(pos) AS pos FROM (SELECT *, trim(citation) AS name FROM verd WHERE verdict = 'confirme') {nk} WHERE name <> {link} GROUP BY ALL) GROUP BY doc_id),
st AS (SELECT jobs.*, coalesce(n, 0) AS n, CASE WHEN status NOT IN ('checked', 'published') THEN 'non_verifie' WHEN coalesce(n, 0) > 0 THEN 'incertain' ELSE 'verifie' END AS note_status FROM jobs LEFT JOIN pts USING (doc_id)),
note AS (
  SELECT doc_id, 0::BIGINT AS seq, concat_ws(chr(10), '---', 'type: note', 'domaine: droit', 'statut_verification: ' || note_status, 'points_incertains: ' || n, 'titre: ' || coalesce(title, filename),
    'date: ' || strftime(created_at, '%Y-%m-%d'), 'source_fichier: ' || filename, {raw} 'duree_minutes: ' || round(duration / 60, 1), 'moteur: ""', 'modele: ""', 'relecture: ""',
    'personnes: [' || coalesce((SELECT array_to_string(l, ', ') FROM ents WHERE ents.doc_id = st.doc_id AND field = 'personnes'), '') || ']',
    'organismes: [' || coalesce((SELECT array_to_string(l, ', ') FROM ents WHERE ents.doc_id = st.doc_id AND field = 'organismes'), '') || ']',
    'references: [' || coalesce((SELECT array_to_string(l, ', ') FROM ents WHERE ents.doc_id = st.doc_id AND field = 'references'), '') || ']',
    'aliases_entites: [' || coalesce((SELECT array_to_string(l, ', ') FROM alia WHERE alia.doc_id = st.doc_id), '') || ']',
    'tags: [cours' || CASE WHEN note_status <> 'verifie' THEN ', à-vérifier' ELSE '' END || ']', 'job_id: ' || doc_id, '---') || chr(10) || chr(10)
    || CASE note_status WHEN 'verifie' THEN '> [!success] Contrôle terminé, rien à signaler' WHEN 'incertain' THEN '> [!warning] Points incertains : ' || n || chr(10) || '> Chacun est suivi d''un appel de note ; à lever avant toute citation.'
       ELSE '> [!warning] Contrôle non fait' || chr(10) || '> Aucun fait de ce texte n''a encore été confronté à des sources.' END AS content FROM st
  UNION ALL SELECT doc_id, {sec}, chr(10) || '## En bref' || chr(10) || chr(10) || '- point ' || doc_id || chr(10) || '- ' || tags[1] FROM jobs WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 2 * {sec}, chr(10) || coalesce(clean_text, raw_text) FROM jobs WHERE coalesce(clean_text, raw_text) <> '')
"""
DOMAIN = {"tags": ("cours",), "domain": "droit"}


@query("render_note", with_(B.SEG, B.CLAIM, VERD, B.JOBS, NOTE.format(link="name", nk="", raw="", sec=SEC)) + "SELECT doc_id, seq, content FROM note")
def render_note(spark, d):
    v = verdicts(spark, d)
    points = Y.uncertain_points(v.filter("verdict <> 'confirme'").select("doc_id", F.lit("fait").alias("kind")))
    jobs = B.jobs(spark, d).withColumn("fact_checked", F.lit(True))
    ent = verdict_entities(v)
    return R.render_note(jobs, editorial(spark, d), points, Y.entities_by_field(ent), Y.entity_aliases(ent), **DOMAIN)


@query("note_status", with_(B.SEG, B.CLAIM, VERD, B.JOBS) + """SELECT doc_id, CASE WHEN status NOT IN ('checked', 'published') THEN 'non_verifie' WHEN n > 0 THEN 'incertain' ELSE 'verifie' END AS note_status FROM jobs
   LEFT JOIN (SELECT doc_id, count(*) AS n FROM verd WHERE verdict = 'infirme' GROUP BY doc_id) USING (doc_id)""")
def note_status(spark, d):
    v = verdicts(spark, d).filter("verdict = 'infirme'").select("doc_id", F.lit("fait").alias("kind"))
    jobs = B.jobs(spark, d).withColumn("fact_checked", F.lit(True)).join(Y.uncertain_points(v), "doc_id", "left")
    return jobs.select("doc_id", R.note_status().alias("note_status"))


MASTER = f"""
ms AS (SELECT path, title, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'cours') AS slug, body
  FROM (SELECT lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, coalesce(title, filename) AS title, regexp_replace(coalesce(clean_text, raw_text), '^\\s+|\\s+$', '', 'g') AS body FROM jobs)),
mr AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY path) AS n FROM ms)
"""


@query(
    "compile_master",
    with_(B.JOBS, MASTER)
    + """SELECT 1::BIGINT AS section, path, '- [' || title || '](#' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END || ')' AS content FROM mr
      UNION ALL SELECT 2, path, '---' || chr(10) || chr(10) || '## ' || title || chr(10) || CASE WHEN body <> '' THEN chr(10) || body || chr(10) ELSE '' END FROM mr""",
)
def compile_master(spark, d):
    courses = B.jobs(spark, d).select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), R.title_of(), F.lit("\n\n"), F.coalesce("clean_text", "raw_text")).alias("content"),
    )
    return R.compile_master(courses).withColumn("section", F.col("section").cast("bigint"))


@query("export_courses", with_(B.JOBS, COURSE) + "SELECT doc_id, seq, md5(content) AS h, doc_id % 64 AS bucket FROM course WHERE doc_id IN (SELECT doc_id FROM jobs WHERE status IN ('done', 'checked', 'published'))")
def export_courses(spark, d):
    return X.export_courses(B.jobs(spark, d), editorial(spark, d)).select("doc_id", "seq", F.md5("content").alias("h"), "bucket")


@query(
    "missing_entities",
    with_(B.SEG, B.CLAIM, VERD, B.NOTES, ENT)
    + f"""SELECT path FROM (SELECT DISTINCT 'Entites/' || trim(regexp_replace(citation, '[\\\\/:*?"<>|\\x00-\\x1f]', '', 'g')) || '.md' AS path FROM verd WHERE verdict = 'confirme' AND {S.norm_title('citation')} NOT IN (SELECT name_key FROM nk))""",
)
def missing_entities(spark, d):
    notes = B.notes(spark, d)
    ent = J.resolve_entities(verdict_entities(verdicts(spark, d)), notes)
    return X.missing_entities(ent, notes, "Entites").select("path")


@query(
    "index_lines",
    with_(B.JOBS) + """SELECT doc_id, '- [[' || filename || ']] · ' || round_even(duration / 60, 0)::BIGINT || ' min' || CASE WHEN doc_id % 3 > 0 THEN ' · ⚠️ ' || (doc_id % 3) || ' point' || CASE WHEN doc_id % 3 > 1 THEN 's' ELSE '' END || ' à vérifier' ELSE ' · ✅' END AS line FROM jobs""",
)
def index_lines(spark, d):
    jobs = B.jobs(spark, d).select("doc_id", R.index_line(F.col("filename"), F.col("duration") / 60, F.col("doc_id") % 3).alias("line"))
    old = jobs.withColumn("line", F.lit("ancienne")).filter("doc_id % 2 = 0")
    return X.upsert_lines(old, jobs, "doc_id")


@query("add_themes", "SELECT DISTINCT '- [[' || source || ']]' AS line FROM documents WHERE source NOT IN ('src1', 'src2')")
def add_themes(spark, d):
    themes = B.documents(spark, d).select(F.col("source").alias("theme"))
    old = themes.filter("theme in ('src1', 'src2')").select(F.concat(F.lit("- [["), "theme", F.lit("]]")).alias("line")).distinct()
    return X.add_themes(old, themes)


@query(
    "replace_region_line",
    with_(B.SEG) + """SELECT doc_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN text || '<a>' || chr(10) || CASE WHEN seg_idx % 3 = 0 THEN 'x' || chr(10) ELSE '' END || 'l' || chr(10) || '</a>z' || chr(10)
      ELSE regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || '<a>' || chr(10) || 'l' || chr(10) || '</a>' || chr(10) END AS content FROM seg""",
)
def replace_region_line(spark, d):
    i = F.col("seg_idx")
    inside = F.when(i % 3 == 0, F.lit("<a>\n\nl\nx\n</a>z  ")).otherwise(F.lit("<a>\n l \n</a>z"))
    content = F.when(i % 2 == 0, F.concat("text", inside)).otherwise(F.col("text"))
    return B.segments(spark, d).select("doc_id", "seg_idx", R.replace_region_line(content, "<a>", "</a>", F.lit("l")).alias("content"))


@query("replace_syntheses", "SELECT source AS name, count(*) AS n, bool_and(false) AS archived FROM documents GROUP BY source UNION ALL SELECT source, 1, true FROM documents WHERE source <> 'src3' GROUP BY source")
def replace_syntheses(spark, d):
    now = B.documents(spark, d).groupBy(F.col("source").alias("name")).agg(F.count("*").cast("string").alias("content"))
    old = now.select("name", F.when(F.col("name") == "src3", "").otherwise("ancien").alias("content"))
    cur, arch = X.replace_syntheses(old, now, F.lit("2024-06-01"))
    return cur.select("name", F.col("content").cast("bigint").alias("n"), F.lit(False).alias("archived")).unionByName(
        arch.select("name", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("archived")))


PUBLISHED = f"""
ready AS (SELECT *, regexp_replace(path, '^.*/|\\.md$', '', 'g') AS link FROM (SELECT *, coalesce(note_path, 'Notes/' || trim(regexp_replace(regexp_replace(strftime(created_at, '%Y-%m-%d') || ' — ' || coalesce(title, filename), '[\\\\/:*?"<>|\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g')) || '.md') AS path
  FROM jobs WHERE status IN ('done', 'checked', 'published'))),
items AS (
  SELECT 'notes' AS part, doc_id || '/' || seq || '/' || md5(content) AS item FROM note WHERE doc_id IN (SELECT doc_id FROM ready)
  UNION ALL SELECT 'raw_turns', doc_id || '/0' FROM ready
  UNION ALL SELECT DISTINCT 'raw_turns', turns.doc_id || '/' || ({SEC} + (pos - 1) // 2048) FROM turns JOIN ready USING (doc_id) WHERE text <> ''
  UNION ALL SELECT 'flashcards', doc_id || '/0/' || md5('---' || chr(10) || 'type: revision' || chr(10) || 'titre: ' || coalesce(title, filename) || chr(10) || 'date: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || 'note: "[[' || link || ']]"' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, filename) || ' — Révision' || chr(10) || chr(10) || '## Flashcards' || chr(10)) FROM ready WHERE doc_id IN (SELECT doc_id FROM seg)
  UNION ALL SELECT 'flashcards', doc_id || '/' || ({SEC} + (seg_idx - 1) // 2048) || '/' || md5(string_agg(role || '::' || text, chr(10) ORDER BY seg_idx)) FROM seg WHERE doc_id IN (SELECT doc_id FROM ready) GROUP BY doc_id, (seg_idx - 1) // 2048
  UNION ALL SELECT 'paths', path || '|' || regexp_replace(path, '\\.md$', '') || ' (brut).md' || '|' || regexp_replace(path, '\\.md$', '') || ' (cartes).md' FROM ready
  UNION ALL SELECT DISTINCT 'entities', 'Entites/' || trim(regexp_replace(citation, '[\\\\/:*?"<>|\\x00-\\x1f]', '', 'g')) || '.md' FROM verd JOIN ready USING (doc_id) WHERE verdict = 'confirme' AND {S.norm_title('citation')} NOT IN (SELECT name_key FROM nk)
  UNION ALL SELECT 'index', '- [[' || link || ']] · ' || round_even(duration / 60, 0)::BIGINT || ' min' || CASE WHEN n > 0 THEN ' · ⚠️ ' || n || ' point' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' à vérifier' ELSE ' · ✅' END FROM ready LEFT JOIN pts USING (doc_id)
  UNION ALL SELECT 'glossary', term FROM lex
  UNION ALL SELECT 'courses', course.doc_id || '/' || seq || '/' || md5(content) FROM course JOIN ready USING (doc_id)
  UNION ALL SELECT 'jobs', doc_id || '/' || path FROM ready)
"""


@query(
    "publish",
    with_(
        B.SEG, B.CLAIM, VERD, B.JOBS, B.NOTES, ENT, B.LEX, TURNS, COURSE,
        NOTE.format(
            link="coalesce(note_title, name)", nk=f"LEFT JOIN nk ON nk.name_key = {S.norm_title('name')}", sec=SEC,
            raw="""'brut: "[[' || regexp_replace(coalesce(note_path, 'Notes/' || trim(regexp_replace(regexp_replace(strftime(created_at, '%Y-%m-%d') || ' — ' || coalesce(title, filename), '[\\\\/:*?"<>|\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g')) || '.md'), '^.*/|\\.md$', '', 'g') || ' (brut)]]"',""",
        ),
        PUBLISHED,
    ) + "SELECT part, item FROM items",
)
def publish(spark, d):
    """One row per piece that a publication would write, with a digest of what it holds."""
    v = verdicts(spark, d)
    jobs = B.jobs(spark, d).withColumn("fact_checked", F.lit(True))
    facts = v.filter("verdict <> 'confirme'").select("doc_id", F.lit("fait").alias("kind"))
    seg = B.segments(spark, d)
    cards = seg.select("doc_id", F.col("seg_idx").alias("pos"), F.col("role").alias("recto"), F.col("text").alias("verso"))
    parts = X.publish(jobs, seg, editorial(spark, d), facts, verdict_entities(v), B.notes(spark, d), B.lexicon(spark, d), cards, **DOMAIN)
    one = lambda name, *c: parts[name].select(F.lit(name).alias("part"), F.concat_ws("/", *c).alias("item"))
    held = F.md5("content")
    return (
        one("notes", "doc_id", "seq", held).unionByName(one("raw_turns", "doc_id", "seq")).unionByName(one("flashcards", "doc_id", "seq", held))
        .unionByName(parts["paths"].select(F.lit("paths").alias("part"), F.concat_ws("|", "path", "raw_path", "cards_path").alias("item")))
        .unionByName(one("entities", "path")).unionByName(one("index", "line")).unionByName(one("glossary", "term"))
        .unionByName(one("courses", "doc_id", "seq", held)).unionByName(one("jobs", "doc_id", "path"))
    )


@query(
    "publication_runs",
    with_(B.SEG, B.JOBS, COURSE, """ready AS (SELECT * FROM jobs WHERE status IN ('done', 'checked', 'published')),
runs AS (
  SELECT 'courses' AS part, doc_id || '/' || seq || '/' || md5(CASE WHEN seq = 0 AND doc_id % 3 = 0 THEN '# ' || upper(substr(content, 3)) ELSE content END) AS item FROM course JOIN ready USING (doc_id)
  UNION ALL SELECT 'cards', seg.doc_id || '/' || seg_idx || '/' || md5(text) FROM seg JOIN ready USING (doc_id) WHERE seg.doc_id % 3 <> 0
  UNION ALL SELECT 'index', filename || '/' || (doc_id % 3 = 0) FROM ready
  UNION ALL SELECT 'jobs', doc_id || '/' || CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END FROM ready)""")
    + "SELECT part, item FROM runs",
)
def publication_runs(spark, d):
    """All finished documents in one run, every third one once more with another title and no cards; what readers then see."""
    root = f"{shared_dir(spark).rstrip('/')}/publication-{uuid.uuid4().hex}"
    jobs = B.jobs(spark, d).filter(F.col("status").isin("done", "checked", "published"))
    cards = B.segments(spark, d).select("doc_id", F.col("seg_idx").alias("seq"), F.col("text").alias("content"))
    for number, own in ((1, jobs), (2, jobs.filter("doc_id % 3 = 0").withColumn("title", F.upper(F.coalesce("title", "filename"))))):
        parts = {
            "courses": X.export_courses(own, editorial(spark, d)), "cards": cards.join(own.select("doc_id"), "doc_id", "left_semi") if number == 1 else cards.limit(0),
            "index": own.select("filename", (F.lit(number) == 2).alias("again")), "jobs": own.select("doc_id", F.lit(number).alias("run_number")),
        }
        X.write_publication(parts, root)
    one = lambda name, *c: X.read_publication(spark, root, name).select(F.lit(name).alias("part"), F.concat_ws("/", *[F.col(x).cast("string") if x != "content" else F.md5(x) for x in c]).alias("item"))
    return one("courses", "doc_id", "seq", "content").unionByName(one("cards", "doc_id", "seq", "content")).unionByName(one("index", "filename", "again")).unionByName(one("jobs", "doc_id", "run_number"))
