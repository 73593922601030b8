"""Claims, verdicts, corrections, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.edits import insert_links, place_headings
from ..operators import claims as C, joins as J, lexicon as L, sequence as Q
from ..sources import bindings as B
from . import sqlkit as S
from .findings_queries import LOOKUP, REFS, RESOLVE, names
from .registry import query, with_
from .sequence_queries import para_sql

AS_OF = "2024-06-01 00:00:00"
KEY = f"(type || ':' || {S.match_norm('citation')})"
NO_SOURCES = "array<struct<title:string,url:string>>"


def source_list(n, key):
    return F.when(n == 0, F.array().cast(NO_SOURCES)).otherwise(F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("title"), F.concat(F.lit("https://x/"), i.cast("string")).alias("url"))
    ))


def verdicts(spark, d):
    """A web verdict for each claim, by rule on its key."""
    c = C.keyed(B.claims(spark, d))
    c = c.withColumns(B.verdict_columns(F.col("key")))
    return c.withColumns({"sources": source_list(F.col("n_sources"), F.col("key")), "explanation": F.lit("Voir."), "origin": F.lit("web")})


VERD = f"""
verd AS (SELECT *, {B.VERDICT_COLS} FROM (SELECT *, {B.KEY_HASH} AS h FROM (SELECT *, {KEY} AS key FROM claim)))
"""


def cache(spark, d):
    keys = C.keyed(B.claims(spark, d)).select("key").distinct().withColumns(B.verdict_columns(F.col("key")))
    return keys.withColumn("created_at", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=F.col("age_days").cast("int")))


FRESH = "age_days <= CASE WHEN verdict IN ('introuvable', 'ambigu') THEN 7 ELSE 90 END"


SCOPE = (
    with_(B.SEG, B.CLAIM, B.LEX, B.LEX_NAMES, LOOKUP.format(src="(SELECT citation FROM claim WHERE type = 'organisme')", where=""))
    + r"""SELECT doc_id, pos, type, claim.citation, type IN ('reference_juridique', 'date') OR (type = 'organisme' AND (coalesce(category IN ('mesure', 'acteur', 'prestation', 'texte'), false)
      OR lower(claim.citation) IN ('jcp','greffe','procureur','parquet','prefecture','prefet','ddets','ddcs','ars','mdph','caf','cpam','carsat','msa','udaf','ati','cnc','anesm','has','cnape','fnat','unaf'))) AS in_scope
    FROM claim LEFT JOIN look ON type = 'organisme' AND look.citation = claim.citation"""
)


@query("claims_in_scope", SCOPE)
def claims_in_scope(spark, d):
    return C.with_scope(B.claims(spark, d), names(spark, d)).select("doc_id", "pos", "type", "citation", "in_scope")


@query("claims_skipped", f"SELECT doc_id, pos, type, citation FROM ({SCOPE}) WHERE NOT in_scope")
def claims_skipped(spark, d):
    """What is not checked, so that nothing is dropped in silence."""
    scoped = C.with_scope(B.claims(spark, d), names(spark, d))
    return scoped.filter(~F.col("in_scope")).select("doc_id", "pos", "type", "citation")


@query("verdict_cache", with_(B.SEG, B.CLAIM, VERD) + f"SELECT DISTINCT key, verdict, confidence FROM verd WHERE {FRESH}")
def verdict_cache(spark, d):
    keys = C.keyed(B.claims(spark, d)).select("key").distinct()
    return C.cache_lookup(keys, cache(spark, d), F.lit(AS_OF)).select("key", "verdict", "confidence")


RESOLVED = f"""
u AS (SELECT key, type, citation FROM (SELECT *, {KEY} AS key, row_number() OVER (PARTITION BY {KEY} ORDER BY pos, citation, doc_id) AS rn FROM claim) WHERE rn = 1)
"""


@query(
    "resolve_claims",
    with_(B.SEG, B.CLAIM, VERD, B.LEX, B.LEX_NAMES, RESOLVE, LOOKUP.format(src="claim", where="AND n.verified"), REFS)
    + f"""SELECT key, CASE WHEN t IS NOT NULL THEN 'confirme' ELSE cv END AS verdict, coalesce(t, cf) AS correct_form, CASE WHEN t IS NOT NULL THEN 'lexique' WHEN cv IS NOT NULL THEN 'cache' ELSE 'unresolved' END AS origin,
      CASE WHEN t IS NOT NULL THEN 'Terme du lexique, catégorie ' || category WHEN cv IS NOT NULL THEN 'Voir.' END AS explanation,
      CASE WHEN t IS NOT NULL THEN CASE WHEN h % 2 = 0 THEN 'https://x/' || t ELSE '' END WHEN cv IS NOT NULL THEN CASE ns WHEN 0 THEN '' WHEN 1 THEN 'https://x/1' ELSE 'https://x/1|https://x/2' END ELSE '' END AS urls
    FROM (SELECT k.key, coalesce(uq.term, b.term) AS t, v.verdict AS cv, v.correct_form AS cf, v.n_sources AS ns
      FROM (SELECT DISTINCT key, {S.norm_key("split_part(key, ':', 2)")} AS nk FROM verd) k
      LEFT JOIN uniq uq ON uq.name_key = k.nk
      LEFT JOIN (SELECT DISTINCT {S.norm_key('look.citation')} AS nk, look.term FROM look JOIN lex_names n ON n.term = look.term AND {S.norm_key('n.name')} = {S.norm_key('look.citation')}) b ON b.nk = k.nk
      LEFT JOIN (SELECT DISTINCT key, verdict, correct_form, n_sources FROM verd WHERE {FRESH}) v ON v.key = k.key) LEFT JOIN lex ON lex.term = t""",
)
def resolve_claims(spark, d):
    lex = B.lexicon(spark, d)
    held = cache(spark, d).withColumns({"explanation": F.lit("Voir."), "sources": source_list(F.col("n_sources"), F.col("key"))})
    r = C.resolve_claims(B.claims(spark, d), lex, L.lexicon_names(lex), held, F.lit(AS_OF))
    urls = F.array_join(F.transform("sources", lambda s: s["url"]), "|")
    return r.select("key", "verdict", "correct_form", "origin", "explanation", urls.alias("urls"))


@query("fan_out_verdicts", with_(B.SEG, B.CLAIM, VERD) + f"SELECT doc_id, pos, key, CASE WHEN {FRESH} THEN verdict END AS verdict FROM verd")
def fan_out_verdicts(spark, d):
    v = C.cache_lookup(C.keyed(B.claims(spark, d)).select("key").distinct(), cache(spark, d), F.lit(AS_OF)).select("key", "verdict")
    return C.fan_out(B.claims(spark, d), v).select("doc_id", "pos", "key", "verdict")


@query(
    "coerce_verdicts",
    with_(B.SEG, B.CLAIM, VERD)
    + """SELECT doc_id, pos, CASE WHEN n_sources > 0 OR age_days % 4 = 0 THEN CASE WHEN age_days % 9 = 0 THEN 'ambigu' ELSE verdict END ELSE 'introuvable' END AS verdict,
      CASE WHEN n_sources > 0 OR age_days % 4 = 0 THEN confidence ELSE 'basse' END AS confidence, CASE WHEN n_sources > 0 OR age_days % 4 = 0 THEN 'web' ELSE 'coerce' END AS origin,
      CASE WHEN n_sources > 0 THEN n_sources WHEN age_days % 8 = 0 THEN 1 ELSE 0 END AS n FROM verd""",
)
def coerce_verdicts(spark, d):
    v = verdicts(spark, d)
    age = F.col("age_days")
    raw = v.withColumns({
        "verdict": F.when(age % 9 == 0, "peut-être").otherwise(F.col("verdict")),
        "web_searches": F.when(age % 4 == 0, 1).otherwise(0),
        "web_sources": F.when(age % 8 == 0, F.array(F.lit("https://w"))).otherwise(F.array().cast("array<string>")),
    })
    return C.coerce_verdicts(raw).select("doc_id", "pos", "verdict", "confidence", "origin", F.size("sources").cast("bigint").alias("n"))


@query("cacheable_verdicts", with_(B.SEG, B.CLAIM, VERD) + "SELECT key, max(doc_id * 100000000 + pos) AS created_at, any_value(verdict) AS verdict FROM verd WHERE n_sources > 0 GROUP BY key")
def cacheable_verdicts(spark, d):
    v = verdicts(spark, d).withColumn("created_at", F.col("doc_id") * 100000000 + F.col("pos"))
    return C.cacheable(v).select("key", "created_at", "verdict")


@query(
    "anchor_claims",
    with_(B.SEG, B.CLAIM)
    + """SELECT c.doc_id, c.pos, c.citation, CASE WHEN a.n = 1 THEN a.block_id END AS block_id FROM claim c JOIN (
      SELECT k.doc_id, k.citation, count(*) AS n, min('segment-' || s.seg_idx) AS block_id FROM (SELECT DISTINCT doc_id, citation FROM claim) k JOIN seg s ON s.doc_id = k.doc_id AND contains(s.text, k.citation) GROUP BY ALL) a
    USING (doc_id, citation)""",
)
def anchor_claims(spark, d):
    blocks = B.segments(spark, d).select("doc_id", F.concat(F.lit("segment-"), F.col("seg_idx").cast("string")).alias("block_id"), "start", "text")
    return C.anchor_claims(B.claims(spark, d), blocks).select("doc_id", "pos", "citation", "block_id")


@query(
    "corrections_count",
    with_(B.SEG, B.CLAIM, VERD)
    + "SELECT doc_id, count(*) AS claims_checked, count(*) FILTER (verdict = 'corrige' AND confidence = 'haute' AND n_sources > 0 AND type NOT IN ('reference_juridique', 'statistique', 'date')) AS corrections FROM verd GROUP BY doc_id",
)
def corrections_count(spark, d):
    return C.corrections_count(verdicts(spark, d))


def applied(spark, d):
    return C.apply_verdicts(B.documents(spark, d).select("doc_id", "text"), verdicts(spark, d))


@query("apply_verdicts")
def apply_verdicts(spark, d):
    return applied(spark, d)[0]


@query("verdict_findings")
def verdict_findings(spark, d):
    return C.verdict_findings(applied(spark, d)[1])


@query("pending_corrections")
def pending_corrections(spark, d):
    return C.pending_corrections(applied(spark, d)[1])


@query("verdict_entities", with_(B.SEG, B.CLAIM, VERD) + "SELECT doc_id, pos, citation AS name, type AS category FROM verd WHERE verdict = 'confirme'")
def verdict_entities(spark, d):
    return C.verdict_entities(verdicts(spark, d)).select("doc_id", "pos", "name", "category")


@query(
    "decide_pending",
    with_(r"""w AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{4,}') AS citation FROM documents)""")
    + """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rejetee' WHEN doc_id % 3 = 1 AND citation <> '' THEN 'validee' ELSE 'attente' END AS status,
      md5(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '[^v1]: **« ' || citation || ' »** — proposition écartée par un relecteur.'
        WHEN doc_id % 3 = 1 AND citation <> '' AND p > 0 THEN substring(text, 1, p - 1) || 'NEUF' || substring(text, p + length(citation)) || chr(10) || '[^v1]: **« ' || citation || ' »** — corrigé en **NEUF** (accepté par un relecteur).'
        ELSE text || chr(10) || '[^v1]: **« ' || citation || ' »** — correction à valider.' END) AS h
    FROM (SELECT *, instr(lower(text), lower(citation)) AS p FROM w) WHERE citation <> ''""",
)
def decide_pending(spark, d):
    docs = B.documents(spark, d).withColumn("citation", F.regexp_extract("text", "[A-Za-z]{4,}", 0)).filter("citation <> ''")
    note = F.concat(F.lit("\n[^v1]: **« "), "citation", F.lit(" »** — correction à valider."))
    texts = docs.select("doc_id", F.concat("text", note).alias("text"))
    i = F.col("doc_id") % 3
    # the citation is looked for with letters and digits only, as its first exact place
    dec = docs.select(
        "doc_id", "citation", F.lit("NEUF").alias("proposition"), F.lit("[^v1]").alias("marker"), F.lit("attente").alias("status"),
        F.when(i == 0, "reject").when(i == 1, "accept").otherwise("later").alias("decision"),
    )
    return C.decide_pending(texts, dec).select("doc_id", "status", F.md5("text").alias("h"))


@query(
    "replace_in_blocks",
    with_(B.SEG) + """SELECT doc_id, seg_idx, len(string_split(text, 'tion')) = 2 AS applied, CASE WHEN len(string_split(text, 'tion')) = 2 THEN replace(text, 'tion', 'TION') ELSE text END AS text FROM seg""",
)
def replace_in_blocks(spark, d):
    blocks = B.segments(spark, d).select("doc_id", "seg_idx", F.concat(F.lit("segment-"), F.col("seg_idx").cast("string")).alias("block_id"), "text")
    dec = blocks.select("doc_id", "block_id", F.lit("tion").alias("citation"), F.lit("TION").alias("proposition"))
    return C.replace_in_blocks(blocks, dec).select("doc_id", "seg_idx", "applied", "text")


def proposals(spark, d):
    """A check result per lexicon term, by rule."""
    lex, h = B.lexicon(spark, d), F.col("h")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int"))
    return lex.select(
        "term", "h", pick(("confirme", "corrige", "erreur", "confirme", "ambigu")).alias("verdict"), pick(("haute", "moyenne", "basse")).alias("confidence"),
        pick(("attente", "attente", "validee", "rejetee")).alias("status"), source_list((h % 3).cast("int"), F.col("term")).alias("sources"),
    )


PROP = """
prop AS (SELECT term, h, ['confirme','corrige','erreur','confirme','ambigu'][h % 5 + 1] AS verdict, ['haute','moyenne','basse'][h % 3 + 1] AS confidence,
  ['attente','attente','validee','rejetee'][h % 4 + 1] AS status, h % 3 AS n FROM lex)
"""


@query("bulk_validable", with_(B.LEX, PROP) + "SELECT term FROM prop WHERE status = 'attente' AND verdict = 'confirme' AND confidence IN ('haute', 'moyenne') AND n > 0")
def bulk_validable(spark, d):
    return proposals(spark, d).filter(C.bulk_validable()).select("term")


@query("batch_verifiable", with_(B.LEX, PROP) + "SELECT term, verdict = 'confirme' AND confidence = 'haute' AND n > 0 AS ok FROM prop")
def batch_verifiable(spark, d):
    return proposals(spark, d).select("term", C.batch_verifiable().alias("ok"))


@query(
    "verified_terms",
    with_(B.LEX, PROP)
    + """SELECT lex.term, CASE WHEN status = 'attente' AND verdict <> 'erreur' THEN n > 0 ELSE verified END AS verified, CASE WHEN status = 'attente' AND verdict <> 'erreur' AND n > 0 THEN DATE '2024-06-01' END AS verified_on FROM lex JOIN prop USING (term)""",
)
def verified_terms(spark, d):
    return C.verified_terms(B.lexicon(spark, d), proposals(spark, d), "2024-06-01").select("term", "verified", "verified_on")


@query("proposal_upsert", with_(B.LEX, PROP) + "SELECT term, CASE WHEN h % 3 = 0 THEN 'neuf' ELSE verdict END AS verdict FROM prop")
def proposal_upsert(spark, d):
    p = proposals(spark, d).withColumn("seq", F.lit(1))
    again = p.filter("h % 3 = 0").withColumns({"seq": F.lit(2), "verdict": F.lit("neuf")})
    return C.latest(p.unionByName(again), ["term"], "seq").select("term", "verdict")


@query(
    "mark_proposals",
    with_(B.LEX, PROP) + """SELECT term, CASE WHEN h % 2 = 0 THEN 'validee' ELSE status END AS status, false AS refused FROM prop
      UNION ALL SELECT term || '?', 'validee', true FROM prop WHERE h % 7 = 0""",
)
def mark_proposals(spark, d):
    p = proposals(spark, d)
    dec = p.filter("h % 2 = 0").select("term", F.lit("validee").alias("status")).unionByName(
        p.filter("h % 7 = 0").select(F.concat("term", F.lit("?")).alias("term"), F.lit("validee").alias("status")))
    done, refused = C.mark_proposals(p, dec)
    return done.select("term", "status", F.lit(False).alias("refused")).unionByName(refused.select("term", "status", F.lit(True).alias("refused")))


@query("unverified_not_queued", with_(B.LEX) + "SELECT term FROM lex WHERE NOT verified AND h % 5 <> 0")
def unverified_not_queued(spark, d):
    lex = B.lexicon(spark, d)
    return lex.filter(~F.col("verified")).join(lex.filter("h % 5 = 0").select("term"), "term", "left_anti").select("term")


# ---- joins in time and by name ---------------------------------------------


@query(
    "pair_segments",
    with_(
        B.SEG,
        """p AS (SELECT doc_id, 'p' || seg_idx AS block_id, "start" + (seg_idx % 4) AS "start", "start" + (seg_idx % 4) + CASE WHEN seg_idx % 3 = 0 THEN 0 ELSE 5 END AS "end" FROM seg),
ov AS (SELECT p.doc_id, block_id, seg_idx FROM p JOIN seg s ON s.doc_id = p.doc_id AND s."end" > p."start" AND s."start" < p."end"),
rest AS (SELECT * FROM p ANTI JOIN ov USING (doc_id, block_id))""",
    )
    + """SELECT * FROM ov UNION ALL SELECT rest.doc_id, block_id, arg_min(seg_idx, {'d': abs(s."start" - rest."start"), 'i': seg_idx}) FROM rest JOIN seg s ON s.doc_id = rest.doc_id GROUP BY rest.doc_id, block_id""",
)
def pair_segments(spark, d):
    seg = B.segments(spark, d)
    i = F.col("seg_idx")
    p = seg.select("doc_id", F.concat(F.lit("p"), i.cast("string")).alias("block_id"), (F.col("start") + i % 4).alias("start"), (F.col("start") + i % 4 + F.when(i % 3 == 0, 0).otherwise(5)).alias("end"))
    return J.pair_segments(p, seg)


@query(
    "pair_attributes",
    with_(B.SEG)
    + """SELECT p.doc_id, 'p' || p.seg_idx AS block_id, CASE WHEN count(DISTINCT s.speaker) = 1 THEN max(s.speaker) END AS speaker, CASE WHEN count(DISTINCT s.role) = 1 THEN max(s.role) END AS role
    FROM seg p JOIN seg s ON s.doc_id = p.doc_id AND s."end" > p."start" AND s."start" < p."end" GROUP BY p.doc_id, p.seg_idx""",
)
def pair_attributes(spark, d):
    seg = B.segments(spark, d)
    p = seg.select("doc_id", F.concat(F.lit("p"), F.col("seg_idx").cast("string")).alias("block_id"), "start", "end")
    s = seg.select("doc_id", "seg_idx", F.col("start").alias("s"), F.col("end").alias("e"))
    src = J.interval_join(p, s, ["doc_id"], ("start", "end"), ("s", "e")).select("doc_id", "block_id", "seg_idx")
    return J.pair_attributes(src, seg)


@query(
    "retry_overlap",
    with_(B.SEG)
    + """SELECT c.doc_id, c.seg_idx AS clip, s.seg_idx FROM seg c JOIN seg s ON s.doc_id = c.doc_id AND s."end" >= greatest(0.0::DOUBLE, c."start" - 3) - 0.5::DOUBLE AND s."start" <= c."end" + 3 + 0.5::DOUBLE""",
)
def retry_overlap(spark, d):
    seg = B.segments(spark, d)
    clips = seg.select("doc_id", F.col("seg_idx").alias("clip"), F.greatest(F.lit(0.0), F.col("start") - 3).alias("clip_start"), (F.col("end") + 3).alias("clip_end"))
    return J.retry_overlap(clips, seg).select("doc_id", "clip", "seg_idx")


@query(
    "retry_selection",
    with_(
        B.SEG,
        """c AS (SELECT doc_id, seg_idx AS clip, greatest(0.0::DOUBLE, "start" - 3) AS cs, "end" - 2 AS ce FROM seg),
wd AS (SELECT doc_id, seg_idx, i, w[i] AS text, round("start" + (i - 1) * (("end" - "start") / len(w)), 3) AS ws, round("start" + i * (("end" - "start") / len(w)), 3) AS we
  FROM (SELECT doc_id, seg_idx, "start", "end", w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM seg))),
s AS (SELECT c.doc_id, c.clip, list(seg_idx ORDER BY seg_idx) AS seg_ids FROM c JOIN seg s ON s.doc_id = c.doc_id AND s."end" >= cs - 0.5::DOUBLE AND s."start" <= ce + 0.5::DOUBLE GROUP BY ALL),
w AS (SELECT c.doc_id, c.clip, count(*) AS n_words, trim(string_agg(text, ' ' ORDER BY seg_idx, i)) AS text FROM c JOIN wd ON wd.doc_id = c.doc_id AND we >= cs - 0.5::DOUBLE AND ws <= ce + 0.5::DOUBLE GROUP BY ALL)""",
    )
    + """SELECT c.doc_id, c.clip, coalesce(seg_ids, []) AS seg_ids, coalesce(n_words, 0) AS n_words, coalesce(w.text, '') AS text FROM c LEFT JOIN s USING (doc_id, clip) LEFT JOIN w USING (doc_id, clip)""",
)
def retry_selection(spark, d):
    seg = B.segments(spark, d)
    clips = seg.select("doc_id", F.col("seg_idx").alias("clip"), F.greatest(F.lit(0.0), F.col("start") - 3).alias("clip_start"), (F.col("end") - 2).alias("clip_end"))
    known = seg.select("doc_id", "seg_idx", "start", "end", "text", B.words_of(F.col("text"), F.col("start"), F.col("end")).alias("words"))
    return J.retry_selection(clips, known).select("doc_id", "clip", "seg_ids", F.size("words").cast("bigint").alias("n_words"), "text")


@query(
    "word_at_time",
    with_(
        B.SEG,
        """wd AS (SELECT doc_id, w[i] AS text, round("start" + (i - 1) * (("end" - "start") / len(w)), 3) AS ws, round("start" + i * (("end" - "start") / len(w)), 3) AS we
          FROM (SELECT doc_id, "start", "end", w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM seg)))""",
    )
    + """SELECT p.doc_id, p.t, arg_min(text, {'s': ws, 'e': we, 't': text}) AS word FROM (SELECT DISTINCT doc_id, "start" + 1.25 AS t FROM seg) p JOIN wd ON wd.doc_id = p.doc_id AND ws <= t AND we >= t GROUP BY p.doc_id, p.t""",
)
def word_at_time(spark, d):
    seg = B.segments(spark, d)
    words = seg.select("doc_id", F.explode(B.words_of(F.col("text"), F.col("start"), F.col("end"))).alias("w")).select("doc_id", "w.start", "w.end", "w.text")
    points = seg.select("doc_id", (F.col("start") + 1.25).alias("t")).distinct()
    return J.word_at_time(points, words).select("doc_id", "t", "word")


ENT = f"""
nk AS (SELECT name_key, arg_min(title, path) AS note_title, min(path) AS note_path FROM (
  SELECT path, title, {S.norm_title('n')} AS name_key FROM (SELECT path, title, unnest(list_concat([title], aliases)) AS n FROM notes)) WHERE name_key <> '' GROUP BY name_key)
"""


@query(
    "resolve_entities",
    with_(B.NOTES, ENT)
    + f"""SELECT note_id, name, coalesce(note_title, name) AS wikilink, note_path FROM (SELECT note_id, upper(coalesce(aliases[1], title)) AS name FROM notes) e LEFT JOIN nk ON nk.name_key = {S.norm_title('name')}""",
)
def resolve_entities(spark, d):
    notes = B.notes(spark, d)
    name = F.upper(F.coalesce(F.try_element_at("aliases", F.lit(1)), "title"))
    ent = notes.select("note_id", name.alias("name"), name.alias("wikilink"))
    return J.resolve_entities(ent, notes).select("note_id", "name", "wikilink", "note_path")


@query("todo_blocks", with_(B.SEG) + "SELECT doc_id, seg_idx FROM seg WHERE seg_idx % 3 <> 0 OR seg_idx % 2 = 0")
def todo_blocks(spark, d):
    seg = B.segments(spark, d).select("doc_id", "seg_idx", F.concat(F.lit("b"), F.col("seg_idx").cast("string")).alias("block_id"), F.col("text").alias("raw"))
    done = seg.filter("seg_idx % 3 = 0").withColumn("raw", F.when(F.col("seg_idx") % 2 == 0, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))
    return J.todo_blocks(seg, done).select("doc_id", "seg_idx")


@query(
    "allowed_links",
    with_(B.SEG, B.NOTES) + """SELECT doc_id, seg_idx, quote FROM (SELECT doc_id, seg_idx, text, regexp_extract(text, '[A-Za-z]{5,}') AS quote, CASE WHEN seg_idx % 2 = 0 THEN (SELECT min(title) FROM notes) ELSE 'zz' END AS title FROM seg)
      WHERE quote <> '' AND title <> 'zz' AND len(string_split(text, quote)) = 2""",
)
def allowed_links(spark, d):
    return _links(spark, d).select("doc_id", "seg_idx", "quote")


def _links(spark, d):
    notes = B.notes(spark, d).select("title")
    first = notes.agg(F.min("title")).scalar()
    p = B.segments(spark, d).select(
        "doc_id", "seg_idx", "text", F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("quote"),
        F.when(F.col("seg_idx") % 2 == 0, first).otherwise("zz").alias("title"),
    )
    return J.allowed_links(p, notes)


@query(
    "insert_wikilinks",
    with_(B.SEG, B.NOTES) + """SELECT doc_id, seg_idx, replace(text, quote, '[[' || title || '|' || quote || ']]') AS text
      FROM (SELECT doc_id, seg_idx, text, regexp_extract(text, '[A-Za-z]{5,}') AS quote, CASE WHEN seg_idx % 2 = 0 THEN (SELECT min(title) FROM notes) ELSE 'zz' END AS title FROM seg)
      WHERE quote <> '' AND title <> 'zz' AND len(string_split(text, quote)) = 2""",
)
def insert_wikilinks(spark, d):
    p = _links(spark, d)
    return p.select("doc_id", "seg_idx", insert_links("text", F.array(F.struct("quote", "title"))).alias("text"))


@query(
    "place_headings",
    with_(B.SEG, para_sql("NULL::VARCHAR"))
    + r"""SELECT doc_id, string_agg(CASE WHEN n > 1 AND length(regexp_replace(left(text, 40), '[^\p{L}\p{N}]', '', 'g')) >= 12 THEN '## Partie ' || first_idx || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY n) AS text
      FROM (SELECT doc_id, first_idx, 'Partie ' || first_idx || ' : ' || text AS text, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) AS n FROM par) GROUP BY doc_id""",
)
def place_headings_query(spark, d):
    paras = Q.paragraphs(B.segments(spark, d, speakers=False))
    # numbered, so that a repeated paragraph has a quote of its own
    numbered = paras.select("doc_id", "first_idx", F.concat(F.lit("Partie "), F.col("first_idx").cast("string"), F.lit(" : "), "text").alias("text"))
    body = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_idx", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    wanted = F.transform("p", lambda x: F.struct(F.concat(F.lit("Partie "), x["first_idx"].cast("string")).alias("heading"), F.left(x["text"], F.lit(40)).alias("quote")))
    return body.select("doc_id", place_headings(text, wanted).alias("text"))
