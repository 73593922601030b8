"""Findings, lexicon matches, proofreading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings as N, lexicon as L, sequence as Q
from ..sources import bindings as B
from . import sqlkit as S
from .registry import query, with_
from .sequence_queries import para_sql
from .text_queries import CORPUS_PACK, DOUB, FILL


def names(spark, d):
    short = F.when(F.size("acronyms") > 0, F.concat(F.lit(" ("), F.array_join("acronyms", "/"), F.lit(")"))).otherwise("")
    return L.lexicon_names(B.lexicon(spark, d).withColumn("short", short))


@query("lexicon_names", with_(B.LEX, B.LEX_NAMES) + f"SELECT term, name, name_pos, {S.norm_key('name')} AS name_key, verified FROM lex_names")
def lexicon_names(spark, d):
    return names(spark, d).select("term", "name", "name_pos", "name_key", "verified")


# overlay: every fifth term again with another category, plus new terms; an earlier entry of each must not count
OVER = """
over AS (SELECT CASE WHEN h % 10 = 0 THEN term || 'x' ELSE term END AS term, 'ajout' AS category, NOT verified AS verified, 'y' || pos AS pos FROM lex WHERE h % 5 = 0)
"""


@query(
    "lexicon_overlay",
    with_(B.LEX, OVER)
    + """SELECT term, category, verified, pos, 0::BIGINT AS tier FROM lex WHERE term NOT IN (SELECT term FROM over)
    UNION ALL SELECT o.term, o.category, o.verified, coalesce(l.pos, o.pos), CASE WHEN l.term IS NULL THEN 1 ELSE 0 END FROM over o LEFT JOIN lex l USING (term)""",
)
def lexicon_overlay(spark, d):
    lex = B.lexicon(spark, d)
    merged = L.load_lexicon(lex, _overlay(lex))
    return merged.select("term", "category", "verified", "pos", F.col("tier").cast("bigint").alias("tier"))


def _overlay(lex):
    own = lambda category, verified, place: F.struct(F.lit(category).alias("category"), verified.alias("verified"), F.concat(F.lit(place), "pos").alias("pos"))
    entries = F.array(own("ajout", ~F.col("verified"), "z"), own("avant", F.col("verified"), "y"))
    return lex.filter("h % 5 = 0").select(
        F.when(F.col("h") % 10 == 0, F.concat("term", F.lit("x"))).otherwise(F.col("term")).alias("term"), F.explode(entries).alias("e"),
        "acronyms", "variants", "wikilink", "definition", "reference",
    ).select("term", "e.*", "acronyms", "variants", "wikilink", "definition", "reference")


@query("overlay_names", with_(B.LEX, OVER) + "SELECT DISTINCT term FROM over")
def overlay_names(spark, d):
    return _overlay(B.lexicon(spark, d)).select("term").distinct()


LOOKUP = """
look AS (
  SELECT citation, term, category FROM (
    SELECT c.citation, n.term, n.category, row_number() OVER (PARTITION BY c.citation ORDER BY length(n.name) DESC, n.pos) AS rn
    FROM (SELECT DISTINCT citation FROM {src}) c JOIN lex_names n ON contains(lower(c.citation), lower(n.name)) {where}) WHERE rn = 1)
"""


@query("lexicon_lookup", with_(B.SEG, B.CLAIM, B.LEX, B.LEX_NAMES, LOOKUP.format(src="claim", where="")) + "SELECT * FROM look")
def lexicon_lookup(spark, d):
    return L.lookup(B.claims(spark, d), names(spark, d), verified_only=False)


RESOLVE = f"""
uniq AS (SELECT {S.norm_key('name')} AS name_key, min(term) AS term FROM lex_names WHERE verified GROUP BY 1 HAVING count(DISTINCT term) = 1),
exact AS (SELECT c.doc_id, c.pos, c.citation, u.term FROM claim c JOIN uniq u ON {S.norm_key('c.citation')} = u.name_key)
"""


@query("resolve_exact", with_(B.SEG, B.CLAIM, B.LEX, B.LEX_NAMES, RESOLVE) + "SELECT * FROM exact")
def resolve_exact(spark, d):
    return L.resolve_exact(B.claims(spark, d).select("doc_id", "pos", "citation"), names(spark, d))


REFS = f"""
refs AS (SELECT term, pos, {S.match_norm('reference')} AS r FROM lex WHERE verified AND length({S.match_norm('reference')}) >= 10)
"""


@query(
    "reference_match",
    with_(B.SEG, B.LEX, REFS)
    + f"""SELECT citation, min(term) AS term FROM (SELECT DISTINCT 'Selon l''article ' || (seg_idx % 50 + 400) || ' du code ' || regexp_extract(text, '[a-z]+') || ', oui' AS citation FROM seg) c
    JOIN refs ON contains({S.match_norm('citation')}, r) GROUP BY citation""",
)
def reference_match(spark, d):
    cite = B.segments(spark, d).select(F.concat(
        F.lit("Selon l'article "), (F.col("seg_idx") % 50 + 400).cast("string"), F.lit(" du code "),
        F.regexp_extract("text", "[a-z]+", 0), F.lit(", oui"),
    ).alias("citation"))
    return L.reference_match(cite, B.lexicon(spark, d))


def near_sql(src: str, text: str, keys: str) -> str:
    return f"""
nw AS (SELECT DISTINCT {keys}, w AS near_word FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM {src}) WHERE length(w) >= 4),
nd AS MATERIALIZED (SELECT DISTINCT lower(near_word) AS word, regexp_replace(lower(near_word), '[^\\x00-\\x7f]', '#', 'g') AS a FROM nw),
np AS MATERIALIZED (SELECT word, min(term) AS term FROM nd JOIN (SELECT term, lower(name) AS n FROM lex_names WHERE length(name) >= 4)
       ON abs(length(a) - length(n)) <= 2 AND a <> n AND levenshtein(a, n) <= 2 GROUP BY word),
near AS (SELECT {keys}, near_word, term FROM nw JOIN np ON lower(near_word) = word)
"""


@query("near_misses", with_(B.LEX, B.LEX_NAMES, near_sql("documents", "text", "doc_id")) + "SELECT * FROM near")
def near_misses(spark, d):
    return L.near_misses(B.documents(spark, d).select("doc_id", "text"), "text", names(spark, d)).drop("pos")


@query(
    "grounding_hints",
    with_(B.LEX, B.LEX_NAMES, near_sql("documents", "text", "doc_id"))
    + """SELECT doc_id, term, near_word, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near_word, term) AS rank FROM (
      SELECT doc_id, lower(near_word) AS l, term, min(near_word) AS near_word FROM near GROUP BY ALL)) WHERE rank <= 8""",
)
def grounding_hints(spark, d):
    return L.grounding_hints(B.documents(spark, d).select("doc_id", "text"), "text", names(spark, d))


@query(
    "hint_text",
    with_(B.LEX, B.LEX_NAMES, near_sql("documents", "text", "doc_id"))
    + """SELECT doc_id, 'Termes proches (à confirmer par l''écoute) :' || chr(10) || string_agg('- « ' || near_word || ' » → « ' || term || ' » ?', chr(10) ORDER BY rank) AS hints
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near_word, term) AS rank FROM (SELECT doc_id, lower(near_word) AS l, term, min(near_word) AS near_word FROM near GROUP BY ALL))
      WHERE rank <= 8 GROUP BY doc_id""",
)
def hint_text(spark, d):
    return L.hint_text(L.grounding_hints(B.documents(spark, d).select("doc_id", "text"), "text", names(spark, d)), ["doc_id"])


PADDED = lambda x: f"' ' || array_to_string({S.compare_words(x)}, ' ') || ' '"


@query(
    "ungrounded_entities",
    with_(
        B.SEG, B.PAIR, B.LEX, B.LEX_NAMES, near_sql("pair", "raw", "doc_id, seg_idx"),
        f"""nn AS (SELECT term, {PADDED('name')} AS n, {S.compare_words('name')}[1] AS w FROM lex_names),
cw AS (SELECT doc_id, seg_idx, {PADDED('clean || chr(32) || cw')} AS p, unnest(list_distinct({S.compare_words('clean || chr(32) || cw')})) AS w FROM (SELECT *, 'thing ' || substring(lower(lang) || 'that', 3) AS cw FROM pair)),
rw AS (SELECT doc_id, seg_idx, {PADDED('raw')} AS p, unnest(list_distinct({S.compare_words('raw')})) AS w FROM pair),
said AS (SELECT DISTINCT doc_id, seg_idx, term FROM cw JOIN nn USING (w) WHERE contains(p, n)),
heard AS (SELECT DISTINCT doc_id, seg_idx, term FROM rw JOIN nn USING (w) WHERE contains(p, n))""",
    )
    + "SELECT * FROM said EXCEPT SELECT * FROM heard EXCEPT SELECT doc_id, seg_idx, term FROM near",
)
def ungrounded_entities(spark, d):
    p = B.pairs(spark, d)
    added = F.concat("clean", F.lit(" thing "), F.substring(F.concat(F.lower("lang"), F.lit("that")), 3, 99))
    return L.ungrounded_entities(p.select("doc_id", "seg_idx", "raw", added.alias("candidate")), names(spark, d))


@query("shield_trusted")
def shield_trusted(spark, d):
    out = L.shield_trusted(B.segments(spark, d).select("doc_id", "seg_idx", "text"), "text", names(spark, d))
    return out.select("doc_id", "seg_idx", "masked", F.size("recognised").cast("bigint").alias("n_recognised"))


@query(
    "budgeted_prefix",
    with_(B.LEX)
    + """SELECT name, used::BIGINT AS used FROM (SELECT name, sum(length(name) + 2) OVER (ORDER BY pos, i) AS used FROM (
      SELECT name, pos, i FROM (SELECT name, pos, i, row_number() OVER (PARTITION BY name ORDER BY pos, i) AS rn FROM (
        SELECT pos, unnest(list_concat([term], acronyms)) AS name, generate_subscripts(list_concat([term], acronyms), 1) AS i FROM lex)) WHERE rn = 1)) WHERE used <= 800""",
)
def budgeted_prefix(spark, d):
    return L.budgeted_prefix(B.lexicon(spark, d))


@query(
    "glossary",
    with_(B.LEX)
    + """SELECT category, term, '### [[' || wikilink || '|' || term || ']]' || CASE WHEN len(acronyms) > 0 THEN ' (' || array_to_string(acronyms, ', ') || ')' ELSE '' END
      || CASE WHEN verified THEN '' ELSE ' · ⚠️ non vérifié' END || chr(10) || chr(10) || definition || CASE WHEN reference <> '' THEN chr(10) || chr(10) || '*' || reference || '*' ELSE '' END AS content FROM lex""",
)
def glossary(spark, d):
    return L.glossary(B.lexicon(spark, d))


@query("glossary_lines", with_(B.LEX) + "SELECT pos, '- ' || term || CASE WHEN len(acronyms) > 0 THEN ' (' || array_to_string(acronyms, ', ') || ')' ELSE '' END AS line FROM lex")
def glossary_lines(spark, d):
    return L.glossary_lines(B.lexicon(spark, d))


# ---- findings --------------------------------------------------------------

LOST = f"""
lost0 AS MATERIALIZED (SELECT *, {S.numbers('raw')} AS rn_, {S.numbers('clean')} AS cn_, {S.acronyms('raw')} AS ra_, {S.acronyms('clean')} AS ca_ FROM pair),
lost AS (
  SELECT doc_id, block_id, raw, clean, "start", 'chiffre' AS kind, token FROM (SELECT *, unnest(list_filter(list_distinct(rn_), lambda x: len(list_filter(rn_, lambda y: y = x)) > len(list_filter(cn_, lambda y: y = x)))) AS token FROM lost0)
  UNION ALL
  SELECT doc_id, block_id, raw, clean, "start", 'terme' AS kind, token FROM (SELECT *, unnest(list_filter(list_distinct(ra_), lambda x: len(list_filter(ra_, lambda y: y = x)) > len(list_filter(ca_, lambda y: y = x)))) AS token FROM lost0))
"""
TOKEN_FINDINGS = f"""
  SELECT doc_id, block_id, kind, {{severity}} AS severity,
         CASE WHEN kind = 'chiffre' THEN 'Dit à l''oral, le nombre « ' ELSE 'Dit à l''oral, le sigle « ' END || token || ' » manque dans la version relue.' AS message, "start",
         {S.excerpt('raw', 'token')} AS raw_excerpt, 'regles' AS source FROM lost {{join}}
  UNION ALL
  SELECT doc_id, block_id, 'coupure', 'haute', 'Version relue plus courte que l''oral de ' || round_even((1 - length(clean)::DOUBLE / length(raw)) * 100, 0)::BIGINT || ' % : passage à vérifier dans le brut.', "start",
         {S.excerpt('raw')}, 'regles' FROM pair WHERE raw <> '' AND length(clean) < length(raw) * 0.62::DOUBLE
"""
PLAIN = LOST + ", find AS (" + TOKEN_FINDINGS.format(severity="CASE WHEN kind = 'chiffre' THEN 'haute' ELSE 'moyenne' END", join="") + ")"
FULL = (
    LOST + ", " + LOOKUP.format(src="(SELECT token AS citation FROM lost WHERE kind = 'terme')", where="") + ", "
    + near_sql("pair", "clean", "doc_id, block_id, \"start\", raw")
    + ", find AS ("
    + TOKEN_FINDINGS.format(severity="CASE WHEN kind = 'chiffre' OR look.term IS NOT NULL THEN 'haute' ELSE 'moyenne' END", join="LEFT JOIN look ON lost.kind = 'terme' AND look.citation = lost.token")
    + f"""UNION ALL SELECT doc_id, block_id, 'lexique', 'basse', '« ' || near_word || ' » est proche de « ' || near.term || ' »' || CASE WHEN len(acronyms) > 0 THEN ' (' || array_to_string(acronyms, '/') || ')' ELSE '' END || ', terme du lexique : vérifier l''écriture.',
      "start", {S.excerpt('raw', 'near_word')}, 'lexique' FROM near JOIN lex USING (term))"""
)


@query("lost_tokens", with_(B.SEG, B.PAIR, LOST) + "SELECT doc_id, block_id, kind, token FROM lost")
def lost_tokens(spark, d):
    return N.lost_tokens(B.pairs(spark, d)).select("doc_id", "block_id", "kind", "token")


@query("rule_findings", with_(B.SEG, B.PAIR, B.LEX, B.LEX_NAMES, FULL) + "SELECT * FROM find")
def rule_findings(spark, d):
    return N.rule_findings(B.pairs(spark, d), names(spark, d))


@query("finding_contexts")
def finding_contexts(spark, d):
    return N.rule_findings(B.pairs(spark, d), context=True)


@query(
    "verify_report",
    with_(B.SEG, B.PAIR, PLAIN)
    + """SELECT doc_id, checked_pairs, skipped_pairs, coalesce(haute, 0) AS haute, coalesce(moyenne, 0) AS moyenne, coalesce(basse, 0) AS basse
    FROM (SELECT doc_id, count(*) AS checked_pairs, count(*) FILTER (trim(raw) = '' OR trim(clean) = '') AS skipped_pairs FROM pair GROUP BY doc_id)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (severity = 'haute') AS haute, count(*) FILTER (severity = 'moyenne') AS moyenne, count(*) FILTER (severity = 'basse') AS basse FROM find GROUP BY doc_id) USING (doc_id)""",
)
def verify_report(spark, d):
    p = B.pairs(spark, d)
    return N.verify_report(p, N.rule_findings(p))


@query("severity_counts", with_(B.SEG, B.PAIR, PLAIN) + "SELECT doc_id, count(*) FILTER (severity = 'haute') AS haute, count(*) FILTER (severity = 'moyenne') AS moyenne, count(*) FILTER (severity = 'basse') AS basse FROM find GROUP BY doc_id")
def severity_counts(spark, d):
    return N.severity_counts(N.rule_findings(B.pairs(spark, d)))


@query("findings_by_severity", with_(B.SEG, B.PAIR, PLAIN) + "SELECT doc_id, block_id, severity, \"start\", message FROM find")
def findings_by_severity(spark, d):
    return N.by_severity(N.rule_findings(B.pairs(spark, d))).select("doc_id", "block_id", "severity", "start", "message")


@query(
    "merge_findings",
    with_(B.SEG, B.PAIR, PLAIN, """fact AS (SELECT doc_id, 'fait' AS kind, CASE WHEN doc_id % 2 = 0 THEN 'haute' ELSE 'basse' END AS severity FROM documents)""")
    + "SELECT doc_id, count(*) FILTER (severity = 'haute') AS haute, count(*) FILTER (severity = 'moyenne') AS moyenne, count(*) FILTER (severity = 'basse') AS basse FROM (SELECT doc_id, severity FROM find UNION ALL SELECT doc_id, severity FROM fact) GROUP BY doc_id",
)
def merge_findings(spark, d):
    facts = B.documents(spark, d).select(
        "doc_id", F.lit("fait").alias("kind"), F.when(F.col("doc_id") % 2 == 0, "haute").otherwise("basse").alias("severity"), F.lit(0.0).alias("start")
    )
    return N.severity_counts(N.merge_findings(N.rule_findings(B.pairs(spark, d)), facts))


RISK = "length(clean) < length(raw) * 0.75::DOUBLE OR block_id IN (SELECT block_id FROM find f WHERE f.doc_id = pair.doc_id)"


@query("pairs_at_risk", with_(B.SEG, B.PAIR, PLAIN) + "SELECT doc_id, seg_idx FROM pair LEFT JOIN (SELECT DISTINCT doc_id, block_id, true AS hit FROM find) f USING (doc_id, block_id) WHERE raw <> '' AND length(clean) < length(raw) * 0.75::DOUBLE OR hit")
def pairs_at_risk(spark, d):
    p = B.pairs(spark, d)
    return N.pairs_at_risk(p, N.rule_findings(p)).select("doc_id", "seg_idx")


@query("pairs_with_findings", with_(B.SEG, B.PAIR, PLAIN) + "SELECT DISTINCT doc_id, seg_idx FROM pair JOIN find USING (doc_id, block_id)")
def pairs_with_findings(spark, d):
    p = B.pairs(spark, d)
    return N.pairs_with_findings(p, N.rule_findings(p)).select("doc_id", "seg_idx")


BASIC = (
    para_sql("NULL::VARCHAR"),
    f"ba AS MATERIALIZED (SELECT doc_id, first_idx, last_idx, \"start\", \"end\", text, {S.strip_fillers('text', FILL)} AS t FROM par)",
    f"bb AS MATERIALIZED (SELECT * REPLACE ({S.collapse_repeats('t', DOUB)} AS t) FROM ba)",
    f"basic AS (SELECT * FROM (SELECT doc_id, 'block-' || first_idx || '-' || last_idx AS block_id, first_idx, last_idx, \"start\", \"end\", text AS raw, {S.fix_typography('t')} AS clean FROM bb) WHERE clean <> '')",
)


@query("basic_proofread", with_(B.SEG, *BASIC) + "SELECT * FROM basic")
def basic_proofread(spark, d):
    return N.basic_proofread(Q.paragraphs(B.segments(spark, d, speakers=False)), CORPUS_PACK)


@query(
    "quality_report",
    with_(
        B.SEG, *BASIC,
        """pair AS (SELECT doc_id, block_id, raw, "start", CASE WHEN first_idx % 5 = 0 THEN substring(clean, 1, (length(clean) // 2)::INT)
           WHEN first_idx % 2 = 0 THEN regexp_replace(clean, '[0-9]+', '', 'g') WHEN first_idx % 7 = 3 THEN regexp_replace(clean, '[A-Z]{2,}', 'x', 'g') ELSE clean END AS clean FROM basic)""",
        PLAIN,
    )
    + "SELECT doc_id, count(*) FILTER (severity = 'haute') AS haute, count(*) FILTER (severity = 'moyenne') AS moyenne, count(*) FILTER (severity = 'basse') AS basse FROM find GROUP BY doc_id",
)
def quality_report(spark, d):
    """Flagship: sentences -> paragraphs -> cleaning -> findings -> counts per document."""
    p = basic_proofread(spark, d)
    i, c = F.col("first_idx"), F.col("clean")
    clean = (
        F.when(i % 5 == 0, F.substring(c, 1, F.floor(F.length(c) / 2).cast("int")))
        .when(i % 2 == 0, F.regexp_replace(c, "[0-9]+", ""))
        .when(i % 7 == 3, F.regexp_replace(c, "[A-Z]{2,}", "x"))
        .otherwise(c)
    )
    return N.severity_counts(N.rule_findings(p.withColumn("clean", clean)))


@query("legal_references", with_(B.SEG) + "SELECT doc_id, seg_idx, (seg_idx % 3 = 0) AS legal, (seg_idx % 4 = 1) AS body FROM seg")
def legal_references(spark, d):
    i, t = F.col("seg_idx"), F.col("text")
    tagged = F.concat(
        t, F.when(i % 3 == 0, F.lit(" selon l'Arrêté du 3 mai")).otherwise(""), F.when(i % 4 == 1, F.lit(" devant la Préfecture !")).otherwise("")
    )
    return B.segments(spark, d).select("doc_id", "seg_idx", T.has_legal_reference(tagged).alias("legal"), T.is_measure_body(tagged).alias("body"))


@query("word_alignment")
def word_alignment(spark, d):
    from ..functions.align import align

    return B.pairs(spark, d).withColumn("a", align("raw", "clean")).select("doc_id", "seg_idx", "a.*")
