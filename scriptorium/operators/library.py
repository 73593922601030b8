"""The library: lists, search, status, guards, and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LIGHT = ("doc_id", "filename", "title", "status", "stage", "created_at", "duration", "note_path", "tags")


def _newest(rows: DataFrame, limit: int | None) -> DataFrame:
    ordered = rows.orderBy(F.desc("created_at"), "doc_id")
    return ordered if limit is None else ordered.limit(limit)


def library_view(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first without the heavy columns: pruned at the scan, with a limit top-n without a full sort."""
    return _newest(jobs.select(*[c for c in LIGHT if c in jobs.columns]), limit)


def library_filter(jobs: DataFrame, as_of: Column, *, status: str | None = None, days: float | None = None, tag: str | None = None) -> DataFrame:
    out = jobs
    if status:
        out = out.filter(F.col("status") == status)
    if days is not None:
        out = out.filter(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("created_at") <= int(days * 86_400_000_000))
    if tag:
        out = out.filter(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.strip().lower()))))
    return out


def _like(query: str) -> str:
    return "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def search_docs(jobs: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Documents with the query in a name or text; wild cards in it are literal."""
    hit = lambda c: F.coalesce(F.col(c).ilike(_like(query)), F.lit(False))
    found = jobs.filter(hit("filename") | hit("title") | hit("raw_text") | hit("clean_text"))
    return library_view(found, limit)


def search_passages(jobs: DataFrame, blocks: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """First matching passage per document with its time, newest documents first.

    Blocks that match are counted and reduced before the shuffle.
    """
    needle = query.strip().lower()
    inside = lambda c: F.contains(F.lower(c), F.lit(needle))
    hits = blocks.filter(inside("text")).groupBy("doc_id").agg(
        F.min_by(F.struct("text", "start", "end"), "pos").alias("b"), F.count("*").alias("n")
    )
    fields = [F.when(inside(c), F.col(c)) for c in ("title", "filename", "clean_text", "raw_text")]
    both = jobs.join(hits, "doc_id", "left").withColumn("_x", F.coalesce("b.text", *fields)).filter(F.col("_x").isNotNull())
    at = F.position(F.lit(needle), F.lower("_x")) - 1
    first = F.greatest(F.lit(0), at - 70)
    excerpt = T.strip(F.substring("_x", first + 1, at + len(query) + 110 - first))
    return _newest(both.select(
        "doc_id", F.coalesce("title", "filename").alias("title"), excerpt.alias("match_text"),
        F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.coalesce("n", F.lit(1)).cast("bigint").alias("match_count"), "created_at",
    ), limit)


def editor_matches(blocks: DataFrame, query: str) -> DataFrame:
    return blocks.filter(F.contains(F.lower("text"), F.lit(query.strip().lower()))).select("doc_id", "block_id")


def publication_status() -> Column:
    return (
        F.when(F.coalesce("note_path", F.lit("")) != "", "publie")
        .when(F.col("status").isin("done", "checked", "published"), "pret")
        .otherwise("non_disponible")
    )


def replacement_char_guard(segments: DataFrame) -> DataFrame:
    """Time of the first segment per document that lost characters, in text or words."""
    lost = F.contains("text", F.lit("�"))
    if "words" in segments.columns:
        lost = lost | F.coalesce(F.exists("words", lambda w: F.contains(w["text"], F.lit("�"))), F.lit(False))
    first = segments.filter(lost).groupBy("doc_id").agg(F.min_by("start", "seg_idx").alias("s"))
    s = F.col("s").cast("bigint")
    return first.select("doc_id", F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")).alias("at_clock"))


def block_warnings() -> Column:
    return F.array_compact(F.array(
        F.when(F.contains("text", F.lit("�")), "lost_characters"), F.when(T.repetition_loop("text"), "repetition_loop")
    ))


def editorial_text(jobs: DataFrame, blocks: DataFrame, segments: DataFrame, *, rows: int = 4096) -> DataFrame:
    """The canonical text: edited blocks where any differ from their segment, else the cleaned text.

    Edited texts come in numbered parts of bounded size; others are part 0.
    """
    from .blocks import ordered_text

    b = blocks.select("doc_id", F.col("pos").alias("seg_idx"), T.strip("text").alias("_b"))
    s = segments.select("doc_id", "seg_idx", T.strip("text").alias("_s"))
    both = b.join(s, ["doc_id", "seg_idx"], "left")
    counts = segments.groupBy("doc_id").agg(F.count("*").alias("_ns"))
    edited = both.groupBy("doc_id").agg(
        F.count("*").alias("_nb"), F.bool_or(F.coalesce(F.col("_b") != F.col("_s"), F.lit(False))).alias("_d")
    ).join(counts, "doc_id", "left").filter((F.col("_nb") != F.coalesce("_ns", F.lit(0))) | F.col("_d")).select("doc_id")
    parts = ordered_text(blocks.join(edited, "doc_id", "left_semi"), ["doc_id"], "pos", T.strip("text"), "\n\n", rows=rows)
    plain = jobs.join(edited, "doc_id", "left_anti").select(
        "doc_id", F.lit(0).cast("bigint").alias("part"),
        T.strip(F.coalesce(F.nullif("clean_text", F.lit("")), "raw_text", F.lit(""))).alias("content"),
    )
    return parts.select("doc_id", "part", "content").unionByName(plain)


def annotation_reasons() -> Column:
    """Why an annotation is refused; empty when it is valid."""
    s, e = F.col("range_start"), F.col("range_end")
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin("note", "highlight", "review"), F.lit(False)), "type"),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin("a_verifier", "valide", "ignore"), "status"),
        F.when(s.isNull() != e.isNull(), "range_half"),
        F.when((s < 0) | (s >= e), "range"),
    ))


def split_annotations(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = annotations.withColumn("reasons", annotation_reasons())
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def resumable_jobs(jobs: DataFrame, first_stage: str = "extraction") -> DataFrame:
    """Unfinished jobs, oldest first; one without a stage starts at ``first_stage``."""
    return jobs.filter(F.col("status").isin("queued", "running")).select(
        "doc_id", F.coalesce(F.nullif("stage", F.lit("")), F.lit(first_stage)).alias("stage"), "created_at"
    ).orderBy("created_at", "doc_id")


def new_docs(incoming: DataFrame, as_of: Column) -> DataFrame:
    """Incoming rows with the defaults of a queued job."""
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in incoming.columns else F.lit(v)
    return incoming.withColumns({
        "status": F.lit("queued"), "stage": F.lit("En attente"), "progress": F.lit(0.0), "review_version": F.lit(0).cast("bigint"),
        "language": default("language", "auto"), "created_at": F.date_trunc("second", as_of.cast("timestamp")),
    })


def pending_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.filter("status = 'a_verifier'").groupBy("doc_id").agg(F.count("*").alias("pending"))


def uncertain_points(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("kind").isin("fait", "source")).groupBy("doc_id").agg(F.count("*").alias("uncertain"))


def models_used(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.coalesce("model", F.lit("")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_set("model")).alias("models"))


def entities_by_field(entities: DataFrame) -> DataFrame:
    """People, organisations and references per document, in order, each once."""
    from ..config import CATEGORY_FIELDS

    fields = F.create_map(*[F.lit(x) for kv in CATEGORY_FIELDS.items() for x in kv])
    link = F.coalesce(F.nullif("wikilink", F.lit("")), "name")
    e = entities.withColumns({"field": F.try_element_at(fields, F.col("category")), "link": link}).filter("field is not null and link <> ''")
    once = e.groupBy("doc_id", "field", "link").agg(F.min("pos").alias("pos"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "link")))
    return once.groupBy("doc_id", "field").agg(F.transform(rows, lambda r: r["link"]).alias("links"))


def entity_aliases(entities: DataFrame) -> DataFrame:
    """Names that stand for another note's name, as ``name → link``, in order, each once."""
    link, name = F.coalesce(F.nullif("wikilink", F.lit("")), "name"), T.strip("name")
    e = entities.withColumn("alias", F.concat(name, F.lit(" → "), link)).filter((name != "") & (name != link))
    once = e.groupBy("doc_id", "alias").agg(F.min("pos").alias("pos"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "alias")))
    return once.groupBy("doc_id").agg(F.transform(rows, lambda r: r["alias"]).alias("aliases"))


def search_notes(notes: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    key = T.norm_title(F.lit(query))
    text = T.norm_title(F.concat_ws(" ", "title", "aliases"))
    found = notes.filter(F.contains(text, key)).orderBy("path")
    return found if limit is None else found.limit(limit)
