"""Writes that can be run again: files, courses, entity stubs, publication by manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fields, text as T
from ..operators.claims import latest
from ..session import checkpointed
from . import render as R


def write_pieces(pieces: DataFrame, root: str, name: str = "doc_id") -> None:
    """One folder per file; its part files in name order are the file.

    Rows are ranged by (file, seq), so a long file is spread over many tasks.
    """
    ordered = pieces.repartitionByRange(F.col(name), F.col("seq"), F.col("content")).sortWithinPartitions(name, "seq", "content")
    ordered.select(name, F.col("content").alias("value")).write.mode("overwrite").partitionBy(name).text(root)


def write_dynamic(rows: DataFrame, root: str, by: str) -> None:
    """Replace only the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(root)


def course_path(jobs: DataFrame) -> Column:
    date = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("0000-00-00"))
    stem = F.regexp_replace(fields.safe_filename(R.title_of(), "md"), r"\.md$", "")
    return F.concat_ws("-", date, stem, F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def export_courses(jobs: DataFrame, editorial: DataFrame, root: str | None = None, buckets: int = 64) -> DataFrame:
    """Course files of finished documents: doc_id, seq, content, path, bucket.

    With ``root``, the documents of ``jobs`` are merged into the files there: their old rows
    go, whatever their title was, those of other documents in the same buckets stay. A
    document that is no longer finished leaves one row without content, so that its bucket
    is written again; ``read_courses`` leaves such rows out. The rows to keep are
    checkpointed before their buckets are replaced.
    """
    done = jobs.filter(F.col("status").isin("done", "checked", "published"))
    pieces = R.render_course(done, editorial.join(done.select("doc_id"), "doc_id", "left_semi"))
    out = pieces.join(done.select("doc_id", course_path(done).alias("path")), "doc_id")
    bucket = F.pmod("doc_id", F.lit(buckets)).cast("bigint")
    out = out.withColumn("bucket", bucket)
    if root:
        gone = jobs.join(done.select("doc_id"), "doc_id", "left_anti").select(
            "doc_id", F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("path"), bucket.alias("bucket")
        )
        rows = out.unionByName(gone)
        old = _stored(jobs.sparkSession, root, out.schema)
        if old is not None:
            touched = rows.select("bucket").distinct()
            kept = old.join(touched, "bucket", "left_semi").join(jobs.select("doc_id"), "doc_id", "left_anti")
            rows = rows.unionByName(checkpointed(kept.select(*rows.columns)))
        write_dynamic(rows, root, "bucket")
    return out


def _stored(spark: SparkSession, root: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_courses(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("content").isNotNull())


def missing_entities(entities: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """Stubs for entities without a note; an existing note is never touched."""
    link = T.strip(F.coalesce(F.nullif("wikilink", F.lit("")), "name"))
    path = F.concat(F.lit(folder + "/"), fields.safe_name(link), F.lit(".md"))
    e = entities.filter(F.col("note_path").isNull()).withColumn("path", path).filter(link != "")
    content = F.concat(
        F.lit("---\ntype: entite\ncategorie: "), F.coalesce("category", F.lit("autre")), F.lit("\n---\n\n# "),
        F.coalesce(F.nullif("name", F.lit("")), "wikilink"),
        F.when(F.coalesce("definition", F.lit("")) != "", F.concat(F.lit("\n\n"), F.trim("definition"))).otherwise(""), F.lit("\n"),
    )
    stubs = e.withColumn("content", content).groupBy("path").agg(F.min_by("content", F.struct("doc_id", "pos")).alias("content"))
    return stubs.join(existing.select("path"), "path", "left_anti")


def upsert_lines(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Lines of an index: a changed key keeps one line, the new one, at the end."""
    old = current.withColumn("_seq", F.lit(0))
    return latest(old.unionByName(changes.withColumn("_seq", F.lit(1))), [key], "_seq").drop("_seq")


def add_themes(current: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes not yet in the index, as lines to append."""
    line = F.concat(F.lit("- [["), "theme", F.lit("]]"))
    return themes.select(line.alias("line")).distinct().join(current.select("line"), "line", "left_anti")


def replace_syntheses(current: DataFrame, new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New syntheses by name, and the replaced ones with their date for the archive."""
    old = current.join(new.select("name"), "name", "left_semi").filter(T.strip("content") != "").withColumn("archived_on", as_of.cast("date"))
    kept = current.join(new.select("name"), "name", "left_anti")
    return kept.unionByName(new.select(*current.columns)), old


def publish(
    jobs: DataFrame, segments: DataFrame, editorial: DataFrame, findings: DataFrame, entities: DataFrame, notes: DataFrame, lexicon: DataFrame,
    cards: DataFrame | None = None, *, folder: str = "Notes", tags: tuple[str, ...] = (), domain: str = "",
) -> dict[str, DataFrame]:
    """Everything one publication writes, by part.

    A document published before keeps its path. Note, raw turns and flashcards (``cards``:
    doc_id, pos, recto, verso) name each other. What several parts need is written once and
    read from there.
    """
    from ..operators.joins import resolve_entities
    from ..operators.lexicon import glossary
    from ..operators.library import entities_by_field, entity_aliases, uncertain_points

    ready = jobs.filter(F.col("status").isin("done", "checked", "published"))
    name = fields.filename_for(F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit(" — "), R.title_of()))
    path = F.coalesce("note_path", F.concat(F.lit(folder + "/"), name, F.lit(".md")))
    ready = checkpointed(ready.withColumn("note_link", fields.note_name(path)).withColumn("raw_link", F.concat("note_link", F.lit(" (brut)"))))
    linked = checkpointed(resolve_entities(entities.join(ready.select("doc_id"), "doc_id", "left_semi"), notes))
    points = checkpointed(uncertain_points(findings))
    text = checkpointed(editorial.join(ready.select("doc_id"), "doc_id", "left_semi"))
    beside = lambda mark: F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit(f" ({mark}).md"))
    paths = ready.select("doc_id", path.alias("path"), beside("brut").alias("raw_path"), beside("cartes").alias("cards_path"), F.col("note_link").alias("link"), (F.col("duration") / 60).alias("minutes"))
    lines = paths.join(points, "doc_id", "left").select("doc_id", "link", R.index_line(F.col("link"), F.col("minutes"), F.coalesce("uncertain", F.lit(0))).alias("line"))
    parts = {
        "notes": R.render_note(ready, text, points, entities_by_field(linked), entity_aliases(linked), tags=tags, domain=domain),
        "raw_turns": R.render_raw_turns(ready, segments.join(ready.select("doc_id"), "doc_id", "left_semi")),
        "paths": paths,
        "entities": missing_entities(linked, notes, "Entites"),
        "index": lines,
        "glossary": glossary(lexicon).select("term", "category", "content"),
        "courses": export_courses(ready, text),
        "jobs": ready.select("doc_id", F.lit("published").alias("status")).join(paths.select("doc_id", "path"), "doc_id"),
    }
    if cards is not None:
        parts["flashcards"] = R.render_flashcards(ready, cards.join(ready.select("doc_id"), "doc_id", "left_semi"))
    return parts


#: Parts that a run writes as a whole, and parts of which the first row under a key stays for good.
WHOLE_PARTS = ("glossary",)
FIRST_PARTS = ("entities",)
MANIFEST = "run string, seq bigint, base boolean, parts array<struct<name:string,rows:bigint,fields:string>>"


def write_publication(parts: dict[str, DataFrame], root: str, *, run: str | None = None, base: bool = False) -> str:
    """Publish ``parts`` as one run and return its name.

    Each part goes to files of its own below the run; nothing that an earlier run wrote is
    touched. The manifest row, one small file, comes last and makes the run visible, whole
    or not at all: what a failed run has written stays unread, and it is simply run again.
    ``jobs`` (doc_id and status) names the documents that the run publishes; one of them
    without rows in a part has none there any more. ``base``: this run replaces all earlier
    ones. Runs are numbered one after the other, so one publisher works at a time.
    """
    spark = parts["jobs"].sparkSession
    run = run or uuid.uuid4().hex
    written = []
    for name, part in parts.items():
        part, path = part.drop("bucket"), f"{root}/parts/{name}/run={run}"
        part.write.mode("overwrite").parquet(path)
        written.append((name, spark.read.schema(part.schema).parquet(path).count(), part.schema.json()))
    known = _stored(spark, f"{root}/manifest", MANIFEST)
    last = known.agg(F.max("seq")).first()[0] if known is not None else None
    row = spark.createDataFrame([(run, (last or 0) + 1, base, written)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return run


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The runs that count: all since the last base, itself included; none before the first publication."""
    known = _stored(spark, f"{root}/manifest", MANIFEST)
    if known is None:
        return None
    bases = known.filter("base").agg(F.coalesce(F.max("seq"), F.lit(0).cast("bigint")).alias("least"))
    return known.crossJoin(F.broadcast(bases)).filter("seq >= least").drop("least")  # one row


def read_publication(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """What is published now of one part; None before a run has written it.

    Of a part with ``doc_id`` each document's rows come from the last run that published the
    document. Others go by their first column: the last run's rows, or for
    ``FIRST_PARTS`` the first run's; ``WHOLE_PARTS`` are the last run's part. A part that the
    manifest counts rows of and whose files are gone is an error.
    """
    runs = read_manifest(spark, root)
    held = runs.select("run", "seq", F.explode("parts").alias("p")).filter(F.col("p.name") == name).select("run", "seq", "p.rows", "p.fields") if runs is not None else None
    last = held.orderBy(F.desc("seq"), F.desc("run")).first() if held is not None else None
    if last is None:
        return None
    schema = StructType.fromJson(json.loads(last["fields"]))
    stored = _stored(spark, f"{root}/parts/{name}", StructType([*schema.fields, StructField("run", StringType())]))
    if stored is None:
        raise FileNotFoundError(f"the files of part {name} are gone")
    rows = stored.join(held.select("run", F.col("seq").alias("_turn")), "run")
    turn = F.struct("_turn", "run")
    if name in WHOLE_PARTS:
        return rows.filter(F.col("run") == last["run"]).select(*schema.names)
    if "doc_id" not in schema.names:
        key, pick = schema.names[0], F.min if name in FIRST_PARTS else F.max
        chosen = rows.groupBy(key).agg(pick(turn).alias("_last")).select(key, "_last.run")
        return rows.join(chosen, [key, "run"], "left_semi").select(*schema.names)
    jobs = _stored(spark, f"{root}/parts/jobs", "doc_id bigint, run string").join(runs.select("run", F.col("seq").alias("_turn")), "run")
    current = jobs.groupBy("doc_id").agg(F.max(turn).alias("_last")).select("doc_id", "_last.run")
    return rows.join(current, ["doc_id", "run"], "left_semi").select(*schema.names)


def lost_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """run, name, rows, found: parts of visible runs that hold fewer rows than the manifest says."""
    runs = read_manifest(spark, root)
    if runs is None:
        return None
    said = runs.select("run", F.explode("parts").alias("p")).select("run", "p.name", "p.rows")
    names = [r["name"] for r in said.select("name").distinct().collect()]  # a handful of parts
    counted = None
    for name in names:
        stored = _stored(spark, f"{root}/parts/{name}", "run string")
        if stored is not None:
            own = stored.groupBy("run").agg(F.count(F.lit(1)).alias("found")).withColumn("name", F.lit(name))
            counted = own if counted is None else counted.unionByName(own)
    found = said.join(counted, ["run", "name"], "left") if counted is not None else said.withColumn("found", F.lit(0).cast("bigint"))
    return found.withColumn("found", F.coalesce("found", F.lit(0).cast("bigint"))).filter("found < rows")


def compact_publication(spark: SparkSession, root: str) -> str:
    """Write what is published now as one base run, so that readers look at no earlier one."""
    names = [r["name"] for r in read_manifest(spark, root).select(F.explode("parts.name").alias("name")).distinct().collect()]  # a handful of parts
    return write_publication({n: read_publication(spark, root, n) for n in names}, root, base=True)
