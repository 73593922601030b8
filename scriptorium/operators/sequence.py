"""Operators along the order of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RETRY_ISSUES
from ..functions import text as T
from ..functions.timing import clip_bounds
from .blocks import block_of, joined_text, lagged, running, ordered_text
from .folds import BLOCK_ROWS, Rule, grouped_rows


def _known(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def speaker_turns(segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive segments of one named speaker become one block.

    A segment without speaker never merges. Where segments have ``words``, turns have them
    too, one after the other (null if no segment of the turn has any), and the
    ``source_segment_ids`` they come from.
    """
    worded = "words" in segments.columns
    blk = block_of("seg_idx", rows)
    # words are many times their text: they stay where they are unless a document has several blocks
    seg = lagged(segments, ["doc_id"], ["seg_idx"], {"_prev": _known("speaker")}, block=blk, ahead=worded)
    opens = F.when(F.coalesce(_known("speaker") == F.col("_prev"), F.lit(False)), 0).otherwise(1)
    seg = running(seg, ["doc_id"], ["seg_idx"], {"turn": (opens, "sum")}, block=blk, ahead=worded)
    part = seg.groupBy("doc_id", "turn", blk.alias("part")).agg(
        F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"),
        F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"),
        F.min("confidence").alias("confidence"),
        F.min_by(F.struct("speaker", "role"), "seg_idx").alias("who"),
        joined_text(F.when(T.strip("text") != "", T.strip("text")), "seg_idx").alias("text"),
        F.count("*").alias("n_segments"), *([_in_order("words", "seg_idx"), _in_order(F.array("seg_idx"), "seg_idx", "ids")] if worded else []),
    )
    turns = part.groupBy("doc_id", "turn").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min_by("start", "part").alias("start"), F.max_by("end", "part").alias("end"),
        F.min("confidence").alias("confidence"), F.min_by("who", "part").alias("who"),
        joined_text(F.when(F.col("text") != "", F.col("text")), "part").alias("text"),
        F.sum("n_segments").alias("n_segments"), *([_in_order("words", "part"), _in_order("ids", "part")] if worded else []),
    )
    named = [F.transform("ids", lambda i: F.concat(F.lit("segment-"), i.cast("string"))).alias("source_segment_ids"), "words"] if worded else []
    ident = F.when(
        F.col("first") == F.col("last"), F.concat(F.lit("segment-"), F.col("first").cast("string"))
    ).otherwise(F.concat_ws("-", F.lit("block"), F.col("first").cast("string"), F.col("last").cast("string")))
    return turns.select(
        "doc_id", F.col("turn").alias("pos"), ident.alias("block_id"), "first", "last", "start", "end", "text",
        F.col("text").alias("raw_text"), "confidence", F.col("who.speaker").alias("speaker"), F.col("who.role").alias("role"),
        "n_segments", *named,
    )


def _in_order(lists: Column | str, order: str, name: str | None = None) -> Column:
    """Aggregate: lists one behind the other; null if all are."""
    of = F.col(lists) if isinstance(lists, str) else lists
    rows = F.array_sort(F.collect_list(F.when(of.isNotNull(), F.struct(F.col(order).alias("o"), of.alias("x")))))
    return F.when(F.count(of) > 0, F.flatten(F.transform(rows, lambda r: r["x"]))).alias(name or lists)


def source_segment_ids(first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda i: F.concat(F.lit("segment-"), i.cast("string")))


def paragraphs(
    segments: DataFrame, *, pause: float = 1.2, min_chars: int = 260, max_chars: int = 1100, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Greedy paragraphs: speaker change, a pause after enough text, or a full paragraph."""
    text = T.strip("text")
    seg = segments.select(
        "doc_id", "seg_idx", "start", "end", _known("speaker").alias("speaker"), text.alias("text")
    ).filter(F.col("text") != "")
    rule = Rule(pause=pause, soft_before=min_chars, cap_before=max(1, max_chars))
    grouped = grouped_rows(
        seg, ["doc_id"], "seg_idx", rule, add=F.length("text") + 1, tag=F.col("speaker"),
        start=F.col("start"), end=F.col("end"), rows=rows,
    )
    return grouped.groupBy("doc_id", F.col("group_start").alias("first_idx")).agg(
        F.max("seg_idx").alias("last_idx"),
        F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"),
        joined_text(F.col("text"), "seg_idx").alias("text"),
    )


def chunks(segments: DataFrame, max_chars: int = 6000, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of about ``max_chars``, closed at a sentence end from 70 %."""
    top = max(500, int(max_chars))
    seg = segments.select("doc_id", "seg_idx", "start", "end", T.strip("text").alias("text")).filter(F.col("text") != "")
    rule = Rule(soft_after=int(top * 0.7), cap_after=top)
    grouped = grouped_rows(
        seg, ["doc_id"], "seg_idx", rule, add=F.length("text") + 1,
        close=F.col("text").rlike(T.SENTENCE_END), rows=rows,
    )
    out = grouped.groupBy("doc_id", F.col("group_start").alias("first_idx")).agg(
        F.round(F.min_by("start", "seg_idx"), 3).alias("start"), F.round(F.max_by("end", "seg_idx"), 3).alias("end"),
        joined_text(F.col("text"), "seg_idx").alias("text"),
    )
    numbered = running(out, ["doc_id"], ["first_idx"], {"n": (F.lit(1), "sum")}, block=block_of("first_idx", rows))
    return numbered.withColumn("chunk_idx", F.col("n") - 1).drop("n")


def paragraph_blocks(docs: DataFrame, max_chars: int = 6000, rows: int = BLOCK_ROWS) -> DataFrame:
    """Whole paragraphs packed into blocks, with their offset in the text."""
    top = max(500, int(max_chars))
    parts = F.split("text", "\n\n")
    para = docs.select("doc_id", F.size(parts).alias("n"), F.posexplode(parts).alias("p", "para"))
    para = para.select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("p"), "para",
        (F.length("para") + F.when(F.col("p") < F.col("n") - 1, 2).otherwise(0)).cast("bigint").alias("size"),
    )
    para = running(para, ["doc_id"], ["p"], {"upto": (F.col("size"), "sum")}, block=block_of("p", rows))
    para = para.filter(~T.is_blank("para"))
    grouped = grouped_rows(
        para, ["doc_id"], "p", Rule(cap_after=top), add=F.col("size"), rows=rows
    )
    return grouped.groupBy("doc_id", F.col("group_start").alias("first_par")).agg(
        F.min(F.col("upto") - F.col("size")).alias("offset"), joined_text(F.col("para"), "p", "\n\n").alias("text")
    )


def running_gap(segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Silence before a segment: its start less the latest end so far."""
    seg = running(
        segments, ["doc_id"], ["seg_idx"], {"_end": (F.col("end"), "max")}, block=block_of("seg_idx", rows), inclusive=False
    )
    before = F.greatest(F.coalesce("_end", F.lit(0.0)), F.lit(0.0))
    return seg.withColumn("gap", F.greatest(F.lit(0.0), F.col("start") - before)).drop("_end")


def asr_issues(segments: DataFrame, *, empty_s: float = 8.0, long_s: float = 45.0, unk: float = 0.2) -> DataFrame:
    """Suspect segments, one row per issue."""
    seg = running_gap(segments).withColumn("_t", T.strip("text"))
    seg = seg.withColumn("_u", T.unk_ratio("_t")).withColumn("_d", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))
    whole = lambda x: F.rint(x).cast("bigint").cast("string")
    issue = lambda cond, code, detail: F.when(cond, F.struct(F.lit(code).alias("issue"), detail.alias("detail")))
    found = F.array_compact(F.array(
        issue(F.col("_u") > unk, "unk_ratio_eleve", F.concat(whole(F.col("_u") * 100), F.lit("% de tokens <unk> sur ce segment."))),
        issue(T.repetition_loop("_t"), "boucle_de_tokens", F.lit("Répétition massive du même mot ou groupe de mots.")),
        issue(
            (F.col("_t") == "") & ((F.col("_d") >= empty_s) | (F.col("gap") >= empty_s)),
            "texte_vide_plage_longue", F.lit("Aucun texte reconnu sur une plage audio longue."),
        ),
        issue(
            F.col("_d") >= long_s, "segment_anormalement_long",
            F.concat(F.lit("Segment de "), whole(F.col("_d")), F.lit(" s, largement au-dessus du typique.")),
        ),
    ))
    return seg.select("doc_id", "seg_idx", "start", "end", F.explode_outer(found).alias("f")).filter("f is not null").select(
        "doc_id", "seg_idx", "start", "end", "f.issue", "f.detail"
    )


def retry_groups(issues: DataFrame) -> DataFrame:
    """Retryable issues per segment, most pressing first."""
    rank = F.when(F.col("issue") == RETRY_ISSUES[0], 0).when(F.col("issue") == RETRY_ISSUES[1], 1).otherwise(2)
    return (
        issues.filter(F.col("issue").isin(*RETRY_ISSUES))
        .groupBy("doc_id", "seg_idx", "start", "end")
        .agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "issue"))).alias("i"))
        .withColumn("issues", F.transform("i", lambda x: x["issue"])).drop("i")
    )


def retry_plan(issues: DataFrame, docs: DataFrame, limit: int = 10) -> DataFrame:
    """Clips to recognise again: the first ``limit`` per document, the rest to review.

    The rank is limited before the shuffle, so a document full of issues is no
    single-task sort.
    """
    groups = retry_groups(issues)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("seg_idx"))
    chosen = groups.select("doc_id", "seg_idx").withColumn("rn", rank).filter(F.col("rn") <= limit)
    planned = groups.join(chosen, ["doc_id", "seg_idx"], "left").join(docs.select("doc_id", "duration"), "doc_id")
    clip = clip_bounds(F.col("start"), F.col("end"), F.col("duration"))
    attempted = F.col("rn").isNotNull()
    return planned.select(
        "doc_id", "seg_idx", "issues", attempted.alias("attempted"),
        F.when(attempted, clip["clip_start"]).alias("clip_start"), F.when(attempted, clip["clip_end"]).alias("clip_end"),
        F.when(~attempted, "retry_limit_reached").alias("reason"),
    )


def previous_tail(paras: DataFrame, max_chars: int = 400, rows: int = BLOCK_ROWS) -> DataFrame:
    """The end of the paragraph before, as context."""
    return lagged(
        paras, ["doc_id"], ["first_idx"], {"context": T.tail("text", max_chars)}, block=block_of("first_idx", rows)
    )


def neighbour_bounds(blocks: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Are new bounds legal between the blocks before and after?

    Input columns: doc_id, pos, start, end, new_start, new_end.
    """
    b = lagged(blocks, ["doc_id"], ["pos"], {"_pe": F.col("end")}, block=block_of("pos", rows))
    b = lagged(b, ["doc_id"], ["pos"], {"_ns": F.col("start")}, block=block_of("pos", rows), lead=True)
    s, e = F.col("new_start"), F.col("new_end")
    finite = ~(F.isnan(s) | F.isnan(e) | s.isin(float("inf"), float("-inf")) | e.isin(float("inf"), float("-inf")))
    reason = (
        F.when(~finite | (s < 0) | (e <= s), "bounds")
        .when(s < F.col("_pe"), "overlaps_previous")
        .when(e > F.col("_ns"), "overlaps_next")
    )
    return b.withColumn("reason", reason).drop("_pe", "_ns")


def first_occurrence(claims: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first claim of each key; combined map-side, so a hot key is cheap."""
    rest = [c for c in claims.columns if c not in keys]
    ties = [c for c in (order, "doc_id", "citation") if c in rest]
    first = claims.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("v"))
    return first.select(*keys, *[F.col("v")[c].alias(c) for c in rest])


def nearest_occurrence(text: Column, piece: Column, target: Column) -> Column:
    """0-based place of the occurrence of ``piece`` closest to ``target``, or -1; ties go to the first."""
    def closer(best, _):
        at = F.position(piece, text, best["from"])
        nearer = best["at"].isNull() | (F.abs(at - 1 - target) < F.abs(best["at"] - target))
        return F.struct((at + F.length(piece)).alias("from"), F.when(nearer, at - 1).otherwise(best["at"]).alias("at"))

    def search(n):
        start = F.struct(F.lit(1).alias("from"), F.lit(None).cast("int").alias("at"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, closer, lambda best: best["at"])).otherwise(F.lit(-1))

    return T.let(F.coalesce(T.count_of(text, piece), F.lit(0)), search)


def subtitle_text(text: Column, speaker: Column, width: int = 42) -> Column:
    """Greedy line wrap with the speaker in front."""
    named = F.when(F.coalesce(T.strip(speaker), F.lit("")) != "", F.concat(T.strip(speaker), F.lit(": "), T.strip(text))).otherwise(T.strip(text))
    words = T.extract_all(F.coalesce(named, F.lit("")), r"(?U)\S+")
    return F.aggregate(
        words,
        F.struct(F.lit("").alias("done"), F.lit("").alias("line")),
        lambda a, w: F.when(a["line"] == "", F.struct(a["done"].alias("done"), w.alias("line")))
        .when(
            F.length(a["line"]) + 1 + F.length(w) > width,
            F.struct(F.concat(a["done"], a["line"], F.lit("\n")).alias("done"), w.alias("line")),
        )
        .otherwise(F.struct(a["done"].alias("done"), F.concat_ws(" ", a["line"], w).alias("line"))),
        lambda a: F.concat(a["done"], a["line"]),
    )


def segments_to_text(segments: DataFrame) -> DataFrame:
    text = F.when(~T.is_blank("text"), T.strip("text"))
    return ordered_text(segments, ["doc_id"], "seg_idx", text)
