"""Mechanical acceptance of proposed revisions and of second recognitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONTRACT, DEFAULT_PACK, Contract, RulePack
from ..functions import fields, text as T
from ..functions.align import similarity
from ..functions.review import reviewed
from ..session import balanced
from .lexicon import ungrounded_entities

WINDOW, SUPPORT_FLOOR, OPENING_FLOOR = DEFAULT_CONTRACT.window, DEFAULT_CONTRACT.support_floor, DEFAULT_CONTRACT.opening_floor


def _signals(pairs: DataFrame, pack: RulePack, windows: tuple[int, ...], aligned: bool) -> DataFrame:
    """``signals``, and in ``_s`` what the pass over the words gave."""
    raw, cand = F.coalesce("raw", F.lit("")), F.coalesce("candidate", F.lit(""))
    p = pairs.withColumns({"raw": raw, "candidate": cand})
    p = p.withColumns({
        "artifacts": T.model_artifacts("candidate", pack), "markers": T.meta_markers("candidate", pack),
        "_s": reviewed("raw", "candidate", pack, windows, aligned),
    })
    shares = ("altered_numbers", "altered_acronyms", "opening_support", *(f"support_{w}" for w in windows))
    plain = ("words_raw", "words_candidate", "loop_introduced", "language_leak")
    return p.withColumns({c: F.col("_s")[c] for c in plain} | {c: F.round(F.col("_s")[c], 4) for c in shares})


def signals(pairs: DataFrame, pack: RulePack = DEFAULT_PACK, windows: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """Everything about (raw, candidate) that needs no alignment.

    Adds word counts, altered shares, loops, markers, window and opening
    support, and language leak; what words tell comes from one pass over each pair.
    """
    return _signals(pairs, pack, windows, False).drop("_s")


def validate(
    pairs: DataFrame, *, keys: list[str], names: DataFrame | None = None,
    contract: Contract = DEFAULT_CONTRACT, pack: RulePack = DEFAULT_PACK, windows: tuple[int, ...] = (WINDOW,),
) -> DataFrame:
    """``pairs`` with reasons, metrics and ``valid``; reasons keep their order."""
    p = _signals(pairs, pack, windows, True)
    if names is not None and contract.check_entities:
        bad = ungrounded_entities(pairs.select(*keys, "raw", "candidate"), names)
        bad = bad.groupBy(*keys).agg(F.array_sort(F.collect_set("term")).alias("introduced_entities"))
        p = p.join(bad, keys, "left")
    else:
        p = p.withColumn("introduced_entities", F.lit(None).cast("array<string>"))
    wr, wc = F.col("words_raw"), F.col("words_candidate")
    added, longest = F.col("_s.added"), F.col("_s.longest_added")
    ratio = F.when(wr > 0, added / wr).otherwise(F.when(wc > 0, 1.0).otherwise(0.0))
    p = p.withColumns({
        "added_words": added, "longest_added_span": longest, "_ratio": ratio,
        "added_word_ratio": F.round(ratio, 4),
    })
    c, r = F.col("candidate"), F.col("raw")
    empty = T.is_blank("candidate")
    too_short = ~empty & ~T.is_blank("raw") & (F.length(c) < F.length(r) * contract.min_length_ratio)
    too_long = (wr > 0) & (wc > F.greatest(wr * contract.max_expansion_ratio, (wr + contract.max_expansion_words).cast("double")))
    long_span = F.col("longest_added_span") > contract.max_added_span
    artifact, markers = F.size("artifacts") > 0, F.size("markers")
    leak = artifact | (
        (markers > 0) & ((markers >= 2) | (F.col("_ratio") > 0.30) | (F.col("longest_added_span") > 15) | too_long)
    )
    structural = leak | too_long | long_span
    tests = [
        (empty, "empty"),
        (too_short, "too_short"),
        (too_long, "too_long"),
        ((wr > 0) & (F.col("_ratio") > contract.max_added_ratio), "added_word_ratio"),
        (long_span, "long_added_span"),
        (F.contains(c, F.lit("�")), "replacement_char"),
        (F.col("loop_introduced"), "repetition_loop"),
        (artifact, "model_artifact"),
        (leak, "reasoning_leak"),
        (F.lit(contract.preserve_numbers) & (F.col("altered_numbers") > 0.5) & structural, "numbers_altered"),
        (F.lit(contract.preserve_acronyms) & (F.col("altered_acronyms") > 0.5) & structural, "acronyms_altered"),
        (F.lit(contract.check_prefix) & misaligned(contract.window, contract.support_floor, contract.opening_floor), "prefix_misaligned"),
        (F.lit(contract.check_language) & F.col("language_leak"), "language_mismatch"),
        (F.col("introduced_entities").isNotNull(), "ungrounded_entity"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for cond, name in tests]))
    return p.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0).drop("_s", "_ratio")


def misaligned(window: int, floor, opening_floor) -> Column:
    """Is the candidate unanchored under these thresholds? (null support: not applicable)"""
    body = F.coalesce(F.col(f"support_{window}") < floor, F.lit(False))
    opening = F.col(f"support_{window}").isNotNull() & F.coalesce(F.col("opening_support") < opening_floor, F.lit(False))
    return body | opening


def accept_or_fallback(validated: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """The candidate where valid, else the raw text cleaned by rule, with the reason."""
    missing = F.col("response_missing") if "response_missing" in validated.columns else F.lit(False)
    ok = F.col("valid") & ~missing
    return validated.withColumns({
        "text": F.when(ok, F.col("candidate")).otherwise(T.clean_line("raw", pack)),
        "validation_status": F.when(ok, "valid").otherwise("invalid"),
        "reject_reason": F.when(missing, "enveloppe_manquante").when(~F.col("valid"), F.array_join("reasons", ",")),
    })


def loose_gate(pairs: DataFrame, pack: RulePack = DEFAULT_PACK, contract: Contract = DEFAULT_CONTRACT) -> DataFrame:
    """The looser gate: lost characters stop the block; loops and short texts fall back."""
    loop = T.repetition_loop("candidate") & ~T.repetition_loop("raw")
    short = F.length("candidate") < F.length("raw") * contract.min_length_ratio
    return pairs.withColumns({
        "refused": F.contains("candidate", F.lit("�")),
        "text": F.when(loop | short, T.clean_line("raw", pack)).otherwise(F.col("candidate")),
    })


def rejection_findings(
    decided: DataFrame, pack: RulePack = DEFAULT_PACK, *, message: str = "Révision refusée ({model}), texte brut nettoyé gardé. Motifs : {reasons}.", source: str = "validator",
) -> DataFrame:
    """A refused candidate becomes a visible finding with readable labels; ``message`` may name {model} and {reasons}."""
    labels = F.create_map(*[F.lit(x) for kv in pack.labels.items() for x in kv])
    reasons = F.filter(F.split(F.coalesce("reject_reason", F.lit("")), ","), lambda x: x != "")
    named = F.transform(reasons, lambda x: F.coalesce(F.try_element_at(labels, x), x))
    words = F.when(F.size(reasons) == 0, F.lit("sans motif connu")).otherwise(F.array_join(named, ", "))
    model = F.coalesce(F.col("model") if "model" in decided.columns else F.lit(None), F.lit("modèle inconnu"))
    said = F.replace(F.replace(F.lit(message), F.lit("{model}"), model), F.lit("{reasons}"), words)
    # a filter would be moved below what it reads, and every rule be tried once for it and once for the message
    refused = F.when(F.col("validation_status") == "invalid", F.array(said))
    return decided.select("doc_id", "block_id", F.explode_outer(refused).alias("message")).filter("message is not null").select(
        "doc_id", "block_id", F.lit("candidat_rejete").alias("kind"), F.lit("moyenne").alias("severity"),
        "message", F.lit(0.0).alias("start"), F.lit(source).alias("source"),
    )


def candidates_from_responses(responses: DataFrame, structured: bool = False) -> DataFrame:
    cand = fields.candidate("response", structured)
    return responses.withColumn("candidate", cand).withColumn("response_missing", F.col("candidate").isNull())


def choose_retry(retries: DataFrame) -> DataFrame:
    """Keep, replace, or review: (original, retry, issue) -> action and reason."""
    o, n = F.coalesce("original", F.lit("")), F.coalesce("retry", F.lit(""))
    r = retries.withColumns({"original": o, "retry": n})
    r = r.withColumns({
        "original_words": T.retry_words("original").cast("bigint"), "retry_words": T.retry_words("retry").cast("bigint"),
        "original_unk": T.unk_ratio("original"), "retry_unk": T.unk_ratio("retry"),
        "original_loop": T.repetition_loop("original"), "retry_loop": T.repetition_loop("retry"),
        "_or": T.sensitive_refs("original"), "_rr": T.sensitive_refs("retry"),
    })
    # few bytes but much work: by their size alone all rows would be compared in one task
    r = balanced(r, "original", "retry").withColumn("similarity", similarity(T.retry_norm("original"), T.retry_norm("retry")))
    pick = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    ow, rw, issue = F.col("original_words"), F.col("retry_words"), F.col("issue")
    unlike = F.col("similarity") < 0.35
    better_unk = (F.col("retry_unk") < F.col("original_unk")) & (rw > 0)
    choice = (
        F.when(T.is_blank("retry"), pick("keep_original", "retry_empty"))
        .when(F.col("retry_loop") & F.col("original_loop"), pick("needs_review", "retry_still_repetitive"))
        .when(F.col("retry_loop"), pick("keep_original", "retry_still_repetitive"))
        .when((ow > 0) & (rw / F.greatest(ow, F.lit(3)) > 4.0), pick("needs_review", "retry_abnormal_expansion"))
        .when(~T.same_set(F.col("_or"), F.col("_rr")), pick("needs_review", "sensitive_reference_divergence"))
        .when(
            issue == "boucle_de_tokens",
            F.when(F.col("original_loop") & (rw > 0), pick("use_retry", "repetition_removed"))
            .otherwise(pick("needs_review", "repetition_not_improved")),
        )
        .when(
            issue == "unk_ratio_eleve",
            F.when(better_unk & unlike, pick("needs_review", "low_similarity"))
            .when(better_unk, pick("use_retry", "unk_ratio_reduced"))
            .otherwise(pick("needs_review", "unk_ratio_not_improved")),
        )
        .when(
            issue == "texte_vide_plage_longue",
            F.when(T.is_blank("original") & (rw > 0), pick("use_retry", "speech_recovered"))
            .otherwise(pick("keep_original", "no_speech_recovered")),
        )
        .when((ow >= 4) & (rw >= 4) & unlike, pick("needs_review", "low_similarity"))
        .otherwise(pick("keep_original", "no_retry_policy"))
    )
    return r.withColumn("_c", choice).withColumns({"action": F.col("_c.action"), "reason": F.col("_c.reason")}).drop("_c", "_or", "_rr")


def effective_segments(segments: DataFrame, retries: DataFrame) -> DataFrame:
    """The overlay view: retry text only where it was chosen; raw rows stay.

    Where ``segments`` has ``words`` and ``retries`` has ``effective_words``, the words of a
    chosen retry that has any take the place of the segment's.
    """
    worded = "words" in segments.columns and "effective_words" in retries.columns
    new = [F.col("retry").alias("_retry"), *([F.col("effective_words").alias("_words")] if worded else [])]
    chosen = retries.filter("action = 'use_retry'").select("doc_id", "seg_idx", *new)
    out = segments.join(chosen, ["doc_id", "seg_idx"], "left")
    taken = F.coalesce("_retry", F.lit("")) != ""
    out = out.withColumn("text", F.when(taken, F.col("_retry")).otherwise(F.col("text")))
    if worded:
        out = out.withColumn("words", F.when(taken, F.coalesce("_words", "words")).otherwise(F.col("words")))
    return out.select(*segments.columns)
