"""Matching against a domain lexicon: exact, contained, fuzzy, and by tokens.

A lexicon row is a term with ``pos`` (its order), names, a category and a
``verified`` flag. No join here compares every text with every name: each has an
equality key that any match must share, and the candidates are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fields, text as T
from ..functions.align import contained, mask_names
from ..functions.review import padded_words, words_beside
from ..session import balanced, checkpointed


def load_lexicon(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay terms replace base terms in place; new ones follow the base.

    Of several overlay entries of a term the last one, by ``pos``, counts; a new term stands
    where its first entry does.
    """
    tidy = lambda df: df.withColumn("term", F.trim("term")).filter(F.col("term") != "")
    base = tidy(base)
    rest = [c for c in overlay.columns if c not in ("term", "pos")]
    last = tidy(overlay).groupBy("term").agg(F.max_by(F.struct(*rest), "pos").alias("_v"), F.min("pos").alias("pos"))
    overlay = last.select("term", *[F.col("_v")[c].alias(c) for c in rest], "pos")
    places = base.select("term", F.col("pos").alias("_bp"))
    over = overlay.join(places, "term", "left").select(
        *[c for c in overlay.columns if c != "pos"],
        F.coalesce("_bp", "pos").alias("pos"), F.col("_bp").isNull().cast("int").alias("tier"),
    )
    kept = base.join(overlay.select("term"), "term", "left_anti").withColumn("tier", F.lit(0))
    merged = kept.unionByName(over, allowMissingColumns=True)
    return merged.withColumns({
        "category": F.coalesce("category", F.lit("autre")),
        "wikilink": F.coalesce("wikilink", "term"),
        "verified": F.coalesce("verified", F.lit(False)),
    })


def lexicon_names(lexicon: DataFrame) -> DataFrame:
    """One row per known name of a term, with its folded key."""
    names = F.concat(F.array("term"), "acronyms", "variants")
    rest = [c for c in lexicon.columns if c not in ("acronyms", "variants")]
    return (
        lexicon.select(*rest, F.posexplode(names).alias("name_pos", "name"))
        .filter(F.col("name") != "")
        .withColumn("name_pos", (F.col("name_pos") + 1).cast("bigint"))
        .withColumn("name_key", T.norm_key("name"))
    )


# ---- containment ---------------------------------------------------------

# Explodes of computed arrays are outer ones, with a null filter or join after: for an
# inner explode the optimizer adds a filter that computes the array a second time.
GRAM = 4


def _first_gram(needle: Column) -> Column:
    return F.left(needle, F.least(F.length(needle), F.lit(GRAM)))


def _grams(text: Column) -> Column:
    """Every piece of 1 to 4 characters, once."""
    sized = lambda k: F.when(
        F.length(text) >= k,
        F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[sized(k) for k in range(1, GRAM + 1)]))


def _gaps(text: Column) -> Column:
    return T.extract_all(text, r"[^\p{L}\p{N}_]+")


def _anchors(needle: Column) -> Column:
    """The runs of a needle by which texts may be met; a text that holds the needle holds each of them.

    Inside a text a needle's inner words stand whole; its first and last words are
    parts of words; a needle without words is part of a gap between words.
    """
    tag = lambda how, runs: F.transform(runs, lambda x: F.struct(F.lit(how).alias("how"), x.alias("run")))

    def of(w):
        ends = F.array_distinct(F.concat(F.slice(w, 1, 1), F.slice(w, -1, 1)))
        inner = F.when(F.size(w) >= 3, F.array_distinct(F.slice(w, 2, F.size(w) - 2))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) == 0, tag("gap", F.array(needle))).otherwise(F.concat(tag("whole", inner), tag("part", ends)))

    return T.let(T.extract_all(needle, T.WORDS), of)


#: Most texts and most needles (about) that meet in one row.
TEXT_BLOCK, NEEDLE_BLOCK = 512, 4096


def _dealt(df: DataFrame, on: list[str], by: list[str], most: int) -> DataFrame:
    """``df`` with ``_blk``: rows of equal ``on`` in blocks of about ``most``, equal ``by`` in one block."""
    sizes = df.groupBy(*on).agg(F.ceil(F.count("*") / most).alias("_of"))
    return df.join(sizes, on).withColumn("_blk", F.pmod(F.xxhash64(*by), "_of")).drop("_of")


def _contains_within(texts: DataFrame, keys: list[str], text: str, needles: DataFrame, needle: str, on: list[str]) -> DataFrame:
    """``contains_join`` inside equal ``on``: blocks of texts meet blocks of needles, all needles in one pass over a text."""
    own, rest = [k for k in keys if k not in on], [c for c in needles.columns if c not in on]
    t = _dealt(texts.select(*keys, F.col(text).alias("_text")).filter("_text <> ''"), on, keys, TEXT_BLOCK)
    t = t.groupBy(*on, "_blk").agg(F.array_sort(F.collect_list(F.struct(F.struct(*own).alias("k"), F.col("_text").alias("t")))).alias("_rows"))
    n = _dealt(needles.filter(F.col(needle) != ""), on, [needle], NEEDLE_BLOCK)
    n = n.groupBy(*on, "_blk").agg(F.collect_list(F.struct(*rest)).alias("_needles"))
    again = F.transform("_rows", lambda r, i: F.coalesce(r["k"].eqNullSafe(F.get(F.col("_rows"), i - 1)["k"]) & (i > 0), F.lit(False)))
    sought = F.transform("_needles", lambda x: x[needle])
    both = t.drop("_blk").join(n.drop("_blk"), on).withColumn("_hits", contained(F.transform("_rows", lambda r: r["t"]), again, sought))
    pair = F.transform("_hits", lambda h: F.struct(
        F.get(F.col("_rows"), F.shiftright(h, 32).cast("int"))["k"].alias("k"), F.get(F.col("_needles"), h.bitwiseAND(0xFFFFFFFF).cast("int")).alias("n")))
    met = both.select(*on, F.explode_outer(pair).alias("_p")).filter("_p is not null")
    return met.select(*on, *[F.col("_p.k")[c].alias(c) for c in own], *[F.col("_p.n")[c].alias(c) for c in rest])


def contains_join(texts: DataFrame, keys: list[str], text: str, needles: DataFrame, needle: str, on: list[str] = []) -> DataFrame:
    """Pairs where the text contains the needle, with equal ``on`` columns (part of ``keys``).

    Texts are met through their distinct words, never copied per word. Which word
    contains which anchor is found once for the whole vocabulary. A needle of one word (or
    of none) is decided by that; for the others the texts come back, for the candidates,
    which its rarest word names: a word of most needles and most texts would pair them all.
    Within ``on`` no vocabulary is needed: see ``_contains_within``.
    """
    if on:
        return _contains_within(texts, keys, text, needles, needle, on)
    offered = needles.select(F.col(needle).alias("_needle")).distinct().select("_needle", F.explode_outer(_anchors(F.col("_needle"))).alias("_a"))
    offered = offered.select("_needle", F.col("_a.how").alias("_how"), F.col("_a.run").alias("_run"))
    anchors = offered.select("_how", "_run").distinct()
    tagged = lambda runs, gap: F.transform(F.array_distinct(runs), lambda x: F.struct(F.lit(gap).alias("gap"), x.alias("w")))
    runs = F.concat(tagged(T.extract_all(F.col(text), T.WORDS), False), tagged(_gaps(F.col(text)), True))
    seen = texts.select(*keys, F.explode_outer(runs).alias("_r")).select(*keys, "_r.gap", "_r.w").filter("w is not null")
    vocabulary = balanced(seen.groupBy("gap", "w").agg(F.count("*").alias("_times")), "w")
    whole = vocabulary.filter("not gap").join(anchors.filter("_how = 'whole'").withColumn("w", F.col("_run")), "w").select("gap", "w", "_how", "_run", "_times")
    parts = vocabulary.select("gap", "w", "_times", F.explode_outer(_grams(F.col("w"))).alias("_g")).join(
        anchors.filter("_how <> 'whole'").withColumn("_g", _first_gram(F.col("_run"))).withColumn("gap", F.col("_how") == "gap"), ["gap", "_g"]
    ).filter(F.contains("w", "_run")).select("gap", "w", "_how", "_run", "_times")
    places = parts.unionByName(whole)
    # each needle goes by the anchor that the fewest texts hold; one with an anchor that none holds is in no text
    often = offered.join(places.groupBy("_how", "_run").agg(F.sum("_times").alias("_times")), ["_how", "_run"], "left")
    rarest = often.groupBy("_needle").agg(F.min_by(F.struct("_how", "_run"), F.struct(F.coalesce("_times", F.lit(0)), "_how", "_run")).alias("_a"))
    n = needles.join(rarest.select(F.col("_needle").alias(needle), "_a.*"), needle).select(*needles.columns, "_how", "_run")
    used = places.join(n.select("_how", "_run").distinct(), ["_how", "_run"], "left_semi")
    met = seen.join(used, ["gap", "w"]).select(*keys, "_how", "_run").distinct()
    decided = F.col("_run") == F.col(needle)
    found = lambda part: met.join(n.filter(part), ["_how", "_run"]).drop("_how", "_run")
    open_ = found(~decided)
    checked = open_.join(texts.select(*keys, F.col(text).alias("_text")), keys).filter(F.contains("_text", needle)).select(*open_.columns)
    return found(decided).unionByName(checked)


def lookup(citations: DataFrame, names: DataFrame, verified_only: bool = True) -> DataFrame:
    """Per distinct citation, the term with the longest name inside it.

    Ties go to the term that comes first in the lexicon.
    """
    if verified_only:
        names = names.filter("verified")
    needles = names.select("term", "pos", "category", F.lower("name").alias("_n"))
    texts = citations.select("citation").distinct().withColumn("_t", F.lower("citation"))
    hits = contains_join(texts, ["citation"], "_t", needles, "_n")
    best = F.min_by(F.struct("term", "category"), F.struct((-F.length("_n")).alias("l"), F.col("pos")))
    return hits.groupBy("citation").agg(best.alias("b")).select("citation", F.col("b.term").alias("term"), F.col("b.category").alias("category"))


def resolve_exact(citations: DataFrame, names: DataFrame) -> DataFrame:
    """Citations equal to a verified name of exactly one term."""
    unique = (
        names.filter("verified").groupBy("name_key")
        .agg(F.min("term").alias("term"), F.max("term").alias("_x")).filter(F.col("term") == F.col("_x"))
        .select("name_key", "term")
    )
    keyed = citations.withColumn("name_key", T.norm_key("citation")).filter(F.col("name_key") != "")
    return keyed.join(unique, "name_key").drop("name_key")


def reference_match(citations: DataFrame, lexicon: DataFrame, min_len: int = 10) -> DataFrame:
    """Citations that contain the whole reference of a verified term."""
    refs = (
        lexicon.filter("verified").select("term", "pos", T.match_norm("reference").alias("_r"))
        .filter(F.length("_r") >= min_len)
    )
    texts = citations.select("citation").distinct().withColumn("_t", T.match_norm("citation"))
    hits = contains_join(texts, ["citation"], "_t", refs, "_r")
    return hits.groupBy("citation").agg(F.min_by("term", "pos").alias("term"))


# ---- fuzzy names ---------------------------------------------------------

SHORT = 18


def _without(w: Column, i: Column) -> Column:
    return F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w)))


def _deletions(w: Column) -> Column:
    """Hashes of the word with up to two letters taken out."""
    n = F.length(w)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: _without(w, i))
    two = F.flatten(F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: T.let(_without(w, i), lambda v: F.transform(F.sequence(i, n - 1), lambda j: _without(v, j))),
    ))
    return F.array_distinct(F.transform(F.concat(F.array(w), one, two), lambda v: F.xxhash64(v)))


def _pieces_of_name(w: Column) -> Column:
    """A long name in three pieces: two edits leave one whole."""
    n = F.length(w)
    def piece(p):
        start, end = F.floor(n * p / 3), F.floor(n * (p + 1) / 3)
        return F.xxhash64(n, F.lit(p), F.substring(w, (start + 1).cast("int"), (end - start).cast("int")))
    return F.array(*[piece(p) for p in range(3)])


def _pieces_of_word(w: Column) -> Column:
    keys = []
    for dn in range(-2, 3):
        n = F.length(w) + dn
        for p in range(3):
            start, end = F.floor(n * p / 3), F.floor(n * (p + 1) / 3)
            for shift in range(-2, 3):
                at = (start + shift + 1).cast("int")
                keys.append(F.when(at >= 1, F.xxhash64(n, F.lit(p), F.substring(w, at, (end - start).cast("int")))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def fuzzy_pairs(words: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct lower-case ``word`` and the first term whose name is 1-2 edits away."""
    names = names.select("term", "pos", F.lower("name").alias("_n")).filter(F.length("_n") >= 4)
    # a name gives at most 172 keys, so a bound on names bounds the broadcast
    short = names.filter(F.length("_n") <= SHORT).select("*", F.explode_outer(_deletions(F.col("_n"))).alias("_k"))
    long = names.filter(F.length("_n") > SHORT).select("*", F.explode_outer(_pieces_of_name(F.col("_n"))).alias("_k"))
    w = F.col("word")
    near = words.filter(F.length(w) <= SHORT + 2).select(w, F.explode_outer(_deletions(w)).alias("_k"))
    far = words.filter(F.length(w) > SHORT - 2).select(w, F.explode_outer(_pieces_of_word(w)).alias("_k"))
    close = (F.levenshtein(w, F.col("_n"), 2) >= 0) & (w != F.col("_n"))
    hits = near.join(short, "_k").filter(close).unionByName(
        far.join(long, "_k").filter(close)
    )
    return hits.groupBy("word").agg(F.min_by(F.struct("term", "pos"), "pos").alias("t")).select("word", "t.term", "t.pos")


def near_misses(texts: DataFrame, text: str, names: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Words of a text close to a name without being it: (keys…, near_word, term).

    Every spelling is compared once for the whole corpus, then joined back; of those whose
    first term is not among the terms ``only``, if given, none is.
    """
    keys = [c for c in texts.columns if c != text]
    found = F.array_distinct(F.filter(
        T.extract_all(F.col(text), "[A-Za-zÀ-ÖØ-öø-ÿ]+"), lambda x: F.length(x) >= 4
    ))
    used = texts.select(*keys, F.explode_outer(found).alias("near_word")).filter("near_word is not null").withColumn("word", F.lower("near_word"))
    # the distinct words are few bytes but much work: keep them on every core
    spellings = balanced(used.select("word").distinct(), "word")
    close = fuzzy_pairs(spellings, names)
    if only is not None:
        close = close.join(only, "term", "left_semi").select("word", "term", "pos")
    return used.join(close, "word").drop("word")


def grounding_hints(texts: DataFrame, text: str, names: DataFrame, limit: int = 8) -> DataFrame:
    """At most eight likely spellings per block, in word order."""
    keys = [c for c in texts.columns if c != text]
    lower = F.lower("near_word")
    miss = near_misses(texts, text, names).groupBy(*keys, lower.alias("_l"), "term").agg(F.min("near_word").alias("near_word"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("near_word", "term"))
    return miss.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= limit).drop("_l")


def hint_text(hints: DataFrame, keys: list[str], head: str = "Termes proches (à confirmer par l'écoute) :\n") -> DataFrame:
    """The hints of a block as one note (at most eight lines)."""
    line = F.concat(F.lit("- « "), "near_word", F.lit(" » → « "), "term", F.lit(" » ?"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
    return hints.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["t"]), "\n")).alias("hints"))


# ---- token sequences -----------------------------------------------------

def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def ungrounded_entities(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Terms named in the candidate that the raw text neither names nor misspells.

    ``pairs`` has key columns plus ``raw`` and ``candidate``.
    """
    keys = [c for c in pairs.columns if c not in ("raw", "candidate")]
    pairs = pairs.fillna("", subset=["raw", "candidate"])
    name_words = T.compare_words("name")
    known = names.select(
        "term", _padded(name_words).alias("_n"), F.try_element_at(name_words, F.lit(1)).alias("_w"), (F.size(name_words) > 1).alias("_long")
    ).filter(F.col("_w").isNotNull()).distinct()

    # an unchanged text introduces nothing; a one-word name only as a new word
    changed = pairs.filter(F.col("raw") != F.col("candidate"))
    own = changed.select(*keys, F.explode_outer(words_beside("raw", "candidate")).alias("_x")).select(*keys, F.col("_x.w").alias("_w"), "_x.new")
    met = own.join(known, "_w").filter("new or _long")
    short = met.filter("not _long").select(*keys, "term")
    long = met.filter("_long").select(*keys, "term", "_n").join(changed.select(*keys, "candidate"), keys)
    long = long.filter(F.contains(padded_words("candidate"), F.col("_n"))).select(*keys, "term")
    said = checkpointed(short.unionByName(long).distinct())  # keys and terms only, read five times

    # only texts that gained a term are asked whether they heard it, under any name
    gained = pairs.join(said.select(*keys).distinct(), keys, "left_semi").select(*keys, "raw")
    heard = said.join(known.select("term", "_n"), "term").join(gained.withColumn("_p", padded_words("raw")), keys)
    heard = heard.filter(F.contains("_p", "_n")).select(*keys, "term")
    close = near_misses(gained, "raw", names, said.select("term").distinct()).select(*keys, "term")
    return said.join(heard.unionByName(close), [*keys, "term"], "left_anti")


# ---- trusted spans -------------------------------------------------------

def shield_trusted(blocks: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """Mask verified, unambiguous names in each block and list them.

    A name is tried only on blocks that hold its first word, or, where it may be written
    with dots or blanks between its letters, the first ones of these.
    """
    keys = [c for c in blocks.columns if c != text]
    trusted = names.filter(F.col("verified") & (F.trim("name") != ""))
    clear = trusted.groupBy("name_key").agg(F.min("term").alias("a"), F.max("term").alias("b")).filter("a = b").select("name_key")
    compact = F.lower(F.replace("name", F.lit("."), F.lit("")))
    heads = F.array_union(
        F.array(F.try_element_at(T.compare_words("name"), F.lit(1))),
        F.when((F.length(compact) <= 8) & fields.dotted(F.col("name")), F.transform(F.sequence(F.lit(1), F.length(compact)), lambda i: F.left(compact, i)))
        .otherwise(F.array().cast("array<string>")),
    )
    tried = trusted.join(clear, "name_key").select(
        "term", F.col("name_key").alias("key"), fields.alias_pattern(F.col("name")).alias("pattern"),
        F.explode(F.array_distinct(F.array_compact(heads))).alias("_w"),
    )
    python_pattern = F.replace(F.replace(F.replace("pattern", F.lit(r"[\p{L}\p{N}_]"), F.lit(r"\w")), F.lit("(?iu)"), F.lit("(?i)")), F.lit(r"\p{L}"), F.lit(r"\w"))
    words = blocks.select(*keys, F.explode_outer(F.array_distinct(T.compare_words(text))).alias("_w"))
    per_block = (
        # sorted by word: were the words broadcast, the few tasks of the names would do all the work
        words.join(tried.withColumn("pattern", python_pattern).hint("merge"), "_w")
        .groupBy(*keys).agg(F.collect_set(F.struct("pattern", "key", "term")).alias("_names"))
    )
    out = blocks.join(per_block, keys, "left").withColumn("_m", mask_names(F.col(text), F.col("_names")))
    return out.select(*keys, text, F.col("_m.masked").alias("masked"), F.col("_m.recognised").alias("recognised"))


# ---- vocabulary texts ----------------------------------------------------

def budgeted_prefix(lexicon: DataFrame, max_chars: int = 800) -> DataFrame:
    """Names in order until the prompt is full.

    A name takes three characters or more, so only the first ``max_chars / 3``
    can matter and the running sum sees no more rows than that.
    """
    names = lexicon.select("pos", F.posexplode(F.concat(F.array("term"), "acronyms")).alias("i", "name")).filter(F.col("name") != "")
    first = names.groupBy("name").agg(F.min(F.struct("pos", "i")).alias("o"))
    head = first.orderBy("o").limit(max_chars // 3 + 1)
    used = F.sum(F.length("name") + 2).over(W.partitionBy(F.lit(0)).orderBy("o"))
    return head.withColumn("used", used.cast("bigint")).filter(F.col("used") <= max_chars).select("name", "used")


def glossary(lexicon: DataFrame) -> DataFrame:
    """Glossary entries; the file lists categories, then terms, in order."""
    mark = F.when(F.col("verified"), "").otherwise(" · ⚠️ non vérifié")
    short = F.when(F.size("acronyms") > 0, F.concat(F.lit(" ("), F.array_join("acronyms", ", "), F.lit(")"))).otherwise("")
    section = lambda c, left, right: F.when(c != "", F.concat(F.lit("\n\n" + left), c, F.lit(right)))
    entry = F.concat(
        F.lit("### [["), "wikilink", F.lit("|"), "term", F.lit("]]"), short, mark,
        F.coalesce(section(F.col("definition"), "", ""), F.lit("")), F.coalesce(section(F.col("reference"), "*", "*"), F.lit("")),
    )
    return lexicon.select("category", "term", entry.alias("content"))


def glossary_lines(lexicon: DataFrame) -> DataFrame:
    """Vocabulary lines for a reviser: ``- term (ACRONYMS)``."""
    short = F.when(F.size("acronyms") > 0, F.concat(F.lit(" ("), F.array_join("acronyms", ", "), F.lit(")"))).otherwise("")
    return lexicon.select("pos", F.concat(F.lit("- "), "term", short).alias("line"))
