"""Text rules as Column expressions; all but the search for loops stay inside the JVM and codegen."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import groupby
from operator import eq

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..config import DEFAULT_PACK, RulePack

WORD = r"[\p{L}\p{N}_]"
RUN = r"[\p{L}\p{N}_-]"
WORDS = r"[\p{L}\p{N}_]+"
THOUSANDS = "[   ]"
NUMBER = rf"\p{{Nd}}+(?:{THOUSANDS}\p{{Nd}}{{3}})*(?:[.,]\p{{Nd}}+)?"
ACRONYM = rf"(?<!{RUN})[A-ZÀ-ÖØ-Þ]{{2,}}(?!{RUN})"
LOOP_WORD = r"[^\s .,;:!?…«»\"()\[\]{}]+"
SENTENCE_END = r"[.!?…][\"»')\]]?\s*$"
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and name it inside ``body``.

    Lambdas re-evaluate outer expressions per element; a lambda variable does not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Inner white space to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(_col(c).rlike(r"(?U)\S"), F.lit(False))


def one_of(words) -> str:
    return "|".join(words)


# ---- mechanical cleaning -------------------------------------------------

def strip_fillers(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    return F.regexp_replace(
        _col(c), rf"(?iu)(?<!{RUN})(?:{one_of(pack.fillers)})(?!{RUN})[\s\u00a0\u202f]*,?[\s\u00a0\u202f]*", ""
    )


def collapse_repeats(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    """``je je pense`` to ``je pense``; doubles that are right are kept."""
    keep = rf"(?!(?:{one_of(pack.legit_doubles)})(?!{WORD}))"
    return F.regexp_replace(_col(c), rf"(?iu)(?<!{RUN}){keep}({WORDS})(?:[\s\u00a0\u202f]+\1)+(?!{RUN})", "$1")


def fix_typography(c: Column | str) -> Column:
    text = _col(c)
    for pattern, new in (
        (r"[ \t]{2,}", " "),
        (r"(?U)\s+([,.])", "$1"),
        (r"(?U)\s*([;:!?»])", " $1"),
        (r"(?U)(«)\s*", "$1 "),
        (rf"({WORD})(«)", "$1 $2"),
        (r"(?U)^\s*[,;:.]\s*", ""),
        # a mark before each letter that opens a sentence, to split on below
        (r"(?U)([.!?…]\s+)([a-zà-öø-ÿ])", "$1\u0001$2"),
    ):
        text = F.regexp_replace(text, pattern, new)
    upper_first = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
    return strip(F.array_join(F.transform(F.split(text, "\u0001"), upper_first), ""))


def clean_line(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    return fix_typography(collapse_repeats(strip_fillers(c, pack), pack))


# ---- tokens, numbers, acronyms -------------------------------------------

def tokens(c: Column | str) -> Column:
    return extract_all(F.lower(_col(c)), WORDS)


def numbers(c: Column | str) -> Column:
    """Numbers in writing order; ``1 000`` equals ``1000``, ``10,5`` equals ``10.5``."""
    tidy = lambda n: F.regexp_replace(F.replace(F.regexp_replace(n, THOUSANDS, ""), F.lit(","), F.lit(".")), r"\.+$", "")
    return F.transform(extract_all(_col(c), NUMBER), tidy)


def acronyms(c: Column | str) -> Column:
    return extract_all(_col(c), ACRONYM)


def count_of(text: Column, piece: Column) -> Column:
    """How often a literal piece stands in the text, none for an empty piece."""
    shorter = F.length(text) - F.length(F.replace(text, piece, F.lit("")))
    return F.when(F.length(piece) > 0, F.floor(shorter / F.length(piece))).otherwise(0).cast("int")


def _uncovered(left: Column, right: Column, done) -> Column:
    """``done`` of the items that ``left`` has more often: item, n more, place of the first one more.

    Both sides are sorted into one list, the right side first among equal items; the work
    grows with n log n.
    """
    tag = lambda items, side: F.transform(items, lambda x, i: F.struct(x.alias("v"), F.lit(side).alias("side"), i.alias("i")))
    joined = F.array_sort(F.concat(tag(right, 0), tag(left, 1)))
    at = lambda rows, k: F.get(rows, k)

    def runs(rows):
        size = F.size(rows)
        index = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        opens = lambda k: (k == 0) | (at(rows, k - 1)["v"] != at(rows, k)["v"])
        starts = F.filter(index, opens)
        own = F.filter(index, lambda k: (at(rows, k)["side"] == 1) & (opens(k) | (at(rows, k - 1)["side"] == 0)))

        def compare(found):
            spans = F.transform(found["starts"], lambda s, j: F.struct(s.alias("s"), F.coalesce(F.get(found["starts"], j + 1), size).alias("e")))
            spans = F.filter(spans, lambda r: at(rows, r["e"] - 1)["side"] == 1)  # runs that the left side has, as ``own`` lists them
            more = F.zip_with(spans, found["own"], lambda r, m: F.struct(
                at(rows, m)["v"].alias("v"), (r["e"] - m - (m - r["s"])).alias("n"), F.get(rows, m + m - r["s"])["i"].alias("i")
            ))
            return done(F.filter(more, lambda x: x["n"] > 0))

        return let(F.struct(starts.alias("starts"), own.alias("own")), compare)

    return let(joined, runs)


def bag_missing(left: Column, right: Column) -> Column:
    """Items of ``left`` missing from ``right``, multiplicity counted, each once.

    An item is listed at the first occurrence the right side cannot cover.
    """
    listed = lambda more: F.transform(F.array_sort(F.transform(more, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])
    return _uncovered(left, right, listed)


def missing_ratio(left: Column, right: Column) -> Column:
    """Share of the left bag that the right bag does not cover."""
    lost = _uncovered(left, right, lambda more: F.aggregate(more, F.lit(0), lambda n, x: n + x["n"]))
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(lost / F.size(left))


# ---- folding and keys ----------------------------------------------------

@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition without marks, from the Unicode tables.

    One-to-one results feed ``translate``; combining marks are dropped; the
    few one-to-many results are replaced one by one.
    """
    source, target, many = [], [], []
    ranges = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07))
    for low, high in ranges:
        for code in range(low, high):
            char = chr(code)
            plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
            if plain == char or not plain:
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            elif char.isalnum():
                many.append((char, plain))
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code))]
    return "".join(source + marks), "".join(target), tuple(many)


def unaccent(c: Column | str) -> Column:
    source, target, many = _fold_table()
    wide = "[" + "".join(char for char, _ in many) + "]"

    def plain(text):
        one = F.translate(text, source, target)
        full = one
        for char, letters in many:
            full = F.replace(full, F.lit(char), F.lit(letters))
        return F.when(text.rlike(wide), full).otherwise(one)

    # plain ASCII, the common case, is left alone
    return F.when(_col(c).rlike(r"[^\x00-\x7f]"), plain(_col(c))).otherwise(_col(c))


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.lower(unaccent(c))


def compare_words(c: Column | str) -> Column:
    """Lower-case words without accents."""
    return extract_all(fold(c), WORDS)


def norm_key(c: Column | str) -> Column:
    """Case, accents, blanks and dots off: the identity of a name."""
    return F.regexp_replace(F.replace(fold(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def norm_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


def match_norm(c: Column | str) -> Column:
    """Lower case, blanks squeezed, border punctuation off; accents stay."""
    return F.regexp_replace(F.lower(squeeze(c)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def cache_key(kind: Column | str, citation: Column | str) -> Column:
    return F.concat(_col(kind), F.lit(":"), match_norm(citation))


def slug(c: Column | str) -> Column:
    text = F.regexp_replace(unaccent(c), r"[^\x00-\x7f]", "")
    text = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\s_]+", "-"), r"^-+|-+$", "")
    return F.when(text == "", F.lit("cours")).otherwise(text)


# ---- tolerant search -----------------------------------------------------

def fingerprint(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", ""))


def locate_span(haystack: Column | str, needle: Column | str, min_len: int = 4) -> Column:
    """First place of ``needle`` when only letters and digits count.

    ``struct<start,end>`` with 0-based half-open bounds in the haystack, or null.
    """
    hay = _col(haystack)
    alnum = r"[\p{L}\p{N}]"

    def span(v):
        places = F.filter(
            F.transform(F.split(hay, ""), lambda ch, i: F.when(ch.rlike(alnum), i)), lambda i: i.isNotNull()
        )
        return let(places, lambda p: F.struct(
            F.element_at(p, v["at"]).cast("bigint").alias("start"),
            (F.element_at(p, v["at"] + v["n"] - 1) + 1).cast("bigint").alias("end"),
        ))

    fp = fingerprint(needle)
    found = F.struct(F.position(fp, fingerprint(hay)).alias("at"), F.length(fp).alias("n"))
    return let(found, lambda v: F.when((v["n"] >= min_len) & (v["at"] > 0), span(v)))


# ---- excerpts ------------------------------------------------------------

EXCERPT = 120


def excerpt_at(text: Column, position: Column, tidy=squeeze) -> Column:
    """120 characters centred on a 0-based position, with ellipses."""
    start = F.greatest(position - EXCERPT // 2, F.lit(0))
    body = tidy(F.substring(text, (start + 1).cast("int"), F.lit(EXCERPT)))
    return F.when(position.isNull() | (body == ""), F.lit("")).otherwise(
        F.concat(
            F.when(start > 0, "…").otherwise(""), body,
            F.when(start + EXCERPT < F.length(text), "…").otherwise(""),
        )
    )


def excerpt(text: Column | str, around: Column | str | None = None) -> Column:
    return excerpt_of_flat(squeeze(text), around)


def excerpt_of_flat(flat: Column | str, around: Column | str | None = None) -> Column:
    """``excerpt`` of a text that is squeezed already."""
    flat = _col(flat)
    head = F.concat(F.substring(flat, 1, EXCERPT), F.when(F.length(flat) > EXCERPT, "…").otherwise(""))
    if around is None:
        return head
    at = F.position(_col(around), flat)
    return F.when((_col(around) != "") & (at > 0), excerpt_at(flat, at - 1, F.trim)).otherwise(head)


def tail(c: Column | str, max_chars: int = 400) -> Column:
    """The end of a text, cut at a blank."""
    text = _col(c)
    end = F.right(text, F.lit(max_chars))
    blank = F.instr(end, " ")
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.when(blank > 0, F.substring(end, blank + 1, F.lit(max_chars))).otherwise(end)
    )


def missing_context(raw: Column | str, clean: Column | str, token: Column | str) -> Column:
    """The revised text around the place where a lost token would stand; empty if it is not found.

    Up to five words before and after the token are looked for, most words first: both
    sides, then what follows, then what stands before. Only letters and digits count.
    """
    spoken, word = squeeze(raw), rf"{WORD}+"

    def sides(v):
        begin, end = F.substring(v["t"], 1, v["at"] - 1), F.substring(v["t"], v["at"] + F.length(v["k"]), F.length(v["t"]))
        # a word that the token cuts is no neighbour
        begin = F.when(v["k"].rlike(f"^{WORD}"), F.regexp_replace(begin, rf"{word}$", "")).otherwise(begin)
        end = F.when(v["k"].rlike(f"{WORD}$"), F.regexp_replace(end, rf"^{word}", "")).otherwise(end)
        return F.struct(F.reverse(extract_all(begin, word)).alias("b"), extract_all(end, word).alias("a"))

    def tries(w):
        def of(n):
            left, right = F.array_join(F.reverse(F.slice(w["b"], 1, n)), " "), F.array_join(F.slice(w["a"], 1, n), " ")
            return F.array(fingerprint(F.concat(left, right)), fingerprint(right), fingerprint(left))
        return F.flatten(F.transform(F.sequence(F.lit(5), F.lit(1), F.lit(-1)), of))

    def found(v):
        hits = F.filter(F.transform(v["tries"], lambda t: F.when(F.length(t) >= 8, F.position(t, v["hay"]))), lambda p: p > 0)
        letters = F.filter(F.transform(F.split(v["clean"], ""), lambda ch, i: F.when(ch.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
        return let(F.get(hits, F.lit(0)), lambda p: F.when(p.isNull(), F.lit("")).otherwise(excerpt_at(v["clean"], F.get(letters, p - 1))))

    start = F.struct(spoken.alias("t"), _col(token).alias("k"), F.position(_col(token), spoken).alias("at"))
    flat = squeeze(clean)
    searched = lambda w: let(F.struct(tries(w).alias("tries"), fingerprint(flat).alias("hay"), flat.alias("clean")), found)
    return let(start, lambda v: F.when(v["at"] > 0, let(sides(v), searched)).otherwise(F.lit("")))


# ---- recogniser signals --------------------------------------------------

def count_matches(c: Column, pattern: str) -> Column:
    return F.size(extract_all(c, pattern))


def split_count(c: Column | str) -> Column:
    """Number of white-space separated words."""
    return F.size(extract_all(_col(c), r"(?U)\S+"))


def unk_ratio(c: Column | str) -> Column:
    text = _col(c)
    words = split_count(text)
    unknown = count_matches(text, rf"(?i)<unk>|\[unk\]|(?<!{WORD})unk(?!{WORD})")
    return F.when(words == 0, F.lit(0.0)).otherwise(unknown / words)


_LOOP_GAPS = bytes(32 if chr(i) in '\t\n\x0b\f\r.,;:!?"()[]{}' else i for i in range(256))


def _loop_words(text: str) -> list[bytes]:
    """What ``LOOP_WORD`` finds, encoded."""
    if not text.isascii():
        for ch in "\u00a0…«»":
            text = text.replace(ch, " ")
    return text.encode().translate(_LOOP_GAPS).split()


def _loops(words: list) -> bool:
    """A group of 1-3 words six times in a row, or 4-20 words three times."""
    # n repeats of k words leave n*k - k words that were seen before
    n = len(words)
    again = n - len(set(words))
    if again < 5:
        return False
    for size in range(1, 21):
        run = size * (5 if size < 4 else 2)
        if again >= run and size + run <= n:
            if b"\1" * run in bytes(map(eq, words, words[size:])):
                return True
    return False


@F.pandas_udf(BooleanType())
def _has_loop(text: pd.Series) -> pd.Series:
    return pd.Series([_loops(_loop_words(t)) for t in text], dtype=bool)


def repetition_loop(c: Column | str) -> Column:
    return _has_loop(F.lower(F.coalesce(_col(c), F.lit(""))))


def loop_score(c: Column | str) -> Column:
    return repetition_loop(c).cast("double")


def sensitive_refs(c: Column | str) -> Column:
    """Legal references, numbers and acronyms that a new reading must keep."""
    text = _col(c)
    legal = F.transform(
        extract_all(
            text,
            rf"(?iu)(?<!{WORD})(?:articles?|alin[ée]as?|loi|d[ée]crets?|ordonnances?)\s+(?:[LRD]\.?\s*)?\d+(?:[-.]\d+)*",
        ),
        lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("")),
    )
    plain = extract_all(text, rf"(?<!{WORD})\d+(?:[.,]\d+)?(?!{WORD})")
    caps = extract_all(text, rf"(?<!{WORD})[A-ZÀ-ÖØ-Þ]{{2,}}(?:-[A-ZÀ-ÖØ-Þ]{{2,}})*(?!{WORD})")
    return F.array_distinct(F.concat(legal, plain, caps))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def retry_norm(c: Column | str) -> Column:
    return F.array_join(extract_all(F.lower(_col(c)), rf"{WORDS}|<unk>"), " ")


def retry_words(c: Column | str) -> Column:
    return F.size(extract_all(F.lower(_col(c)), rf"{WORDS}|<unk>"))


def _opening(pattern: str) -> str:
    """What a pattern must meet first: a word border and a letter, a line start, or a mark; empty if not plain to see."""
    if "|" in re.sub(r"\([^()|]*(?:\|[^()|]*)*\)", "", pattern):
        return ""
    found = re.match(r"(\\b)[a-z](?![?*{])|(\^)|([<\"])(?![?*{])", pattern)
    return next(filter(None, found.groups())) if found else ""


def one_of_led(patterns) -> str:
    """``one_of``, with what neighbouring patterns open with tried once for all of them."""
    parts = []
    for how, run in groupby(patterns, _opening):
        run = list(run)
        rest = one_of(p[len(how) :] for p in run)
        letters = "".join(sorted({p[2] for p in run})) if how == r"\b" else ""
        parts.append(f"{how}(?=[{letters}])(?:{rest})" if letters else f"{how}(?:{rest})" if how else rest)
    return one_of(parts)


def meta_markers(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    found = extract_all(F.coalesce(_col(c), F.lit("")), "(?iU)" + one_of_led(pack.meta_markers))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(strip(x)))))


def model_artifacts(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    found = extract_all(F.coalesce(_col(c), F.lit("")), "(?im)" + one_of_led(pack.model_artifacts))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(strip(x)))))


def has_legal_reference(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    return fold(c).rlike("(?U)" + one_of(f"(?:{p})" for p in pack.legal_references))


def is_measure_body(c: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    return fold(c).rlike(rf"(?U)\b(?:{one_of(pack.measure_bodies)})\b")


# ---- windows over words --------------------------------------------------

def _hits(words: Column, known) -> Column:
    """0/1 per word: known to the set (a list of literals or an array column)."""
    if isinstance(known, Column):
        return F.transform(words, lambda w: F.array_contains(known, w).cast("int"))
    return F.transform(words, lambda w: w.isin(*known).cast("int"))


def _total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda a, x: a + x)


def best_window(flags: Column, window: int) -> Column:
    """Largest share of ones over every window of a 0/1 array, by prefix sums."""
    best = F.aggregate(
        flags,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: let(
            F.struct(
                (a["i"] + 1).alias("i"),
                (a["run"] + x - F.when(a["i"] >= window, F.element_at(flags, a["i"] - window + 1)).otherwise(0)).alias("run"),
            ),
            lambda b: F.struct(
                b["i"].alias("i"), b["run"].alias("run"),
                F.greatest(a["best"], F.when(b["i"] >= window, b["run"]).otherwise(0)).alias("best"),
            ),
        ),
        lambda a: a["best"],
    )
    return F.when(F.size(flags) >= window, best / F.lit(window))


def window_support(raw_words: Column, words: Column, window: int = 8) -> Column:
    """Best share of known words over every window of the candidate."""
    # most words are known, so each is looked for among the few that are not
    flags = let(F.array_except(words, raw_words), lambda new: F.transform(words, lambda w: (~F.array_contains(new, w)).cast("int")))
    return let(flags, lambda f: best_window(f, window))


def opening_support(raw_words: Column, candidate: Column | str, min_words: int = 4) -> Column:
    """Share of known words in the first line, when more than one line is filled."""
    lines = F.filter(F.split(_col(candidate), LINE_ENDS), lambda x: ~is_blank(x))
    first = F.when(F.size(lines) > 1, compare_words(F.element_at(lines, 1)))
    share = lambda v: F.when(
        F.size(v["w"]) >= min_words, _total(_hits(v["w"], v["raw"])) / F.size(v["w"])
    )
    return let(F.struct(first.alias("w"), raw_words.alias("raw")), share)


def language_leak(raw: Column | str, candidate: Column | str, pack: RulePack = DEFAULT_PACK) -> Column:
    """Foreign function words introduced by the candidate, whole or in a 12-word window."""
    native, foreign = pack.native_markers, pack.foreign_markers
    foreign_words = F.array(*[F.lit(w) for w in foreign])

    def leak(v):
        cand, raw_w = v["cand"], v["raw"]
        introduced = F.aggregate(
            foreign_words, F.lit(0),
            lambda acc, m: acc + F.greatest(
                F.size(F.filter(cand, lambda w: w == m)) - F.size(F.filter(raw_w, lambda w: w == m)), F.lit(0)
            ),
        )
        applies = (F.size(cand) >= 8) & (_total(_hits(raw_w, native)) >= 2)
        flags = F.struct(_hits(cand, foreign).alias("f"), _hits(cand, native).alias("n"))
        return F.when(applies & (introduced >= 4), let(flags, foreign_anywhere)).otherwise(F.lit(False))

    def foreign_part(f, n, size):
        return (f >= 4) & (f / size >= 0.30) & (f > n)

    def foreign_anywhere(v):
        f, n = v["f"], v["n"]
        whole = foreign_part(_total(f), _total(n), F.size(f))
        local = F.when(
            F.size(f) >= 12,
            F.exists(
                F.sequence(F.lit(1), F.size(f) - 11),
                lambda i: foreign_part(_total(F.slice(f, i, 12)), _total(F.slice(n, i, 12)), F.lit(12)),
            ),
        ).otherwise(F.lit(False))
        return whole | local

    return let(F.struct(tokens(raw).alias("raw"), tokens(candidate).alias("cand")), leak)
