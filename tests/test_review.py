"""The one pass over pairs against the column rules, and that it runs once."""

from pyspark.sql import functions as F

from scriptorium.config import DEFAULT_PACK
from scriptorium.functions import text as T
from scriptorium.functions.align import _align
from scriptorium.functions.review import reviewed
from scriptorium.operators import evaluate as E, validate as V

LONG = "Le juge des tutelles écoute la personne et rend une décision motivée par écrit"
PAIRS = [
    ("", ""), ("a b", ""), ("", "a b"), (LONG, LONG), (LONG, LONG[:40]), (LONG, "Préambule tout neuf ici\n" + LONG),
    (LONG, LONG + " in the rules of the user we should rewrite this passage"), (LONG, "mot " * 7 + LONG), ("x y " * 9, "x y " * 9 + "x"),
    ("PIB de 1 000 euros, SARS-CoV et ADN", "pib de 1000 euros, SARS et l'ADN"), ("12 et 13,5 puis 12", "12 et 13.5"),
    ("İstanbul ΟΔΟΣ café ﬁn œuvre ½ x² ", "istanbul οδος café fin oeuvre 1⁄2 x2"), ("un deux trois quatre cinq six sept huit neuf", "un\x1cdeux trois quatre cinq six sept huit neuf dix"),
    ("a b c d e f g h i j", "k b c l d e m f g h i n j"), (None, "a"), ("l’été «vient» bientôt… 🙂 AB", "L’ÉTÉ «vient» bientôt AB"),
]


def test_one_pass_equals_the_column_rules(spark):
    df = spark.createDataFrame([(i, r or "", c) for i, (r, c) in enumerate(PAIRS)], "i int, raw string, candidate string")
    df = df.withColumns({"rw": T.compare_words("raw"), "cw": T.compare_words("candidate")})
    both = lambda w: (F.size("rw") >= w) & (F.size("cw") >= w)
    rules = {
        "words_raw": F.size(T.tokens("raw")), "words_candidate": F.size(T.tokens("candidate")),
        "altered_numbers": T.missing_ratio(T.numbers("raw"), T.numbers("candidate")),
        "altered_acronyms": T.missing_ratio(T.acronyms("raw"), T.acronyms("candidate")),
        "loop_introduced": T.repetition_loop("candidate") & ~T.repetition_loop("raw"), "language_leak": T.language_leak("raw", "candidate"),
        "opening_support": F.when(both(8), T.opening_support(F.col("rw"), "candidate")),
        "support_8": F.when(both(8), T.window_support(F.col("rw"), F.col("cw"), 8)), "support_10": F.when(both(10), T.window_support(F.col("rw"), F.col("cw"), 10)),
    }
    rows = df.withColumn("s", reviewed("raw", "candidate", DEFAULT_PACK, (8, 10))).select("raw", "candidate", "s", *[c.alias(n) for n, c in rules.items()]).collect()
    for row in rows:
        assert {n: row["s"][n] for n in rules} == {n: row[n] for n in rules}, row
        assert (row["s"]["added"], row["s"]["longest_added"]) == _align(row["raw"], row["candidate"])[:2], row


def test_refused_rows_are_judged_once(spark):
    df = spark.createDataFrame([(1, "b", r, c) for r, c in PAIRS], "doc_id long, block_id string, raw string, candidate string")
    out = V.rejection_findings(V.accept_or_fallback(V.validate(df, keys=["doc_id"])))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the texts are read by the pass and by the two patterns, none of them again for the filter
    assert plan.count("we must") == 1 and plan.count("_aligned(") == 1
    assert out.count() == V.validate(df, keys=["doc_id"]).filter("not valid").count() > 5


def test_a_sweep_counts_kinds_of_rows(spark):
    rows = [("accept", ["empty"], 1.0, None), ("accept", [], 0.55, 0.45), ("reject", ["prefix_misaligned"], 0.95, 0.9), ("reject", [], None, None)] * 50
    df = spark.createDataFrame([(e, r, *[s] * len(E.WINDOWS), o) for e, r, s, o in rows], "expected string, reasons array<string>, " + ", ".join(f"support_{w} double" for w in E.WINDOWS) + ", opening_support double")
    got = {(r["kind"], r["window"], r["floor"]): (r["false_accept"], r["false_reject"]) for r in E.threshold_sweep(df).collect()}
    refused = lambda s, o, floor, opening: s is not None and (s < floor or (o is not None and o < opening))
    for kind, window, floor, opening, shown in [("window", w, f, E.OPENING_FLOOR, f) for w in E.WINDOWS for f in E.FLOORS] + [("opening", E.WINDOW, E.SUPPORT_FLOOR, f, f) for f in E.OPENING_FLOORS]:
        no = [set(r) - {"prefix_misaligned"} or refused(s, o, floor, opening) for _, r, s, o in rows]
        want = sum(e == "reject" and not n for n, (e, *_) in zip(no, rows)), sum(e == "accept" and bool(n) for n, (e, *_) in zip(no, rows))
        assert got.pop((kind, window, shown)) == want
    assert not got
    # rows are counted before they meet the grid
    plan = E.threshold_sweep(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")


def test_words_beside_and_padded_words(spark):
    from scriptorium.functions.review import padded_words, words_beside

    df = spark.createDataFrame([(r or "", c) for r, c in PAIRS], "raw string, candidate string")
    rows = df.select(
        words_beside("raw", "candidate").alias("x"), F.array_except(T.compare_words("candidate"), T.compare_words("raw")).alias("new"),
        F.array_distinct(T.compare_words("candidate")).alias("all"), padded_words("raw").alias("p"),
        F.concat(F.lit(" "), F.array_join(T.compare_words("raw"), " "), F.lit(" ")).alias("q"),
    ).collect()
    for r in rows:
        assert [x["w"] for x in r["x"]] == r["all"] and [x["w"] for x in r["x"] if x["new"]] == r["new"] and r["p"] == r["q"]


def test_texts_are_cut_into_words_once_for_new_names(spark):
    from scriptorium.operators import lexicon as L

    names = L.lexicon_names(spark.createDataFrame([("tutelle", ["JUG"], ["juge des tutelles"])], "term string, acronyms array<string>, variants array<string>").withColumn("pos", F.lit(1)))
    df = spark.createDataFrame([(1, "rien", "la tutelle"), (2, "la tutele", "la tutelle"), (3, None, "le juge des tutelles"), (4, "le JUG", "tutelle"), (5, "tutelle", "tutelle")], "id long, raw string, candidate string")
    out = L.ungrounded_entities(df, names)
    assert sorted(map(tuple, out.collect())) == [(1, "tutelle"), (3, "tutelle")]
    # the column rule for words folds letter by letter; it is left for the names
    assert "translate(raw" not in out._jdf.queryExecution().optimizedPlan().toString()
