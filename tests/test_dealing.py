"""Work is dealt to all tasks, however few files, bytes or words it comes in."""

from pyspark.sql import functions as F

from scriptorium.operators import edits as E, findings as N, lexicon as L, validate as V
from scriptorium.session import spread


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_file_are_dealt_on_a_cluster(spark, monkeypatch):
    df = spark.range(20, numPartitions=1)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    dealt = spread(df, "id")
    assert "RepartitionByExpression" in _plan(dealt)
    assert sorted(r["id"] for r in dealt.collect()) == list(range(20))


def test_retries_are_compared_after_they_are_dealt(spark):
    rows = [(1, i, f"un deux trois {i}", f"un deux quatre {i}", "unk_ratio_eleve") for i in range(6)]
    tried = V.choose_retry(spark.createDataFrame(rows, "doc_id long, seg_idx long, original string, retry string, issue string"))
    assert tried.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = _plan(tried.filter("action = 'use_retry'"))
    assert plan.count("[_similar(") == 1 and plan.index("[_similar(") < plan.index("RepartitionByExpression")


def test_no_text_is_moved_to_find_legacy_documents(spark):
    rows = [(d, i, f"segment-{i}", "a ", "a" if d != 2 else "b", "S0") for d in (1, 2) for i in (1, 2)] + [(3, 1, None, None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos long, block_id string, text string, raw_text string, speaker string")
    segments = blocks.select("doc_id", F.col("pos").alias("seg_idx"), "speaker")
    found = E.legacy_docs(blocks, segments, spark.createDataFrame([], "doc_id long"))
    plan = _plan(found)
    assert "raw_text" not in plan[: plan.index("Join FullOuter")]
    assert [r["doc_id"] for r in found.collect()] == [1]


def _most_rows(node):
    """The largest output of a join in a plan that has run."""
    name, inner = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        inner = [node.executedPlan()]
    elif name.endswith("QueryStage"):
        inner = [node.plan()]
    else:
        inner = [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *map(_most_rows, inner)])


def test_a_word_of_all_needles_and_all_texts_pairs_nothing(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03}")
    texts = [(i, f"selon l'article {i} du code {word(i)}s, oui") for i in range(300)] + [(300, "-- , --"), (301, None)]
    needles = [(i, f"article {i} du code {word(i)}") for i in range(300)] + [(300, ", "), (301, "ode"), (302, "code bb"), (303, "du code absent"), (304, ""), (305, None)]
    got = L.contains_join(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", spark.createDataFrame(needles, "n long, needle string"), "needle")
    got = got.select("id", "n")
    rows = got.collect()
    assert sorted(tuple(r) for r in rows) == sorted((t, n) for t, text in texts for n, needle in needles if text and needle and needle in text)
    assert _most_rows(got._jdf.queryExecution().executedPlan()) < 20_000  # 90,000 pairs of 300 texts and 300 needles


def test_new_texts_move_the_blocks_once(spark):
    word = lambda t, s: (s, s + 1.0, t, 0.5)
    rows = [(1, "a", 0.0, 2.0, "un deux", [word("un", 0.0), word("deux", 1.0)]), (1, "b", 2.0, 3.0, "trois", [word("trois", 2.0)]), (None, "a", 0.0, 1.0, "seul", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_id string, start double, end double, text string, words array<struct<start double, end double, text string, confidence double>>")
    edits = spark.createDataFrame([(1, "a", "un neuf", 1), (None, "a", "perdu", 1), (2, "a", "perdu", 1)], "doc_id long, block_id string, text string, seq long")
    out = E.set_text(blocks, edits)
    assert _plan(out).count("Join ") == 1 and "Union" not in _plan(out)
    got = {(r["doc_id"], r["block_id"]): (r["text"], r["words"] and [tuple(w) for w in r["words"]]) for r in out.collect()}
    assert got == {(1, "a"): ("un neuf", [(0.0, 1.0, "un", 0.5), (1.0, 2.0, "neuf", None)]), (1, "b"): ("trois", [(2.0, 3.0, "trois", 0.5)]), (None, "a"): ("seul", None)}


PAIRS = "doc_id long, block_id string, start double, raw string, clean string"
NAMES = "term string, pos string, name string, category string, verified boolean"


def test_lost_tokens_are_looked_for_once(spark):
    rows = [(1, "a", 0.0, "le  SMIC vaut 12", "le smic"), (1, "b", 1.0, "le SMIC", "le SMIC"), (2, "a", 0.0, None, "x"), (2, "b", 0.0, "x", None)]
    names = spark.createDataFrame([("smic", "1", "smic", "droit", True), ("vautour", "2", "valt", "droit", True)], NAMES)
    out = N.rule_findings(spark.createDataFrame(rows, PAIRS), names)
    assert _plan(out).count("(?<!") <= 4  # the pattern of acronyms, for the findings themselves only
    got = sorted((r["doc_id"], r["block_id"], r["kind"], r["severity"], r["raw_excerpt"]) for r in out.collect())
    assert got == [(1, "a", "chiffre", "haute", "le SMIC vaut 12"), (1, "a", "coupure", "haute", "le SMIC vaut 12"), (1, "a", "terme", "haute", "le SMIC vaut 12")]


def test_terms_of_candidates_are_searched_once(spark):
    rows = [(1, "a", "rien", "rien smic"), (1, "b", "smib", "smic"), (2, "a", "le smic", "smic dit"), (3, "a", None, "smic")]
    names = spark.createDataFrame([("smic", "1", "smic", "droit", True)], NAMES)
    out = L.ungrounded_entities(spark.createDataFrame(rows, "doc_id long, block_id string, raw string, candidate string"), names)
    assert "array_except" not in _plan(out)
    assert sorted((r["doc_id"], r["block_id"], r["term"]) for r in out.collect()) == [(1, "a", "smic"), (3, "a", "smic")]
