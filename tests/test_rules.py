"""Hand-written cases in the spirit of each rule."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import fields, text as T
from scriptorium.operators import findings as N, validate as V


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [
    ("euh, donc je je pense", "Donc je pense"),
    ("nous nous levons", "Nous nous levons"),
    ("bonjour ,  ça va?", "Bonjour, ça va ?"),
    ("fin. ensuite on part", "Fin. Ensuite on part"),
    ("heum bah", ""),
    (", voilà", "Voilà"),
    ("il dit«oui»", "Il dit « oui »"),
    ("peut-être-heu non", "Peut-être-heu non"),
])
def test_clean_line(spark, raw, clean):
    assert one(spark, raw, T.clean_line) == clean


def test_numbers_and_acronyms(spark):
    assert one(spark, "1 000 000 puis 10,5 et 2024.", T.numbers) == ["1000000", "10.5", "2024"]
    assert one(spark, "ADN, A, SARS-CoV et PIB", T.acronyms) == ["ADN", "PIB"]


def test_fold_and_keys(spark):
    assert one(spark, "Élève ﬁn º", T.fold) == "eleve fin o"
    assert one(spark, "A.R.S. Straße", T.norm_key) == "arsstrasse"
    assert one(spark, "« Code  civil, »", T.match_norm) == "code civil"
    assert one(spark, "L'Été à Paris !", T.slug) == "lete-a-paris"


@pytest.mark.parametrize("text, loops", [
    ("oui " * 6, True), ("oui " * 5, False), ("non, non, non", False),
    ("a b c d " * 3, True), ("a b c d " * 2, False), ("a b " * 6, True), ("a b " * 5 + "a", False),
])
def test_repetition_loop(spark, text, loops):
    assert one(spark, text, T.repetition_loop) is loops


def test_locate_ignores_punctuation(spark):
    df = spark.createDataFrame([("Oui, « le Code » civil.", "CODE civil"), ("abc", "ab")], "h string, n string")
    got = [r["s"] for r in df.select(T.locate_span("h", "n").alias("s")).collect()]
    assert (got[0]["start"], got[0]["end"]) == (10, 22) and got[1] is None


def test_bag_difference_order(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a"], ["a"])], "x array<string>, y array<string>")
    assert df.select(T.bag_missing(F.col("x"), F.col("y")).alias("m")).first()["m"] == ["b", "a"]


def test_envelopes(spark):
    assert one(spark, "x <revised>a</revised> <revised> b </revised>", fields.candidate) == "b"
    assert one(spark, "whole answer", fields.candidate) is None
    assert one(spark, 'so: {"text": "ok"} end', lambda c: fields.candidate(c, True)) == "ok"


def test_findings(spark):
    p = spark.createDataFrame([
        (1, "b1", 0.0, "nous avons vu 15 cas graves", "nous avons vu des cas graves"),
        (1, "b2", 5.0, "le PIB monte", "le produit monte"),
        (1, "b3", 9.0, "un passage assez long pour fondre ici", "un passage"),
        (1, "b4", 9.5, "rien", "rien"),
    ], "doc_id long, block_id string, start double, raw string, clean string")
    got = {r["block_id"]: r for r in N.rule_findings(p, context=True).collect()}
    assert set(got) == {"b1", "b2", "b3"}
    assert (got["b1"]["kind"], got["b1"]["severity"]) == ("chiffre", "haute")
    assert got["b1"]["clean_excerpt"] == "nous avons vu des cas graves"
    assert got["b2"]["severity"] == "moyenne"
    assert "73 %" in got["b3"]["message"] and got["b3"]["raw_excerpt"]


CASES = [
    ("le juge a nommé un curateur pour cette dame âgée", "Le juge a nommé un curateur pour cette dame âgée.", []),
    ("le juge a nommé un curateur", "", ["empty"]),
    ("le juge a nommé un curateur pour cette dame", "le juge", ["too_short"]),
    ("le juge parle", "le juge parle <think>", ["model_artifact", "reasoning_leak"]),
    ("le juge parle de la loi", "le juge parle de la loi�", ["replacement_char"]),
    ("il dit oui", "il dit oui oui oui oui oui oui", ["added_word_ratio", "repetition_loop"]),
]


@pytest.mark.parametrize("raw, cand, reasons", CASES)
def test_validation(spark, raw, cand, reasons):
    df = spark.createDataFrame([(1, raw, cand)], "id long, raw string, candidate string")
    row = V.validate(df, keys=["id"]).first()
    assert row["reasons"] == reasons and row["valid"] is (not reasons)


RETRIES = [
    ("oui " * 8, "oui je viens", "boucle_de_tokens", "use_retry", "repetition_removed"),
    ("oui", "", "boucle_de_tokens", "keep_original", "retry_empty"),
    ("on a 12 cas", "on a 13 cas", "unk_ratio_eleve", "needs_review", "sensitive_reference_divergence"),
    ("le <unk> juge <unk> vient", "le bon juge nous vient", "unk_ratio_eleve", "use_retry", "unk_ratio_reduced"),
    ("", "bonjour à tous", "texte_vide_plage_longue", "use_retry", "speech_recovered"),
    ("un deux", "un " * 7, "boucle_de_tokens", "keep_original", "retry_still_repetitive"),
    ("un", " ".join("abcdefghijklmn"), "boucle_de_tokens", "needs_review", "retry_abnormal_expansion"),
]


@pytest.mark.parametrize("original, retry, issue, action, reason", RETRIES)
def test_retry_policy(spark, original, retry, issue, action, reason):
    row = V.choose_retry(spark.createDataFrame([(original, retry, issue)], "original string, retry string, issue string")).first()
    assert (row["action"], row["reason"]) == (action, reason)


@pytest.mark.parametrize("text, legal", [
    ("l'article 440 du code civil", True), ("Articles L. 471-1 à L. 471-9", True), ("la loi n° 2007-308", True),
    ("un bel article", False), ("le CASF prévoit", True), ("décret du matin", False),
])
def test_legal_reference(spark, text, legal):
    assert one(spark, text, T.has_legal_reference) is legal
