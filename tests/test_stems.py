"""Published step examples of the rules."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import stems

ENGLISH = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism
feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti
electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize
bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()
GERMAN = "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgenden aufeinanderfolg kategorie kategori kater kat katers kat katze katz katzen katz katzenschmer katzenschm häuser haus aufgabe aufgab abenteuer abenteu verständnisse verstandnis möglichkeiten moglich straße strass".split()

def stemmed(spark, pairs, lang):
    df = spark.createDataFrame([([a for a, _ in pairs], lang)], "w array<string>, lang string")
    return dict(zip([a for a, _ in pairs], df.select(stems.stems(F.col("w"), F.col("lang"))).first()[0]))


def test_english_step_examples(spark):
    pairs = list(zip(ENGLISH[::2], ENGLISH[1::2]))
    got = stemmed(spark, pairs, "en")
    assert {a: got[a] for a, b in pairs if got[a] != b} == {}


def test_german_examples(spark):
    pairs = list(zip(GERMAN[::2], GERMAN[1::2]))
    got = stemmed(spark, pairs, "de")
    assert {a: (got[a], b) for a, b in pairs if got[a] != b} == {}


@pytest.mark.parametrize("lang, words", [("fr", "chevaux cheval petites petit petite petit nations nation nation nation rapidement rapid parler parl dernière derni dernier derni"), ("es", "casas cas casa cas canciones cancion canción cancion luces luz luz luz rapidamente rapid hablando habl hablar habl ciudades ciudad")])
def test_light_rules_bring_forms_together(spark, lang, words):
    w = words.split()
    pairs = list(zip(w[::2], w[1::2]))
    got = stemmed(spark, pairs, lang)
    assert {a: (got[a], b) for a, b in pairs if got[a] != b} == {}


def test_other_words_stay(spark):
    df = spark.createDataFrame([(["the", "is", "gatos"], "xx"), (None, "en"), ([], "en"), (["as", "by", "yes"], "en"), (["cats"], None)], "w array<string>, lang string")
    assert [r[0] for r in df.select(stems.stems(F.col("w"), F.col("lang"))).collect()] == [["the", "is", "gatos"], None, [], ["as", "by", "ye"], ["cats"]]
