import time

import pytest

from loomspan.llm import languages, pairs

Q = "Who measured the rare isotope near Old Vendora?"
CASES = [
    (Q, None, ["empty"]),
    (Q, "<final>　</final>", ["empty"]),
    (Q, "<search></search>", ["empty"]),
    (Q, "n/a.", ["empty"]),
    (Q, "<search>isotope 1944</search>", []),
    (Q, "<final>Ada Vendor</final>", []),
    (Q, "Answer: 1944", []),
    (Q, "Yes", []),
    ("是吗？", "是的", []),
    (Q, "return measure_isotope(12)", []),
    (Q, "final>Ada Vendor measured the rare isotope near Old Vendora in 1944.", []),
    (Q, Q + " 1944", []),
    (Q, "<final>" + Q.lower() + "</final>", ["copied_question"]),
    (Q, "You asked: " + Q, ["copied_question"]),
    (Q, Q + " " + Q, ["copied_question"]),
    (Q, "Ada Vendor declined to answer the isotope inquiry and said it could not be settled before 1944.", []),
    (Q, "I'm sorry, but I cannot answer this question.", ["refusal"]),
    ("谁测量了同位素？", "抱歉，我无法回答这个问题。", ["refusal"]),
    ("Wer hat das Thema Isotop gemessen?", "Leider kann ich diese Frage nicht beantworten.", ["refusal"]),
    (Q, "Selon les notes de Vendora, Ada a terminé ce dossier en 1944 avec 12 autres pièces.", ["wrong_language"]),
    (Q, "罕见的同位素由Ada Vendor于1944年测量，共有12项记录。", ["wrong_language"]),
    (Q, "The folder is titled “回滚测量记录”, and Ada Vendor signed it in 1944.", []),
    (Q, "The rare isotope was measured by Ada Ven", ["truncated"]),
    (Q, "Ada Vendor measured the (", ["truncated"]),
    (None, "The isotope was measured in 1944.", []),
    (Q, "word " * 20000 + ".", []),
]


def test_each_rule(spark):
    rows = [(i, *case[:2], "x") for i, case in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, question string, answer string, plain string")
    got = {r.id: r.defects for r in pairs.defects(df).collect()}
    for i, (_, answer, expected) in enumerate(CASES):
        assert got[i] == expected, answer


def test_empty_table(spark):
    df = spark.createDataFrame([], "question string, answer string")
    assert pairs.defects(df).count() == 0


@pytest.mark.parametrize("text,expected", [("This is the end of it.", "en"), ("Das ist der Rest von allem.", "de"), ("这是一个完整的句子。", "zh"), ("Это конец длинного рассказа.", "ru"), ("これは長い文章の終わりです。", "ja"), ("Zzz qqq", None), ("", None), (None, None)])
def test_language(text, expected):
    assert languages.language(text) == expected


#: Sentences that the scorer wasn't fitted on.
HELD_OUT = {
    "en": ["The minister refused to comment on the letter yesterday.", "Most of the rooms have been empty since the winter.", "It will be hard to find another one like this.", "Which of the two was built first?", "All of them were counted twice before dawn."],
    "de": ["Der Minister wollte den Brief gestern nicht kommentieren.", "Die meisten Zimmer stehen seit dem Winter leer.", "Es wird schwer sein, noch so einen zu finden.", "Welcher von beiden wurde zuerst gebaut?", "Alle wurden vor Tagesanbruch zweimal gezählt."],
    "fr": ["Le ministre n'a pas voulu commenter la lettre hier.", "La plupart des chambres sont vides depuis l'hiver.", "Il sera difficile d'en trouver un autre comme celui-ci.", "Lequel des deux a été construit en premier ?", "Tous ont été comptés deux fois avant l'aube."],
    "es": ["El ministro no quiso comentar la carta ayer.", "La mayoría de las habitaciones están vacías desde el invierno.", "Será difícil encontrar otro como este.", "¿Cuál de los dos se construyó primero?", "Todos fueron contados dos veces antes del amanecer."],
    "it": ["Il ministro non ha voluto commentare la lettera di ieri.", "La maggior parte delle stanze è vuota dall'inverno.", "Sarà difficile trovarne un altro come questo.", "Quale dei due è stato costruito per primo?", "Tutti sono stati contati due volte prima dell'alba."],
    "pt": ["O ministro não quis comentar a carta ontem.", "A maioria dos quartos está vazia desde o inverno.", "Vai ser difícil encontrar outro como este.", "Qual dos dois foi construído primeiro?", "Todos foram contados duas vezes antes do amanhecer."],
    "nl": ["De minister wilde gisteren niet op de brief reageren.", "De meeste kamers staan sinds de winter leeg.", "Het zal moeilijk zijn om er nog zo een te vinden.", "Welke van de twee werd het eerst gebouwd?", "Ze werden allemaal twee keer geteld voor zonsopgang."],
}


def test_languages_of_held_out_sentences():
    told = [(k, languages.language(s)) for k, own in HELD_OUT.items() for s in own]
    assert all(got in (k, None) for k, got in told)
    assert sum(got == k for k, got in told) >= 0.7 * len(told)


def test_languages_of_labelled_documents(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").where("lang in ('en', 'de', 'zh') and source not in ('lcc', 'repobench') and text is not null").collect()
    told = [(r.lang, languages.language(r.text[:400])) for r in rows]
    told = [t for t in told if t[1] is not None]
    assert len(told) > 40 and sum(a == b for a, b in told) >= 0.97 * len(told)


#: Refusals in other words than the rules were written from, and answers that only look like one.
PARAPHRASES = [
    "I am really not in a position to answer that.",
    "We're not able to tell from these pages.",
    "I simply don't know.",
    "I have no way of knowing who that was.",
    "I would only be guessing here.",
    "Anything more would be speculation.",
    "That lies outside my knowledge, I fear.",
    "The request cannot reliably be answered.",
    "No reliable answer is possible on this basis.",
    "I apologise, the texts say nothing about it.",
    "There is not enough information in the passages to say.",
    "As an AI assistant, that is not for me to judge.",
    "I'll have to pass.",
    "Es tut mir leid, dazu weiß ich nichts.",
    "Ich möchte darauf lieber nicht antworten, ich muss passen.",
    "Das lässt sich anhand der Texte leider nicht sagen.",
    "我不知道这件事。",
    "这超出了我的能力。",
    "很抱歉，资料不足。",
]
ANSWERS = [
    "The council refused to answer and closed the hearing in 1912.",
    "She wrote that it could not be settled before 1944.",
    "The clerk said that it cannot be determined by sight alone.",
    "It was beyond the river, near the old mill.",
    "The guard was sorry about the noise, as the notes show.",
    "He decided not to go.",
    "Der Rat lehnte die Anfrage 1912 ab.",
    "他拒绝回答有关预算的询问。",
    "Guessing was a popular game in the town.",
    "The letters were unable to reach the coast.",
]


def test_refusals_in_other_words(spark):
    df = spark.createDataFrame([(None, a) for a in PARAPHRASES + ANSWERS], "question string, answer string")
    got = {r.answer: "refusal" in r.defects for r in pairs.defects(df).collect()}
    assert [a for a in PARAPHRASES if not got[a]] == []
    assert [a for a in ANSWERS if got[a]] == []


def test_edit_distance_is_cut_off(spark):
    long = "why was it so long and who wrote it " * 600
    df = spark.createDataFrame([(long + "?", long), (long, "z" + long[:-9]), (long, long[::-1])], "question string, answer string")
    began = time.monotonic()
    got = [r.defects for r in pairs.defects(df).collect()]
    assert ["copied_question" in d for d in got] == [True, True, False]
    assert time.monotonic() - began < 120


def test_a_question_without_its_mark_may_be_answered(spark):
    df = spark.createDataFrame([("In which year did Ada measure the isotope?", "In which year did Ada measure the isotope 1944")], "question string, answer string")
    assert pairs.defects(df).first().defects == []
