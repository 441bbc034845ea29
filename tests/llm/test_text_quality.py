import random
from datetime import datetime

from pyspark.sql import functions as F

from gradeloom.llm import cutoff, languages, pairs, reading

SAMPLES = "sample_index long, question string, answer string, ground_truth string, contexts array<string>, metadata string, lang string, source string, created_at timestamp, ingested_at timestamp, text string, record_id long, k1 string, named string"

EN = ["The river runs past the old mill every morning.", "My sister bought three apples and a loaf of bread.", "You should count the tiles before you multiply the rows.", "They walked home because the bus was late again.", "This answer is right but the second step is missing."]
IT = ["Il fiume passa vicino al vecchio mulino ogni mattina.", "Mia sorella ha comprato tre mele e un pezzo di pane.", "Devi contare le piastrelle prima di moltiplicare le righe.", "Sono tornati a casa perché il treno era in ritardo.", "Questa risposta è giusta ma manca il secondo passo."]
DE = ["Der Fluss fließt jeden Morgen an der alten Mühle vorbei.", "Meine Schwester hat drei Äpfel und ein Brot gekauft.", "Du solltest die Fliesen zählen, bevor du die Reihen malnimmst.", "Sie gingen nach Hause, weil der Bus wieder zu spät kam.", "Diese Antwort ist richtig, aber der zweite Schritt fehlt."]


def samples(spark, rows):
    """rows: (index, question, answer, ground_truth, lang, source)."""
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, q, a, g, [], None, lang, src, at, at, "clash", 5, "clash", "clash") for i, q, a, g, lang, src in rows], SAMPLES)


def graded(spark):
    rows = [(lang, s) for lang, ss in (("en", EN), ("it", IT), ("de", DE)) for s in ss]
    return spark.createDataFrame([(i, lang, 1 + i % 2, s) for i, (lang, s) in enumerate(rows)], "graded_id long, lang string, reading_level int, text string")


def test_labels(spark):
    df = spark.createDataFrame([("en",), ("en_GB",), ("EN-us",), ("eng",), ("English",), (" it-IT ",), ("und",), ("xx",), ("",), (None,), ("enx",), ("deu",)], "l string")
    assert [r[0] for r in df.select(languages.label_language(F.col("l"))).collect()] == ["en"] * 5 + ["it"] + [None] * 5 + ["de"]


def test_languages_of_mixed_and_mislabelled_rows(spark):
    rows = [(1, EN[0], EN[1] + " " + IT[1], None, "en", "s"), (2, IT[0], IT[2], None, "en", "s"), (3, DE[0], "Ja.", None, None, "s"), (4, EN[2], EN[3], None, "English", "s"), (4, EN[2], EN[3], None, "English", "s"), (5, None, None, None, "it", "s"), (6, "", "​ 12 34", None, "it", "s"), (7, EN[0], (EN[1] + " ") * 3000 + DE[1], None, "en", "s"), (None, IT[0], IT[0], None, "en", "s")]
    s = samples(spark, rows)
    model = languages.samples_model(s, graded(spark))
    got = sorted(map(tuple, languages.unnamed_languages(s, model).collect()))
    assert got == [(1, "answer", "it"), (2, "answer", "it"), (2, "question", "it"), (3, "question", "de"), (7, "answer", "de")]
    seg = languages.detect(s.where("sample_index = 1"), model, ["sample_index"], ["answer"], segments=True).first()["answer"]
    assert [x["lang"] for x in seg] == ["en", "it"] and all(0.5 < x["confidence"] <= 1 for x in seg)
    assert (EN[1] + " " + IT[1])[seg[1]["start"] : seg[1]["stop"]].strip() == IT[1]


def test_texts_without_evidence_are_unknown_and_shares_are_the_mixtures(spark):
    model = languages.samples_model(samples(spark, [(1, EN[0], EN[1], None, "en", "s")]), graded(spark))
    got = languages.describe(model, ["東京都 大阪市 名古屋市 札幌市 福岡市。", None, "", "12 34", EN[0], " ".join(EN + IT[:1])])
    assert [x["lang"] for x in got[0]] == [languages.UNKNOWN] and got[1:4] == [[], [], []]
    assert [x["lang"] for x in got[4]] == ["en"] and [x["lang"] for x in got[5]] == ["en", "it"]
    assert abs(sum(x["share"] for x in got[5]) - 1) < 1e-9 and 0.7 < got[5][0]["share"] < 0.9
    assert languages.segments_of(model, ["東京都 大阪市 名古屋市 札幌市 福岡市。"])[0][0]["lang"] == languages.UNKNOWN
    # A longer text asks for more evidence of a further language.
    assert model.penalty(1000) > model.penalty(10) > languages.PENALTY


def test_language_models_without_data(spark):
    s = samples(spark, [])
    model = languages.samples_model(s, graded(spark).where("false"))
    assert languages.unnamed_languages(s, model).count() == 0
    assert languages.detect(samples(spark, [(1, "q", "a b c d e", None, "en", "s")]), model, ["sample_index"], ["answer"]).count() == 1


def corpus(n=400, seed=1):
    random.seed(seed)
    names = ["Anna", "Bruno", "Clara", "David", "Elena", "Frank"]
    verbs = ["measures", "multiplies", "subtracts", "compares", "estimates"]
    things = ["rectangle", "triangle", "denominator", "equation", "polygon"]
    ends = ["on the blackboard", "with great care", "after the lesson", "in the afternoon"]
    sent = lambda: f"{random.choice(names)} {random.choice(verbs)} the {random.choice(things)} {random.choice(ends)}."
    return [" ".join(sent() for _ in range(random.randint(4, 8))) for _ in range(n)]


def test_cut_texts_are_found_and_whole_ones_are_not(spark):
    texts = corpus()
    rows, want = [], set()
    for i, t in enumerate(texts):
        if i % 10 == 0:
            rows.append((i, t[:150], "limited"))
            want.add(i)
        elif i % 10 == 1:
            k = t.rindex(" the ") + 8
            rows.append((i, t[:k] + random.choice(["", "…", "...", "-", "�", '"}', "  "]), "other"))
            want.add(i)
        elif i % 10 == 2:
            rows.append((i, t[:-1], "other"))  # a whole sentence without its stop
        elif i % 10 == 3:
            rows.append((i, t + random.choice(["…", "\n\n— Ottilie", "\n1) 31\n2) 45", " 😊", "\n$$x = 4$$"]), "other"))
        else:
            rows.append((i, t, "other"))
    rows += [(900 + i, "no judge was needed", "other") for i in range(6)] + [(950, "x = 4", "other"), (951, "42", None), (952, None, "other"), (953, "", "other"), (954, "​", None), (955, "word " * 40000 + "meas", "other")]
    rows += [(0, texts[0][:150], "limited")]
    want.add(955)
    df = spark.createDataFrame([("answer", i, g, t, "clash") for i, t, g in rows], "field_name string, record_id long, grp string, text string, k1 string")
    got = [r for r in cutoff.find_cut(df).collect()]
    assert len(got) == len({r["record_id"] for r in got})
    ids = {r["record_id"] for r in got}
    ok = {i for i in want if i < 400 and i % 10 == 0 and rows[i][1].rstrip().endswith(".")}
    assert ids == want - ok, (sorted(ids - want)[:5], sorted(want - ok - ids)[:5])
    rates = {r["grp"]: r["rate"] for r in cutoff.cut_rates(df, cutoff.find_cut(df)).collect()}
    assert rates["limited"] > 0.9 > 0.3 > rates["other"]
    assert cutoff.find_cut(df.where("false")).count() == 0


def test_copies_of_a_cut_text_are_found(spark):
    texts = corpus(seed=3)
    ends = ["a ladder beside the triang", "a ladder (beside the wall", "a ladder beside the Müller clock…", "a ladder of his own beside the"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + 100 * j + i, f"{texts[j]} Bruno measures {e}") for j, e in enumerate(ends) for i in range(40)]
    whole = ["value from rougeX", "timeout after 60 s"]
    rows += [(2000 + i, f"rougeX over {i} tokens and some seconds") for i in range(60)] + [(3000 + 100 * j + i, t) for j, t in enumerate(whole) for i in range(40)]
    df = spark.createDataFrame([("answer", i, None, t) for i, t in rows], "field_name string, record_id long, grp string, text string")
    ids = {r["record_id"] for r in cutoff.find_cut(df).collect()}
    assert ids == {1000 + 100 * j + i for j in range(len(ends)) for i in range(40)}
    short = df.where("record_id = 3").select("field_name", F.xxhash64(cutoff.core(F.expr("substring(text, 1, length(text) - 1)"))).alias("core"), F.explode(F.sequence(F.lit(4000), F.lit(4039))).alias("record_id"), "grp", F.expr("substring(text, 1, length(text) - 1)").alias("text"))
    got = cutoff.find_cut(df.unionByName(short.drop("core")), shortened=short)
    assert {r["record_id"] for r in got.where("record_id >= 4000").collect()} == set(range(4000, 4040))


def test_values_and_list_items_cut_inside_a_word_are_found(spark):
    texts = [(i, t) for i, t in enumerate(corpus(seed=4))]
    texts += [(1000, "Multipl"), (1001, "Clara multipl"), (1002, "The worksheet has two steps.\n1) Anna measures\n2) Bruno subtrac"), (1003, "Anna"), (1004, "The worksheet has two steps.\n1) Anna measures\n2) Bruno subtracts")]
    df = spark.createDataFrame([("answer", i, None, t) for i, t in texts], "field_name string, record_id long, grp string, text string")
    assert {r["record_id"] for r in cutoff.find_cut(df).collect()} == {1000, 1001, 1002}


def test_trie_nodes(spark):
    w = spark.createDataFrame([("measure", 5, 0), ("measured", 2, 0), ("me", 9, 9), ("x", 7, 0)], "word string, n long, opens long")
    got = {r["word"]: r["below"] for r in cutoff.trie_nodes(w).collect()}
    assert got["me"] == 7 and got["measure"] == 2 and "measured" not in got


def test_shortened_versions(spark):
    texts = ["a long enough text to be compared…", "a long enough text to be compared with others", "a long enough text", "short", "zz other text altogether", "we get x = 4", "we get x = 45", "they get x = 4", "they get x = 45", "they get x = 4y", "zz other text altogether!!", ""] + [f"filler text number {i:05d} of many" for i in range(200)]
    df = spark.createDataFrame([("answer", i, None, t) for i, t in enumerate(texts)] + [("answer", 0, None, texts[0]), ("answer", 999, None, None)], "field_name string, record_id long, grp string, text string")
    cores = df.select("record_id", F.xxhash64(cutoff.core(F.col("text"))).alias("core"))
    assert {r["record_id"] for r in cores.join(pairs.shortened(df), "core").collect()} == {0, 2, 7}
    assert pairs.shortened(df.where("false")).count() == 0


def test_copies():
    q = "Why does the red line change when I double the tree?"
    for t in (q, q.upper(), f'"{q}"', "You asked: " + q, "> " + q[:-1], q + " " + q):
        assert pairs.copies(q, t), t
    for t in (q + " Because it grows.", q + " x = 12.", "The red line changes with the tree.", "", None, "Why?"):
        assert not pairs.copies(q, t), t
    assert not pairs.copies(None, "x") and pairs.copies("Student: a b c\nTeacher: d\nStudent: is it four or five then", "is it four or five then?")


def test_empty_and_refusal_rules():
    empty = [None, "", " \n", "​", "N/A", "n/a", "[no answer]", "<p></p>", '""', "—", "None", "...", "```\n```"]
    full = ["x = 4", "0", "27 %", "No.", "f(x) = 2", "Nothing else."]
    assert [pairs.is_empty(t) for t in empty + full] == [True] * len(empty) + [False] * len(full)
    refusals = ["I'm sorry, but I cannot help with that.", "The context does not contain enough information to answer.", "Mi dispiace, ma non posso aiutarti. Chiedi al tuo insegnante.", "No puedo responder a esta pregunta.", "Je ne peux pas répondre à cette question.", "Dabei kann ich leider nicht helfen."]
    others = ["I will not give you the result yet. Which side did you double?", "Sorry for the delay, the answer is 12.", "Anna wrote that one cannot answer this, but it works. Take 4 from 9.", "", None, "I can't tell you the answer, but look at the sign again. What do you notice?"]
    assert [pairs.is_refusal(t) for t in refusals + others] == [True] * len(refusals) + [False] * len(others)


#: Wordings that no listed pattern need match: what the fitted model must find by itself.
UNLISTED = [
    "That is something I won't go into.", "No reply will follow.", "I'm afraid this request can't be processed.", "My guidelines keep me from replying, so I can't respond to this question.", "I have to pass on this one, sorry, I can't speak to it.", "The passages given don't touch on this question.", "We are unable to process your request.", "I don't wish to discuss this topic.",
    "Impossible de traiter cette demande.", "Je ne vais pas traiter ce sujet.", "Aucune suite ne sera donnée à cette demande.", "Je ne suis pas autorisé à parler de ce sujet.", "Les extraits ne parlent pas de cette question.",
    "Non ho intenzione di trattare questo argomento.", "Impossibile elaborare la richiesta.", "Non mi è consentito parlare di questo argomento.", "I brani non parlano di questa domanda.", "Non ci sarà alcuna risposta a questa domanda.",
    "No voy a hablar de este tema.", "Es imposible atender esta solicitud.", "No estoy autorizado a hablar de este tema.", "Los fragmentos no hablan de esta pregunta.", "No habrá respuesta a esta pregunta.",
    "Darauf werde ich nicht eingehen.", "Diese Anfrage kann nicht bearbeitet werden.", "Zu diesem Thema äußere ich mich nicht.", "Unmöglich, dieser Bitte nachzukommen.", "Auf diese Frage wird keine Antwort folgen.",
]
ANSWERS = [
    "You can't add fractions with different denominators.", "No, the answer is 7.", "The sum of the two sides is not 10.", "Do not multiply before you add.", "I don't think that the sign is right.", "There are no more cards in the bag.", "It's impossible for a square to have three sides.", "Non dimenticare di aggiungere 4.", "La somma non è 10.", "Il triangolo non ha quattro lati.", "No olvides sumar 4.", "La suma no es 10.", "El triángulo no tiene cuatro lados.",
    "N'oublie pas d'ajouter 4.", "La somme n'est pas 10.", "Le triangle n'a pas quatre côtés.", "Vergiss nicht, 4 zu addieren.", "Die Summe ist nicht 10.", "Das Dreieck hat keine vier Seiten.", "I didn't follow your second step.", "We get nothing if we take 4 from 4.", "The list does not have to be sorted.", "I won't give you the result yet, but look at the second step.", "I can't tell you the answer, but try it with 4 first.",
]


def test_unlisted_refusals_are_found_by_the_fitted_model():
    from gradeloom.llm import refusals

    known = ["I'm sorry, but I cannot help with that.", "The context does not contain enough information to answer.", "Mi dispiace, ma non posso aiutarti.", "No puedo responder a esta pregunta.", "Je ne peux pas répondre à cette question.", "Dabei kann ich leider nicht helfen."]
    model = refusals.train([*known, *EN, *IT, *DE], pairs._declines, ["I do not understand why the answer is needed here."])
    found = [t for t in UNLISTED if pairs.is_refusal(t, model.declines)]
    listed = [t for t in UNLISTED if pairs.is_refusal(t)]
    assert len(found) >= 0.9 * len(UNLISTED) and len(listed) < 0.4 * len(UNLISTED), set(UNLISTED) - set(found)
    assert sum(pairs.is_refusal(t, model.declines) for t in ANSWERS) <= 1
    assert all(pairs.is_refusal(t, model.declines) for t in known)
    assert not refusals.suspects([None, "", "All is well."]).any() and refusals.train([], pairs._declines).declines("i cannot answer that.")


def test_refusals_in_any_sentence():
    long = " ".join(["I'm sorry.", "I cannot answer that.", "The context does not contain enough information to answer this particular question about the lesson of the day, the exercise on the board or the homework of this week.", "I am not able to help with any of the 12 steps, nor with the drawing, the table, the graph or the text that goes with them.", "I am not allowed to discuss the matter any further with anyone who has not been enrolled.", "Please ask your teacher."])
    yes = ["I'm sorry. I cannot answer that.", "Mi dispiace. Non posso rispondere a questa domanda.", "Es tut mir leid. Dabei kann ich nicht helfen.", long]
    no = ["I'm sorry. The answer is twelve.", "Take four from nine. One cannot say that it is prime.", "I'm sorry. I cannot tell you the answer, but look at the sign again.", "Sorry. Ask your teacher.", "I'm sorry. I cannot answer that. What did you try?"]
    assert [pairs.is_refusal(t) for t in yes + no] == [True] * len(yes) + [False] * len(no)


def test_defects_of_pairs(spark):
    rows = [(1, EN[0], None, None, "en", "s"), (2, EN[1], EN[1], EN[2], "en", "s"), (3, EN[0], IT[2], EN[3], "en", "s"), (4, EN[0] + " " + IT[0], IT[2], IT[3], "en", "s"), (5, None, "I am not able to answer this question.", "", "en", "s"), (5, None, "I am not able to answer this question.", "", "en", "s"), (6, EN[2], EN[4], DE[4], "xx", "s"), (None, EN[0], None, None, "en", "s")]
    s = samples(spark, rows)
    model = languages.samples_model(s, graded(spark))
    got = sorted(map(tuple, pairs.defects(s, model).collect()))
    assert got == [(1, "answer", "empty"), (2, "answer", "copies_question"), (3, "answer", "other_language"), (5, "answer", "refusal"), (6, "ground_truth", "other_language")]
    assert pairs.defects(s.where("false"), model).count() == 0


EASY = ["The cat sits.", "We see a dog.", "It is red.", "He has two pens.", "The sun is up.", "You run fast.", "She eats an egg.", "Put it here."]
HARD = ["Notwithstanding considerable methodological heterogeneity, the epistemological characterisation presupposes that successive approximations converge uniformly, whereas contextual appropriateness remains analytically distinguishable.", "Insofar as pedagogical scaffolding deliberately postpones disclosure, instructional dialogue progressively externalises implicit assumptions, thereby enabling sustained argumentative justification throughout successive iterations."]


def test_reading_levels(spark):
    random.seed(2)
    easy = lambda: " ".join(random.choice(EASY) for _ in range(14))
    hard = lambda: " ".join(random.choice(HARD) for _ in range(3))
    g = spark.createDataFrame([(i, "en", 1 if i % 2 else 4, easy() if i % 2 else hard()) for i in range(20)] + [(99, None, None, None)], "graded_id long, lang string, reading_level int, text string")
    rows = [(1, "q", easy(), None, "en", "s"), (2, "q", hard(), None, "en", "s"), (2, "q", hard(), None, "en", "s"), (3, "q", hard()[:260], None, "en", "s"), (4, "q", None, None, "en", "s"), (5, "q", "", None, "en", "s"), (6, "q", HARD[0], None, "en", "s"), (7, "q", hard() * 300, None, "en", "s"), (8, "q", "1 2 3 " * 20, None, "en", "s")]
    s = samples(spark, rows)
    enc = reading.encode(s, "sample_index", "answer")
    scale = reading.fit(enc, g)
    assert sorted(r[0] for r in reading.demanding(enc, scale).collect()) == [2, 7] + ([3] if len(rows[3][2].split()) >= 30 else [])
    got = {r["sample_index"]: r for r in reading.levels(enc, scale, "sample_index").collect()}
    assert got[1]["level"] == 1 and got[4]["level"] is None and got[5]["n_words"] == 0
    none = reading.fit(enc, g.where("false"))
    assert reading.demanding(enc, none).count() == 0 and reading.levels(enc, none, "sample_index").where("level is not null").count() == 0
    empty = reading.encode(s.where("false"), "sample_index", "answer")
    assert reading.levels(empty, reading.fit(empty, g), "sample_index").count() == 0


def test_words_of_hard_texts_are_learned_from_the_corpus(spark):
    """A hard word that no anchor holds gets its slope from the documents it stands in."""
    random.seed(5)
    easy = lambda: " ".join(random.choice(EASY) for _ in range(12))
    hard = lambda: " ".join(random.choice(HARD) for _ in range(2))
    g = spark.createDataFrame([(i, 1 if i % 2 else 4, easy() if i % 2 else hard()) for i in range(20)], "graded_id long, reading_level int, text string")
    rows = [(i, easy() + " Wombat and wombat." if i % 2 else hard() + " Isomorphisms notwithstanding isomorphisms.") for i in range(200)]
    enc = reading.encode(spark.createDataFrame(rows, "id long, answer string"), "id", "answer")
    scale = reading.fit(enc, g)
    import numpy as np

    (k, at) = scale.find(*reading.items(["isomorphisms wombat"])[:2])
    assert at[-1] == 2
    slopes = dict(zip(("isomorphisms", "wombat"), scale.slope[k, 0]))
    assert slopes["isomorphisms"] > 0.3 and slopes["wombat"] < -0.3
    assert not np.isnan(scale.levels(k, at, np.zeros((1, reading.LENGTHS), np.float32))[0]).any()


def test_reading_levels_of_held_out_items(spark):
    import os

    import pytest

    path = "/root/testdata/sf0.01/graded_items.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    import numpy as np

    rows = [(r["text"], float(r["reading_level"]), r["lang"]) for r in spark.read.parquet(path).orderBy("graded_id").collect()]
    corpus = reading.encode(spark.read.parquet("/root/testdata/sf0.01/samples.parquet"), "sample_index", "answer")
    wrong = 0
    for f in range(4):
        train, held = ([r for i, r in enumerate(rows) if (i % 4 == f) == side] for side in (False, True))
        scale = reading.fit_rows(corpus, [r[0] for r in train], np.array([r[1] for r in train]), [r[2] for r in train])
        keys, at, shape = reading.items([r[0] for r in held])
        theta, lang = scale.levels(*scale.find(keys, at), shape)
        assert [sorted({r[2] for r in rows})[x] for x in lang] == [r[2] for r in held]
        wrong += int((scale.grade(theta) != np.array([r[1] for r in held])).sum())
    assert wrong <= 0.05 * len(rows), wrong
