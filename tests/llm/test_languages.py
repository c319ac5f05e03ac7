import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import languages as lg

SENTENCES = {
    "en": ["The parser reads the source list before it touches the cache, so a restart never loses work.", "You can turn this off by setting the value to zero in the project settings.", "We moved the function out of the indexer because it was called from three places.", "There is a test for this next to the one for the walker."],
    "de": ["Der Parser liest die Liste der Quellen, bevor er den Zwischenspeicher ändert.", "Man kann dieses Verhalten abschalten, indem man den Wert auf null setzt.", "Leider ist nicht dokumentiert, warum die Funktion für die Kopfzeile zuständig ist.", "Bitte rufen Sie die Suche nicht auf, solange das Werkzeug noch arbeitet."],
    "fr": ["L'outil lit la liste des sources avant de modifier le cache, ainsi rien n'est perdu.", "On peut désactiver ce comportement en mettant la valeur à zéro dans les réglages.", "Malheureusement, rien n'explique pourquoi la fonction s'occupe de cela.", "N'appelez pas la recherche tant que l'outil n'a pas terminé."],
    "es": ["El analizador lee la lista de fuentes antes de cambiar la memoria intermedia.", "Se puede desactivar este comportamiento poniendo el valor a cero en los ajustes.", "Por desgracia no está documentado por qué la función hace este trabajo.", "No llames a la búsqueda mientras la herramienta siga trabajando."],
    "pt": ["O analisador lê a lista de fontes antes de mudar a memória temporária.", "Pode-se desligar esse comportamento colocando o valor em zero nos ajustes.", "Infelizmente não está documentado por que a função faz esse trabalho.", "Não chame a busca enquanto a ferramenta ainda estiver trabalhando."],
    "nl": ["De ontleder leest de lijst met bronnen voordat het tussengeheugen wordt aangepast.", "Je kunt dit gedrag uitschakelen door de waarde op nul te zetten.", "Helaas staat nergens beschreven waarom de functie dit werk doet.", "Roep de zoekopdracht niet aan zolang het gereedschap nog bezig is."],
}


@pytest.fixture(scope="module")
def models():
    return lg.train({k: v * 3 for k, v in SENTENCES.items()})


def test_probabilities_of_a_model_sum_to_one():
    m = lg._count(lg.encode(["ab abc ba cab", "bca b"])[0])
    symbols = np.arange(len(lg._LETTERS) + 2, dtype=np.int32)
    a, b, c = (int(lg.encode([x])[0][1]) for x in "abc")
    for context in ((a, b, c), (b, a, 0), (61, 61, 61), (0, a, b)):
        code = ((context[0] << lg.BITS | context[1]) << lg.BITS | context[2]) << lg.BITS | symbols
        assert lg._probability(m, lg.ORDER, code).sum() == pytest.approx(1.0, abs=1e-9)


def test_lookup_equals_the_recursion(models):
    text = [SENTENCES["de"][0] + " xqzzk"]
    sums, n = models.sentence_scores(text)
    code = lg._codes(lg.encode(text)[0], lg.ORDER)[:-1]  # the last one ends in the blank after the sentence
    want = [np.log(lg._probability(p, lg.ORDER, code)).sum() for p in models.parts]
    assert n[0] == len(code) and np.allclose(sums[0], want, rtol=1e-5)


def test_sentences_of_each_language(models):
    for lang, s in {"en": "The walker keeps the path filter and ignores the second call.", "de": "Die Suche wartet höchstens zwei Sekunden und meldet sich danach.", "pt": "Quando a função é chamada duas vezes, o sistema não muda nada.", "nl": "Het programma zit het grootste deel van de tijd in de wachtrij."}.items():
        assert models.languages[int(models.sentence_scores([s])[0][0].argmax())] == lang


def test_prose_leaves_out_code_headings_and_quotations():
    text = "# Titel der Seite ist deutsch\n\nThe log then says «die Datei ist nicht da» to the reader. See `foo_bar`.\n\n```python\nx = 'Das ist kein Satz.'\n```\n\n- Dies ist ein Satz in einer Liste.\nno stop here\n\n| a | b |\n"
    found = lg.prose(text)
    assert len(found) == 2
    assert "Datei" not in found[0][2] and text[found[1][0] : found[1][1]].strip().startswith("Dies ist ein Satz")
    assert lg.prose("") == [] and lg.prose("def f():\n    return 1\n") == []


def test_labels(value):
    for label, want in {"EN": "en", "en_US": "en", " German ": "de", "pt-BR": "pt", "und": "", "": "", "Klingon": "klingon", "nld": "nl", "français": "fr"}.items():
        assert value(lg.label_language, x=label) == want


def test_documents(spark, models):
    de, en, fr = (" ".join(SENTENCES[x]) for x in ("de", "en", "fr"))
    rows = [(1, "de", de), (2, "en", de), (3, None, en), (4, "en", en + "\n\n" + fr), (5, "unknown", "x = 1\n"), (6, "en", None), (7, "en", ""), (8, "de_AT", de + "\r\n" + de), (9, "en", en + ' The log says "' + SENTENCES["de"][0] + '" then.'), (10, "fr", (fr + " ") * 300)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"id": F.lit(0), "language": F.lit("x")})
    seg = lg.language_segments(df, models=models)
    got = sorted(map(tuple, lg.corrected_languages(seg).collect()))
    assert got == [(2, "de"), (3, "en"), (4, "en"), (4, "fr")]
    parts = seg.where("id = 4").orderBy("segment").collect()
    assert [r["language"] for r in parts] == ["en", "fr"] and all(0.9 < r["confidence"] <= 1 for r in parts)
    text = rows[3][2]
    assert text[parts[1]["start_char"] : parts[1]["end_char"]].strip() == fr
    assert lg.language_segments(df.limit(0), models=models).count() == 0


def test_fit_on_labelled_documents(spark):
    rows = [(i * 10 + k, lang, s) for k, (lang, ss) in enumerate(SENTENCES.items()) for i in range(12) for s in [" ".join(ss)]]
    rows[0] = (0, "de", rows[0][2])  # a wrong label
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = lg.fit(df, "doc_id", "text", "lang")
    wrong = lg.corrected_languages(lg.language_segments(df, models=m))
    assert [tuple(r) for r in wrong.collect()] == [(0, "en")]
    assert lg.fit(df.limit(0), "doc_id", "text", "lang").languages == lg.LANGUAGES


def test_confidence_is_calibrated_on_held_out_sentences(spark):
    import os

    import pytest

    data = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables")
    df = spark.read.parquet(data)
    models = lg.fit(df.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    assert 1.0 <= models.temperature <= 16.0
    held = df.where("doc_id % 2 = 1 and lang in ('en', 'de', 'fr', 'es', 'pt', 'nl')").select("text", "lang").toPandas()
    sure, right = [], []
    for text, lang in held.itertuples(index=False):
        found = [s for *_, s in lg.prose(text)]
        if found:
            sums, _ = models.sentence_scores(found)
            p = lg.confidence(sums, models.temperature)
            sure += p.max(1).tolist()
            right += [models.languages[k] == lang for k in sums.argmax(1)]
    # labels of the data are wrong now and then, so no more than they allow is asked for
    assert len(sure) > 200 and abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.2
