import numpy as np
import pytest

from loomgraph.llm import language
from loomgraph.session import table


@pytest.mark.parametrize("label,want", [("en_GB", "en"), ("Deutsch", "de"), ("NL", "nl"), ("pt-BR", "pt"), ("ger", "de"), ("und", None), ("", None), (None, None), ("n/a", None), ("sv", "other"), ("français", "fr")])
def test_labels(label, want):
    assert language.label_notation(label) == want


def test_prose_lines():
    text = "## tools/library.ts\n> The parser keeps `fooBar` open (#12).\n```\nlet it be the code here\n```\n\nconst a = b.c(d, 3);\nif nothing else is running, the scan stops (#3)."
    assert [n for n, _, _ in language.prose_lines(text)] == [1, 7]
    assert language.prose_lines(None) == [] and language.prose_lines("x = 1;") == []
    assert language.repaired("Ã€ la fin de la journÃ©e") == "À la fin de la journée"


def brute(word, pieces):
    if not word:
        return np.ones(len(language.LANGUAGES))
    total = np.zeros(len(language.LANGUAGES))
    for i in range(1, len(word) + 1):
        if (p := pieces.get(word[:i])) is not None:
            total += p * brute(word[i:], pieces)
    return total


def test_forward_sums_all_segmentations():
    model = language.fit({}, language.vocabulary(), rounds=1)
    for word in ("parser", "que", "ausgabe"):
        assert np.allclose(np.exp(model.score(word)), brute(" " + word, model.pieces), rtol=1e-6)


def test_function_words_alone_tell_languages_apart():
    model = language.fit({}, language.vocabulary())
    said = {"en": "there is no reason why they would not have been here", "de": "es gibt keinen Grund, weil wir nicht wissen, ob sie noch da sind", "fr": "il n'y a aucune raison pour que nous ne soyons pas avec eux", "es": "no hay ninguna razón por la que no estén todos con ellos",
            "it": "non c'è nessun motivo per cui tutti questi sono ancora nella lista", "pt": "não há nenhuma razão para que eles não estejam também com você", "nl": "er is geen enkele reden waarom zij het niet zouden hebben"}
    for lang, text in said.items():
        assert [s[1] for s in language.stretches(text, model)] == [lang]
    mixed = language.stretches("\n".join(said[x] for x in ("en", "en", "de", "fr")), model)
    assert [(s[0], s[1], s[3], s[4]) for s in mixed] == [(0, "en", 1, 2), (1, "de", 3, 3), (2, "fr", 4, 4)] and all(0 < s[2] <= 1 for s in mixed)


def test_held_out_labels(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    model = language.fit(language.sample_counts(docs.where("doc_id % 2 = 0")), language.vocabulary())
    seen = right = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        found = language.stretches(r.text, model)
        if found and len({s[1] for s in found}) == 1 and (label := language.label_notation(r.lang)):
            seen += 1
            right += label == found[0][1]
    assert seen > 300 and right / seen > 0.85  # a tenth of the labels is wrong


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "The parser reads the list of all open files."), (2, "de", None), (3, "de", ""), (4, "x", "The parser reads it. " * 20_000), (4, "x", "a\nb")], "doc_id long, lang string, text string")
    got = language.identify(df).collect()
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in got) == [(1, 0, "en"), (4, 0, "en")]
    assert language.to_correct(language.identify(df)).count() == 2 and language.identify(df.limit(0)).count() == 0


def test_long_words_are_scored_whole():
    """Words beyond the length where logarithms take over, against the plain forward sums in long floats."""
    model = language.fit({}, language.vocabulary(), rounds=1)
    word = "donaudampfschifffahrtsgesellschaftskapitaen"
    text, total = " " + word, [np.ones(len(language.LANGUAGES), dtype=np.longdouble)]
    for j in range(1, len(text) + 1):
        total.append(sum((total[i] * model.pieces[text[i:j]] for i in range(j) if text[i:j] in model.pieces), np.zeros(len(language.LANGUAGES), dtype=np.longdouble)))
    assert len(word) > language._CLOSE and np.allclose(model.score(word), np.log(total[-1]).astype(float), rtol=1e-9)
    assert np.isfinite(model.score("x" * 5000)).all()
    again = language.fit({"de": {word: 50.0}}, language.vocabulary(), rounds=2)
    assert again.score(word).argmax() == language.LANGUAGES.index("de")
