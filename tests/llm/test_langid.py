import zlib

import pyarrow as pa

from tests.llm import cases
from tickersieve.llm import langid
from tickersieve.llm.queries import op6_language_id, table


def test_held_out_accuracy(spark, sf_dir):
    out = {r.doc_id: r for r in op6_language_id(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").collect()
    assert len(out) == len(rows)
    tested = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in tested} == {i for i, r in out.items() if r.held_out}
    assert sum(out[r.doc_id].lang_pred == r.lang for r in tested) >= 0.97 * len(tested)


LANGUAGES = {"en": "the house and the water of the night with many words ", "de": "das haus und das wasser der nacht mit vielen wörtern ", "fr": "la maison et l'eau de la nuit avec beaucoup de mots "}


def model(spark):
    rows = [(k, text * 3, lang, "s", 0) for k, (lang, text) in enumerate(LANGUAGES.items())] + [(8, None, "en", "s", 0), (9, "xyz", None, "s", 0)]
    return langid.fit(spark.createDataFrame(rows, cases.SCHEMA))


def test_mixtures(spark):
    fitted = model(spark)
    assert fitted.languages == ["de", "en", "fr"]
    texts = [LANGUAGES["en"] * 4, LANGUAGES["de"] * 3 + LANGUAGES["fr"], LANGUAGES["fr"].upper(), "", None, "1 2 !"]
    share = langid.proportions(pa.array(texts), fitted)
    assert share[0].round(3).tolist() == [0, 1, 0]
    assert 0.65 < share[1][0] < 0.85 and share[1][1] == 0 and 0.15 < share[1][2] < 0.35
    assert share[2].argmax() == 2 and not share[3:].any()
    together = langid.proportions(pa.array(texts[::-1]), fitted)
    assert abs(together[::-1] - share).max() < 1e-5


def test_awkward_rows_nothing_to_learn_and_empty_table(spark):
    found = langid.predict(cases.awkward(spark), model(spark)).collect()
    assert len(found) == 14 and all(0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in found)
    none = langid.fit(cases.docs(spark, [(1, "abc")]).where("lang is not null"))
    assert {(r.lang_pred, r.score) for r in langid.predict(cases.awkward(spark), none).collect()} == {("und", 0.0)}
    assert langid.languages(cases.empty(spark)).collect() == []
    assert langid.languages(cases.awkward(spark)).count() == 14
