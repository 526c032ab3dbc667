import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import language, queries

EN = "the cat sat on the mat and then it went to the house with another friend of mine "
FR = "le chat est dans la maison avec une autre amie et nous mangeons du pain tous les jours "
SCHEMA = "doc_id long, text string, lang string, score int"


def rows(spark, more=()):
    data = [(i, (EN, FR)[i % 2] * 3, ("en", "fr")[i % 2]) for i in range(60)]
    return spark.createDataFrame([(*r, 0) for r in [*data, *more]], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    return language.learned(rows(spark, [(90, None, "en"), (91, EN, None), (92, "", "fr")]))


def test_held_out_accuracy(spark):
    from conftest import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.col("lang").alias("told"))
    got = queries.QUERIES["op7_language_id"](spark, SF_DIR).join(docs, "doc_id").collect()
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got} == {True}
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.told for r in tested) >= 0.97 * len(tested) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures(model):
    assert model.languages == ["en", "fr"]
    both = model.mixture(EN * 3 + FR)
    assert set(both) == {"en", "fr"} and 0.6 < both["en"] < 0.85
    assert set(model.mixture(EN)) == {"en"} and set(model.mixture(FR * 50)) == {"fr"}
    assert model.predict(FR * 3 + EN)[0] == "fr"


def test_texts_without_letters_and_long_ones(spark, model):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "12 ½ — !"), (4, "x"), (None, FR), (5, EN * 40_000), (5, EN), (6, "東京 ß \U0001f600")],
        "doc_id long, text string",
    )
    got = language.identify(docs.withColumn("lang_pred", F.lit(0)), model).collect()
    by = {(r.doc_id, len(r.text or "")): (r.lang_pred, r.score) for r in got}
    assert len(got) == 8 and [by[k] for k in ((1, 0), (2, 0), (3, 8))] == [("und", 0.0)] * 3
    assert by[4, 1][0] in ("en", "fr") and by[None, len(FR)][0] == "fr" and by[5, len(EN) * 40_000][0] == "en"
    assert by[6, 6][0] in ("en", "fr")


def test_nothing_to_learn(spark):
    empty = rows(spark).where("doc_id < 0")
    model = language.learned(empty)
    assert model.predict(EN) == ("und", 0.0)
    assert language.identify(empty, model).count() == 0


def test_proportions_maximise_the_likelihood():
    likely = np.array([[1.0, 0.1], [0.1, 1.0], [1.0, 0.1]])
    share = language.proportions(likely, np.array([0.5, 0.5]))
    grid = [np.log(likely @ np.array([p, 1 - p])).sum() for p in np.linspace(0, 1, 1001)]
    assert np.log(likely @ share).sum() > max(grid) - 1e-3


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(260)]
    own = {x: " ".join("".join(chr(0x4E00 + 40 * i + (7 * w + 3 * c) % 40) for c in range(3)) for w in range(12)) for i, x in enumerate(names)}
    data = [(i, own[x], x, 0) for i, x in enumerate(names)] + [(1000 + i, own[x] + " ", x, 0) for i, x in enumerate(names[:200])]
    model = language.fit(spark.createDataFrame(data, SCHEMA))
    assert model.languages == names
    assert [model.predict(own[x])[0] for x in names] == names
    both = model.mixture(own["l003"] * 3 + " " + own["l255"])
    assert set(both) == {"l003", "l255"} and both["l003"] > 0.5


def test_sparse_and_dense_tables_agree(model, monkeypatch):
    counts = []
    for text in (EN * 3, FR * 3):
        bucket, n = np.unique(language.trigrams(text)[0], return_counts=True)
        counts.append((bucket, n))
    dense = language.tabled(["en", "fr"], counts)
    monkeypatch.setattr(language, "DENSE_LANGUAGES", 1)
    sparse = language.tabled(["en", "fr"], counts)
    for text in (EN, FR, EN * 3 + FR, "x", "unseen words ß", "", None):
        one, two = dense.mixture(text), sparse.mixture(text)
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-4 for k in one)
