"""The pipeline's stages one after another, and as a whole."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    good = "some plain words that a reader would keep because nothing is wrong with them at all and there are more than fifty of them here so that the base rule is met by the text and the rest of the words only fill the line until the count is well above what is asked for in total {}"
    numbers = ["seven oaks stand near our river", "old bridges carry quiet people home", "green hills hide small white houses", "bright stars guide lonely ships north"]
    rows = [(i, good.format(n) + f" write to me{i}@mail.example.org " + n * 3, "en", "a", 1) for i, n in enumerate(numbers)]
    rows += [(10, rows[0][1], "en", "b", 1), (11, "too short", "en", "b", 1), (12, None, None, None, None), (13, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stage(spark, seen, "")
        if k < 4:
            assert seen.columns == docs.columns
    ids = {r.doc_id for r in seen.collect()}
    assert 11 not in ids and 12 not in ids and 13 not in ids and 10 not in ids


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "encoding"]
