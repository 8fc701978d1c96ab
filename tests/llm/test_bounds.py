"""Bounds that hold whatever ids repeat: training samples, page tokeniser."""

import time
import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import common, language, pagetext


def test_an_id_of_very_many_rows_gives_one_text(spark):
    docs = spark.range(20000).selectExpr("CAST(IF(id < 19000, 7, id) AS BIGINT) AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(i, i % 2) for i in range(19000, 19050)]], "doc_id long, quality int")
    rows = common.training_rows(docs, labels, "quality", 3, 1, 100)
    assert len(rows) == len(set(rows)) <= 52
    assert rows == common.training_rows(docs.repartition(7), labels, "quality", 3, 1, 100)


def test_training_texts_fit_a_budget(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('x', 1000) || id AS text")
    keyed = docs.withColumn("y", docs.doc_id * 0)
    taken = common.one_each(keyed, ["doc_id", "y"], 10_100)
    assert len(taken) == 10
    assert {r.doc_id for r in taken} <= {r.doc_id for r in common.one_each(keyed, ["doc_id", "y"], 20_000)}


def test_language_sample_with_null_and_repeated_ids(spark):
    words = {"en": "the house of the river and the tree", "de": "das haus und der fluss mit dem baum", "fr": "la maison et la riviere avec les arbres"}
    rows = [(None, words["en"] + f" {chr(97 + i % 26)}", "en") for i in range(300)] + [(4, words["de"] + f" {chr(97 + i % 26)}", "de") for i in range(300)]
    rows += [(i, words["fr"] + f" {chr(97 + i % 26)}", "fr") for i in range(400)] + [(1000, None, "it"), (1001, "123", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=20)
    assert model.names == ["de", "en", "fr"]
    got = {(r.doc_id, r.text): r._lang for r in language.identified(docs, model).collect()}
    assert all(got[i, t] == (lang if t and any(c.isalpha() for c in t) else "und") for i, t, lang in rows)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<!" * 500_000, "<p>text</p>" + "<a href='" * 110_000, "<" * 1_000_000, "<!-- " * 200_000])
def test_pages_of_unclosed_tags_take_linear_time(page):
    begin = time.time()
    pagetext.blocks(page)
    assert time.time() - begin < 2


def test_text_behind_the_last_tag():
    texts = [b.text for b in pagetext.blocks("<p>one</p>two < three <a href='x <!-- not this")]
    assert texts == ["one", "two < three <a href='x"]
    assert [b.text for b in pagetext.blocks("no tags at all & 1 < 2")] == ["no tags at all & 1 < 2"]


def test_what_an_element_is_counts_before_its_class():
    page = "<article class='post has-sidebar'><p>kept words</p><div class='sidebar'>gone</div><footer>gone</footer></article><div class='main'>unknown</div>"
    assert [pagetext.weak_label(b) for b in pagetext.blocks(page)] == [1.0, 0.0, 0.0, None]


def test_page_labels_and_vectors_are_finite():
    page = pagetext.blocks("<article>" + "<p>some words of it</p>" * 50 + "</article>")
    assert np.isfinite(pagetext.vectors(page)).all() and len(page) == 50


def test_hashing_takes_little_memory_however_many_texts_a_batch_has():
    texts = np.tile(np.frombuffer(b"some words of a text that is repeated ", np.uint8), 200_000)
    bounds = np.arange(0, len(texts) + 1, len(texts) // 2000)
    common._powers(common._BASE, 1 << 20)
    common._powers(common._INVERSE, 1 << 20)
    tracemalloc.start()
    for *_, part, inner in common.row_slices(texts, bounds):
        common.window_hashes(common.word_hashes(part, inner), 35)
    common.give_back()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
