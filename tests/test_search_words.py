"""The search index by words: a book has as many postings as words, whatever their length, and many words are joined instead of named."""

from quire.operators import search_index as si
from quire.operators.catalog import search
from test_search_index import BOOKS, QUERIES, found


def test_postings_are_words(spark, tmp_path):
    index = si.SearchIndex(spark, f"{tmp_path}/index")
    books = [(str(i), "extraordinarily longwinded booktitles", "Somebody Unknown") for i in range(200)]
    index.update(spark.createDataFrame(books, si.BOOKS))
    assert index.postings().count() == 200 * 5
    words = index.words().count()  # of the vocabulary alone
    assert words < 150
    index.update(spark.createDataFrame([(f"n{i}", *b[1:]) for i, b in enumerate(books)], si.BOOKS))
    index.compact()
    assert index.postings().count() == 400 * 5 and index.words().count() == words
    assert index.store.children("words") == index.store.children("postings")
    assert index.search("windED unk").count() == 0 and index.search("windED ordin").count() == 400 == index.search("unk some").count()


def test_more_words_than_are_named(spark, tmp_path, monkeypatch):
    index, df = si.SearchIndex(spark, f"{tmp_path}/index"), spark.createDataFrame(BOOKS, si.BOOKS)
    index.update(df)
    monkeypatch.setattr(si, "NAMED_WORDS", 0)
    monkeypatch.setattr(si, "BROADCAST_IDS", 0)
    for q in [*QUERIES, "e", "red e d", "d red dd", "zzz red", "red widx", "1"]:
        assert found(index.search(q)) == found(search(df, q)), q
