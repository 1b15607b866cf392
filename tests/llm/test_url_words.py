"""Words of the segmentation model come from all pages, whatever their number and length."""

from sessionlake.llm import urls


def test_rare_and_long_words_among_many_are_kept(spark):
    letters = "abcdefghij"
    many = " ".join("".join(letters[int(c)] for c in f"{k:05d}") for k in range(60_000))
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    rows = [(1, "http://rarename.org/rare/name", f"<p>{many} {many}"), (2, f"http://the{long}xy.net/fr/a", f"<p>rare name fr a the {long}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counted = urls.word_counts(pages)
    names = spark.createDataFrame([("rarename",), (f"the{long}xy",), ("fr",), ("2024",), ("afr",)], "name string")
    got = {r.name: r.words for r in urls.splits(names, counted).collect()}
    assert got == {"rarename": ["rare", "name"], f"the{long}xy": ["the", long, "x", "y"], "fr": ["fr"], "2024": list("2024"), "afr": ["a", "fr"]}
    assert {r.word: r.n for r in counted.filter("word in ('rare', 'a')").collect()} == {"rare": 1, "a": 1}
