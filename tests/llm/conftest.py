import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n string, task string",
    "labels": "doc_id long, quality int, toxic int, text string",
    "pages": "page_id long, url string, html string, host string, verdict string, text string",
    "benchmark": "item_id long, text string, doc_id long",
    "conversations": "conv_id long, turn long, role string, text string, row long, p long",
}


def padded(rows, schema):
    """Rows filled up with values for the extra columns, whose names clash with those that operators use."""
    width = schema.count(",") + 1
    extra = {"double": 0.5, "string": "x", "long": 7, "int": 1}
    kinds = [c.split()[1] for c in schema.split(", ")]
    return [tuple(r) + tuple(extra[k] for k in kinds[len(r) : width]) for r in rows]


@pytest.fixture(scope="session")
def make_tables(spark, tmp_path_factory):
    """Writes tables, given as rows by name (empty if absent), with extra columns; returns their folder."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(padded(tables.get(name, []), schema), schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make


LONG = "the long text of a document " * 4000

EDGES = {
    "documents": [
        (1, None, "en", None, None), (2, "", None, "s", 0), (3, "   \n\t ", "en", "s", 6), (4, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)), (6, LONG + "x", None, "s", 1),
        (7, "Ähnlich 中文 😀 <|endoftext|> \x1c e\u0301", "de", "s", 3), (7, "Ähnlich 中文 😀 <|endoftext|> \x1c e\u0301", "de", "s", 3), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5),
        (8, "one", "en", "s", 3), (9, "ONE", "en", "s", 3), (10, "123 !!", "en", "s", 6), (11, "Der Text ist und bleibt deutsch", "de", "s", 3), (12, "the text is and stays english", "en", "s", 3),
    ],
    "labels": [(4, 1, 0), (5, 1, 0), (10, 0, 0), (3, 0, 0), (8, None, 0), (None, 1, 1), (10, 1, 0), (99, 1, 0)],
    "pages": [
        (1, None, None), (2, "no scheme", ""), (3, "HTTP://WWW.Example.COM/en/7x?q#f", "<p>unclosed <b>text"), (3, "HTTP://WWW.Example.COM/en/7x?q#f", "<p>unclosed <b>text"), (None, "http://", "<!-- only"),
        (4, "x://a://b/c", "<article><h1>Of A&amp;B</h1><p>A&amp;B&nbsp;c are some words of a paragraph to read.</p></article>"), (5, "http://spam-farm.example.org", LONG), (6, "http://a.net/de/9", "</div></p><li>x"), (7, "http://m.cheap-pills.example.net:80/x", "<script>never ends"),
    ],
    "benchmark": [(1, "the long text of a document the long text of a document the long text"), (2, ""), (3, None), (None, "Der Text ist und bleibt deutsch"), (1, "the long text of a document the long text of a document the long text")],
    "conversations": [
        (1, 0, "user", "Hi"), (1, 1, "assistant", "User: who?\n\nAssistant: me"), (1, 1, "assistant", "User: who?\n\nAssistant: me"), (None, None, None, None), (None, 3, "user", ""), (2, None, "system", LONG), (2, 1, None, "x"),
    ],
}


@pytest.fixture(scope="session")
def edges(make_tables):
    return make_tables(**EDGES)


@pytest.fixture(scope="session")
def nothing(make_tables):
    return make_tables()
