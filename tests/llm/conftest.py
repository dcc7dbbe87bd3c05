"""Small folders of tables: edge rows, empty tables, and columns whose names clash with internal ones."""

import pytest

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud"
CLASH = ["score", "home", "kind", "bucket", "words", "k", "n", "start", "spans", "base", "row", "rule", "host", "seg", "wid", "pos", "term", "v", "list", "component", "a", "b", "payload", "bins", "t", "w"]

TEXTS = [
    (1, LONG), (2, LONG), (2, LONG), (3, LONG.upper()), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "One"),
    (9, "Mail a.b@c.de or +1 (743) 555-3824, from 10.0.0.255, card 4111 1111 1111 1111.\nReleased under the MIT License."),
    (10, LONG + " changed tail here"), (None, LONG), (None, None), (11, "x" * 200_000), (12, "é " * 30_000), (13, "\x01 \x00   中文 <|endoftext|>"),
    (14, LONG + "\n" + LONG), (2, "another text of the same id"), (15, "BUY!! NOW!! CHEAP!! " * 40), (16, "BUY!! NOW!! MORE!! " * 40),
]


def _clash(df, F):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="session")
def folders(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}" if i != 5 else None, len(t or "")) for i, t in TEXTS]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(1, 1, 0), (1, 1, 0), (2, 1, None), (3, 1, 0), (9, None, 1), (10, 1, 0), (14, 1, 0), (15, 0, 0), (16, 0, 1), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, LONG), (2, "one"), (3, None), (4, ""), (5, "sed do eiusmod"), (6, "sed do eiusmod"), (None, "tempor incididunt")], "item_id long, text string"),
        "pages": ([(1, "http://A.example.net/en/1?x"), (2, None), (3, "no scheme"), (4, "https://x.net"), (5, "ftp://example.com/de/"), (6, "http://a.b.org/fr/x/y/z/1/2/3/4#f"), (6, "http://a.b.org/fr/x"), (None, "://"), (7, "http://net/en\n/a")], "page_id long, url string"),
        "embeddings": ([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (6, [2.0, 0.0]), (7, [1.0, 2.0, 3.0]), (100, [0.0, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [-1.0, 0.0]), (10, [0.5, 0.5]), (11, [3.0, 1.0])], "vec_id long, embedding array<float>"),
    }
    out = {}
    for name in ("edges", "empty"):
        out[name] = f"{root}/{name}"
        for t, (rows, schema) in tables.items():
            _clash(spark.createDataFrame(rows if name == "edges" else [], schema), F).coalesce(2).write.parquet(f"{out[name]}/{t}.parquet")
    return out


@pytest.fixture(scope="session")
def texts():
    return TEXTS
