"""What each operator once did by halves."""

import collections

import pytest


@pytest.fixture(scope="module")
def urls():
    out = [f"http://{h}.example.net/{d}/{i}" for h in "abc" for d in ("en", "es", "casino") for i in range(12)]
    out += [f"http://x.example.org/{d}/{i}" for d, n in (("fr", 30), ("es", 15), ("en", 15), ("casino", 3), ("about", 1)) for i in range(n)]
    return out + [f"http://y.example.com/{d}/{i}" for d, n in (("de", 2), ("en", 40), ("fr", 9)) for i in range(n)]


def url_verdicts(spark, urls, times):
    from quern.llm.url_filter import judge

    got = judge(spark.createDataFrame(list(enumerate(urls * times)), "page_id long, url string")).collect()
    out = collections.defaultdict(set)
    for r in got:
        out[urls[r.page_id % len(urls)]].add((r.verdict, r.template))
    assert len(got) == len(urls) * times and all(len(v) == 1 for v in out.values())
    return {u: next(iter(v)) for u, v in out.items()}


def test_url_verdicts_do_not_depend_on_repetition(spark, urls):
    once = url_verdicts(spark, urls, 1)
    assert all(url_verdicts(spark, urls, k) == once for k in (3, 40))


def test_url_evidence_reaches_unlabelled_hosts(spark, urls):
    got = {u: v for u, (v, _) in url_verdicts(spark, urls, 2).items()}
    blocked = {u.rsplit("/", 1)[0] for u, v in got.items() if v == "block" and "example.net" not in u}
    assert blocked == {"http://x.example.org/es", "http://x.example.org/casino", "http://y.example.com/de"}
    assert all(v == "allow" for u, v in got.items() if "example.org/en" in u or "example.com/en" in u)


def test_url_levels_are_kept(spark):
    deep = "http://h.example.com/" + "/".join("abcdefgh")
    got = url_verdicts(spark, [f"{deep}/{x}/{i}" for x in ("spam", "ham") for i in range(3)], 1)
    assert {t for _, t in got.values()} == {"/a/b/c/d/e/f/g/h/spam/*", "/a/b/c/d/e/f/g/h/ham/*"}


def test_url_branches_merge_with_what_they_resemble(spark):
    """Wholly blocked branches are one template though a third one is wholly allowed."""
    from quern.llm.url_filter import judge

    rules = (("block", "h.x", "/a/"), ("block", "h.x", "/b/"), ("allow", "h.x", "/c/"))
    urls = [f"http://h.x/{d}/{i}" for d in "abc" for i in range(60)] + ["http://h.x/a/1"] * 500
    got = {(r.path[1], r.template) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert got == {("a", "/{a|b}/*"), ("b", "/{a|b}/*"), ("c", "/c/*")}


def filler(n):
    import random

    r = random.Random(5)
    return [" ".join(r.choice(["alpha", "bravo", "delta", "gamma", "sigma", "omega", "theta", "kappa"]) for _ in range(25)) + f" {i}" for i in range(n)]


def pii_terms(spark, texts):
    from quern.llm.pii import find

    rows = find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"} for r in rows}


def test_pii_copies_count_once(spark):
    plain = filler(1003)
    telling = [f"{t} zyxwolf is at jane.roe@corp.example {t}" for t in plain[:3]]
    got = pii_terms(spark, plain[3:] + telling + telling[:1] * 1000)
    assert all(got[i] == {"zyxwolf"} for i in range(1000, 2003)) and not any(got[i] for i in range(1000))


def test_pii_name_beside_an_address_given_once(spark):
    plain = filler(400)
    text = f"{plain[0]} Zyxwolf Quarn wrote, see zyxwolf.quarn@corp.example {plain[1]} so said ZYXWOLF at last"
    got = pii_terms(spark, [*plain[2:], text])
    assert got.pop(398) == {"Zyxwolf", "Quarn", "ZYXWOLF"} and not any(got.values())


def test_pii_terms_of_a_class_anywhere_in_the_text(spark):
    plain = filler(900)
    far = [f"zyxwolf {plain[i]} {plain[i + 1]} {plain[i + 2]} u{i}x@corp.example {plain[i + 3]} zyxwolf" for i in range(0, 48, 4)]
    got = pii_terms(spark, [*plain[48:], *far])
    assert all(got[852 + i] == {"zyxwolf"} for i in range(12)) and not any(got[i] for i in range(852))


@pytest.mark.parametrize("width", [20, 40, 72])
def test_wrapped_notices(spark, width):
    import textwrap

    from quern.llm.licenses import TEMPLATES, scan

    texts = ["some prose before it\n" + "\n".join(textwrap.wrap(t, width)) + "\nand prose after" for _, t in TEMPLATES]
    words = [w for _, t in TEMPLATES for w in t.split()]
    texts.append("\n".join(" ".join([w, *(f"x{i}y{j}" for j in range(25))]) for i, w in enumerate(words)))  # the words, far apart
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(label in got[i].labels and got[i].score == 1.0 for i, (label, _) in enumerate(TEMPLATES))
    assert got[len(TEMPLATES)].matches == []


def test_license_labels_are_told_apart(spark):
    """One label each where a word decides; two notices in one text both stay."""
    from quern.llm.licenses import scan

    texts = {
        "Licensed under CC BY 4.0": ["cc-by"],
        "Licensed under CC BY-NC 4.0": ["cc-by-nc"],
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa"],
        "Licensed under CC BY 4.0. " + "prose " * 20 + "Licensed under CC BY-SA 4.0.": ["cc-by", "cc-by-sa"],
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": ["agpl"],
        "This library is free software; you can redistribute it\nand/or modify it under the terms of the GNU Lesser General Public\nLicense": ["lgpl"],
        "Licensed under the Apache License, Version 2.0, or released under the MIT license": ["apache", "mit"],
        "nothing of that kind, under the terms we know": [],
    }
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    affero = {"agpl": {"agpl", "gpl"}, "lgpl": {"lgpl", "gpl"}}  # the base phrase names gpl too
    for r, (text, want) in zip(sorted(got, key=lambda r: r.doc_id), texts.items(), strict=True):
        assert set(r.labels) == set(want).union(*(affero.get(x, set()) for x in want)), text


def test_near_copies_of_two_sources_share_no_bin(spark, tmp_path):
    from quern.llm.queries import QUERIES

    plain = filler(40)
    docs = [(2 * i + j, " ".join([plain[i], plain[i + 20], "changed" if j else "tail"]), f"s{2 * i + j}") for i in range(20) for j in (0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = {r.doc_id: r.bin_id for r in QUERIES["op9_packing"](spark, str(tmp_path)).collect()}
    assert len(bins) == 40 and all(bins[2 * i] != bins[2 * i + 1] for i in range(20))


def test_repeated_smallest_doc_id_keeps_one_row(spark):
    from quern.llm.ngram_join import one_of_each

    a, b = filler(2)
    rows = [(1, a), (1, a), (1, a + " z"), (2, a), (3, b), (4, ""), (4, None), (None, a), (None, a)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (3, b), (4, ""), (4, None), (None, a), (None, a)]))


def test_pii_in_a_long_text(spark):
    """32,000 addresses in one text, each a base span; characters beyond the first plane between them."""
    from quern.llm.pii import find, sanitised

    words = [f"u{i}@ex.com" for i in range(32_000)]
    text = "\U0001f600 é ".join(words)
    df = spark.createDataFrame([(1, text, "x"), (2, "none", "y")], "doc_id long, text string, other string")
    got = {r.doc_id: r.spans for r in find(df).collect()}
    assert [text[s.start : s.end] for s in got[1] if s.kind == "email"] == words and got[2] == []
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert clean == {1: "\U0001f600 é ".join(["[EMAIL]"] * 32_000), 2: "none"}


def test_repeated_rows_have_bins_of_their_own(spark):
    from quern.llm.packing import with_bins

    df = spark.createDataFrame([(1, "a b c " * 1000, None)] * 50, "doc_id long, text string, source string")
    got = with_bins(df).collect()
    assert len(got) == 50 and all([b.n_words for b in r.bins] == [2048, 952] for r in got)
    assert len({b.bin_id for r in got for b in r.bins}) == 100  # copies of one text share no bin


def test_homes_are_the_same_everywhere(spark):
    import numpy as np

    from quern.llm.packed import digest_of, home_of, homes_of, one_home

    rows = [(i * 1024 - 7, f"é text {i}") for i in range(300)] + [(-5, ""), (2**62, "x" * 100)]
    df = spark.createDataFrame([*rows, (None, "a"), (None, "b"), (3, None)], "doc_id long, text string")
    got = [r.h for r in df.select(home_of(df.doc_id, df.text, 97).alias("h")).collect()]
    digests = [digest_of(t.encode()) for _, t in rows]
    assert got[: len(rows)] == [one_home(i, d, 97) for (i, _), d in zip(rows, digests, strict=True)]
    assert got[: len(rows)] == homes_of(np.array([i for i, _ in rows]), np.array(digests), 97).tolist()
    assert got[-1] == one_home(3, digest_of(b""), 97) and len(set(got)) > 85  # multiples of 1,024 spread too
