"""Column functions on literal values, expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lorebed.functions import keys, language, licence, tags, text, times, vectors, web


@pytest.fixture(scope="module")
def value(spark):
    def run(make, *inputs, kinds=None):
        names = "abcdef"[: len(inputs)]
        kinds = kinds or ["string"] * len(inputs)
        df = spark.createDataFrame([tuple(inputs)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
        return df.select(make(*[F.col(n) for n in names]).alias("x")).first().x

    return run


@pytest.mark.parametrize(
    "tag,want",
    [
        ("Batteries", "battery"), ("series", "serie"), ("boxes", "box"), ("pipes", "pipe"), ("houses", "house"), ("glass", "glass"),
        ("bus", "bus"), ("plates", "plate"), ("heating", "heater"), ("photovoltaics", "pv"), (" Cats ", "cat"), ("is", "is"), ("photos", "photo"),
    ],
)
def test_tags(value, tag, want):
    assert value(tags.normalise, tag) == want


def test_tag_lists(value):
    made = value(lambda a: tags.normalise_all(F.split(a, ",")), "pumps,Pump,,pumping,solar")
    assert made == ["pump", "solar"]


@pytest.mark.parametrize(
    "url,title,want",
    [
        ("https://h/en/x", "", "en"), ("https://h/spanish", "", "es"), ("https://h/a_fr/b", "", "fr"), ("https://h/pt-br/x", "", "pt"),
        ("https://h/xx-yy/x", "", None), ("https://h/x", "Cooker (Haitian Creole)", "ht"), ("https://h/x", "Cooker - Thai", "th"),
        ("https://h/x", "Report (UK)", "uk"), ("https://h/end", "", None), (None, None, None),
    ],
)
def test_language(value, url, title, want):
    assert value(language.detect, url, title) == want


def test_language_filter(value):
    assert value(lambda u, t: language.keep(u, t, "EN"), "https://h/en/x", "")
    assert not value(lambda u, t: language.keep(u, t, "fr"), "https://h/en/x", "")
    assert value(lambda u, t: language.keep(u, t, "fr"), "https://h/x", "")
    assert value(lambda u, t: language.keep(u, t, None), "https://h/en/x", "")


@pytest.mark.parametrize(
    "name,notes,want",
    [
        ("CC-BY-SA", "", True), ("cc by-sa 4.0", "", True), ("CC BY SA 3.0", "", True), ("MIT", "", True), ("Apache-2.0", "", True),
        ("Custom", "too short", False), ("Custom", "written permission by owner", True), ("Proprietary", "", False), ("", "", False), (None, None, False),
    ],
)
def test_allowed_licences(value, name, notes, want):
    assert value(licence.allowed, name, notes) is want


@pytest.mark.parametrize(
    "words,want",
    [
        ("Licensed under CC BY 4.0", "CC-BY"), ("CC-BY-SA", "CC-BY-SA"), ("cc by-nc 4.0", "CC-BY-NC"), ("cc-by-nc-sa", "CC-BY-NC-SA"),
        ("released under the MIT License", "MIT"), ("GPL-3", "GPL"), ("public domain", "Public Domain"), ("nothing", None),
        ("Attribution NonCommercial ShareAlike", "CC-BY-SA"),
    ],
)
def test_licence_family(value, words, want):
    assert value(licence.family, words) == want


@pytest.mark.parametrize(
    "words,want", [("CC0", "public_domain"), ("CC BY", "open_access"), ("All rights reserved", "restricted"), ("?", "unknown"), (None, "unknown")]
)
def test_licence_category(value, words, want):
    assert value(licence.category, words) == want


@pytest.mark.parametrize("code,want", [("00:01:02,500", 62.5), ("1:02", 62.0), ("7.25", 7.25), ("bad", 0.0), ("1:2:3:4", 0.0), (None, 0.0), ("", 0.0)])
def test_time_codes(value, code, want):
    assert value(times.code_seconds, code) == want


@pytest.mark.parametrize("d,want", [("PT1H2M3S", 3723), ("PT45S", 45), ("PT2M", 120), ("P1D", 0), ("", 0)])
def test_durations(value, d, want):
    assert value(times.duration_seconds, d) == want


@pytest.mark.parametrize("d,want", [("D:20240131120000Z", "2024-01-31T12:00:00"), ("20240131", "2024-01-31"), ("2024", "2024"), ("x", None)])
def test_pdf_dates(value, d, want):
    assert value(times.pdf_date, d) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://www.youtube.com/watch?v=abcdefghijk&t=1", "abcdefghijk"), ("https://youtu.be/abcdefghijk", "abcdefghijk"),
        ("https://m.youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("https://youtube.com/watch?v=short", None), ("https://x.org/watch?v=abcdefghijk", None),
    ],
)
def test_youtube(value, url, want):
    assert value(web.youtube_id, url) == want


@pytest.mark.parametrize(
    "name,url,title",
    [
        ("About_me.htm.html", "/About_me.htm", "About me"), ("www.a.gov_alerts_fire.html", "https://www.a.gov/alerts/fire", "www.a.gov alerts fire"),
        ("index.html", "/index", "index"), (".hidden_x.html", "/.hidden_x", ".hidden x"),
    ],
)
def test_filenames(value, name, url, title):
    assert value(web.filename_to_url, name) == url
    assert value(web.filename_to_title, name) == title


def test_links(value):
    html = '<a href="/a#x">1</a><a class="c" href="b?q=1">2</a><a href="#t">3</a><a href="https://o/">4</a><a href="/File:x">5</a><a href="/a">6</a><a href="mailto:x">7</a>'
    assert value(web.internal_links, html) == ["/a", "/b"]


@pytest.mark.parametrize(
    "html,url,want",
    [
        ("<title> A <b>b</b></title>", "u", "A b"), ("<title></title><h1>H</h1>", "u", "H"), ("<p>", "https://h/tail", "tail"), ("<p>", "https://h/", "Untitled"),
    ],
)
def test_titles(value, html, url, want):
    assert value(web.html_title, html, url) == want


@pytest.mark.parametrize(
    "title,url,content,want",
    [
        ("a.mp4", "", "x", True), ("", "http://h/x.PPTX", "x", True), ("mp4", "", "x", False), ("", "", "���", True), ("", "", "��", False),
        ("", "", "\x01" * 8, True), ("", "", "\n\t\r" * 9, False), ("", "", "y" * 400 + "���", False), (None, None, None, False),
    ],
)
def test_binaryish(value, title, url, content, want):
    assert value(web.is_binaryish, title, url, content) is want


def test_text(value):
    assert value(lambda a: text.snippet(a, 3), "abc") == "abc"
    assert value(lambda a: text.snippet(a, 3), "abcd") == "abc..."
    assert value(lambda a: text.snippet_always(a, 3), "") == "" and value(lambda a: text.snippet_always(a, 3), "ab") == "ab..."
    assert len(value(lambda a: text.short_title(a), "x" * 81)) == 80
    assert value(lambda a: text.occurrences(a, "aa"), "aaaaa") == 2 and value(lambda a: text.occurrences(a, ""), "a") == 0
    assert value(text.clean_wiki, "A[edit]  b[12]\n\n\n\nc ") == "A b\n\nc"
    assert value(lambda a, b: text.display_name(a, source_id=b), "", "my_source-id") == "My Source Id"


def test_folders(value):
    assert value(web.in_asset_folder, "site/CSS/x.html") and not value(web.in_asset_folder, "site/pages/css")
    assert value(web.is_system_folder, "Chroma_DB_384_es") and not value(web.is_system_folder, "wiki")


def test_keys(value):
    assert value(keys.chunk_id, "d", 2, 3, kinds=["string", "int", "int"]) == "d_chunk2"
    assert value(keys.chunk_id, "d", 0, 1, kinds=["string", "int", "int"]) == "d"
    assert value(keys.fallback_id, "", "h", "u") == "h"
    assert value(keys.fallback_id, None, None, None) == "d41d8cd98f00b204e9800998ecf8427e"


def test_vectors(value):
    two = ["array<float>", "array<float>"]
    assert value(vectors.squared_l2, [0.0, 3.0], [4.0, 0.0], kinds=two) == 25.0
    assert value(vectors.cosine, [1.0, 0.0], [1.0, 1.0], kinds=two) == pytest.approx(2**-0.5)
    assert value(vectors.halfway, [0.0, 2.0], [2.0, 4.0], kinds=two) == [1.0, 3.0]
    one = ["array<float>"]
    assert value(vectors.is_corrupt, [1.0, float("nan")], kinds=one) and value(vectors.is_corrupt, None, kinds=one) and value(vectors.is_corrupt, [], kinds=one)
    assert not value(vectors.is_corrupt, [0.0], kinds=one) and value(vectors.is_null_or_zero, [0.0], kinds=one)
