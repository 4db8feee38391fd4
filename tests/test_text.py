from pyspark.sql import functions as F

from caseloom.functions import text as ft
from caseloom.functions.geo import geo_point


def model_title(title):
    out, run = [], ""
    for ch in title + "\0":
        if ch in "0123456789":
            run += ch
            continue
        if run:
            number = int(run)
            out.append(str(number if number < 2**64 else 0))
            run = ""
        out.append(ch)
    return "".join(out)[:-1].lower()


def test_titles_lose_leading_zeros_and_overflow_to_zero(values):
    titles = [
        "Cable 001",
        "000",
        "É 0x00F 10",
        "18446744073709551615",
        "18446744073709551616",
        "00018446744073709551615 0000",
        "99999999999999999999 and 100000000000000000000 1",
        "20000000000000000000",
        "",
    ]
    assert values(titles, ft.normalise_title) == [model_title(t) for t in titles]


def test_trim_removes_all_unicode_white_space(values):
    assert values(["  a b \n", "　", "x"], ft.trim_ws) == ["a b", "", "x"]
    assert values([" ", " x ", None], ft.blank_to_null) == [None, "x", None]
    assert values([" ", " x ", None], ft.is_blank) == [True, False, True]


def test_trim_takes_one_pass_over_inner_white_space(values):
    inner = "x" + " " * 1_000_000 + "y"
    assert values([f" {inner}\u3000", "\n" * 1_000_000, ""], ft.trim_ws) == [inner, "", ""]


def test_like_folds_ascii_only_and_keeps_wildcards(values):
    assert values(["ABC", "Éa", "éa", "a\\b"], lambda c: ft.contains_pattern(c, "b")) == [True, False, False, True]
    assert values(["Éa", "éa"], lambda c: ft.contains_pattern(c, "É")) == [True, False]
    assert values(["a-c", "ac"], lambda c: ft.contains_pattern(c, "A_C")) == [True, False]
    assert values(["a\\b", "ab"], lambda c: ft.contains_pattern(c, "\\")) == [True, False]


def test_like_takes_one_pass(values):
    # taking every place of every run, this would not end
    texts = ["ab" * 50_000, "ab" * 50_000 + "C", "a\nb\na😀ac", None]
    assert values(texts, lambda c: ft.contains_pattern(c, "A%b%a_a%c")) == [False, True, True, None]
    assert values(["a%.", "a.", "", None], lambda c: ft.contains_pattern(c, "%")) == [True, True, True, None]
    assert values(["xa.b", "xacb", "\\Ea.b"], lambda c: ft.contains_pattern(c, "\\e%.")) == [False, False, True]


def test_urls(values):
    cases = {
        "HTTPS://Ex.ORG:443/a b/../c d.pdf?q=a b#F": "https://ex.org/c%20d.pdf?q=a%20b#F",
        "http://ex.org": "http://ex.org/",
        "https://u@Ex.org:08080/é/./x/..": "https://u@ex.org:8080/%C3%A9/",
        "http://ex.org\\a": "http://ex.org/a",
        "http://ex.org?x": "http://ex.org/?x",
        "not a url": "not%20a%20url",
        "https://ex ample.com/a b": "https://ex%20ample.com/a%20b",
        "mailto:a@b": "mailto:a@b",
    }
    assert values(list(cases), ft.normalise_url) == list(cases.values())
    # a canonical URL stays what it is
    good = [u for u in cases.values() if u.startswith("http") and "ample" not in u]
    assert values(good, ft.normalise_url) == good


def test_file_names(values):
    urls = ["https://www.ex.org/files/example%20file.pdf", "https://ex.org/a+b.TXT", "plain/x.tar.GZ", "https://ex.org/x y"]
    assert values(urls, ft.filename_of_url) == ["example file.pdf", "a+b.TXT", "x.tar.GZ", "x y"]
    assert values(["a/b.PDF", "a.b/c", ".hidden", "x."], ft.extension_of) == ["pdf", None, None, None]


def test_sizes_and_percent(values):
    sizes = ["0", None, "1", "1023", "1024", "1280", "10239", "10240", "1572864", "9007199254740992"]
    expected = ["0 B", "0 B", "1 B", "1023 B", "1.0 KB", "1.3 KB", "10.0 KB", "10 KB", "1.5 MB", "8192 TB"]
    assert values(sizes, lambda c: ft.format_bytes(c.cast("long"))) == expected
    assert values(["0.1234", "1.5", "0"], lambda c: ft.match_percent(c.cast("double"))) == [87.7, 0.0, 100.0]


def test_media_kind(values):
    assert values(["PNG", "mov", "Pdf", "txt", None], ft.media_kind) == ["image", "video", "pdf", "other", "other"]


def test_place_rules_keep_their_order(values):
    places = ["New Mexico", "Jerusalem", "Georgia", "Georgian", "Tbilisi, GEORGIA!", "Papua New Guinea", "nowhere", None]
    lat = values(places, lambda c: geo_point(c)["lat"])
    assert lat == [23.6345, 37.0902, 32.1656, None, 32.1656, -6.315, None, None]


def test_let_binds_once(values):
    assert values(["ab"], lambda c: ft.let(F.upper(c), lambda u: F.concat(u, u))) == ["ABAB"]
