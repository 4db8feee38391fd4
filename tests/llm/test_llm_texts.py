"""Language, personal data, URLs, quality, chat: edge cases and plain models."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseloom.llm import chat, langid, personal, quality, urls, weak
from check import rows_of
from conftest import SF

LONG = "The quick brown fox. " * 20_000
DOCS = "doc_id long, text string, lang string, source string, score string, host string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- URLs -------------------------------------------------------------------------


def test_url_query_equals_its_sql(spark):
    df = entry.queries()["op10_url_vocabulary"](spark, SF)
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    expected = duck.sql(entry.oracle_sql()["op10_url_vocabulary"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(expected.columns, expected.fetchall())


def test_urls_by_hand(spark):
    cases = {
        "http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.net/fr/x": ("a.example.net", "/fr/x", "net/", "block"),
        "http://a.example.net": ("a.example.net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://x.org/fr/a?q=/#t": ("x.org", "/fr/a", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://x.com/porn/1": ("x.com", "/porn/1", None, "block"),
        "http://x.com/pornography": ("x.com", "/pornography", None, "allow"),
        "http://x.com/free": ("x.com", "/free", None, "allow"),
        "http://x.com/free/free": ("x.com", "/free/free", None, "allow"),
        "http://x.com/free-bet": ("x.com", "/free-bet", None, "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://x.com/" + "a/" * 50_000 + "casino": ("x.com", "/" + "a/" * 50_000 + "casino", None, "block"),
    }
    rows = [(i, u, "old", "old") for i, u in enumerate(cases)] * 2
    got = urls.judge_urls(frame(spark, rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    expected = list(cases.values())
    assert all((r.host, r.path, r.rule, r.verdict) == expected[r.page_id] for r in got)
    assert urls.judge_urls(frame(spark, [], "page_id long, url string")).count() == 0


# ---- language ---------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in entry.queries()["op3_compression_language"](spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    train = [("the cat sat on the mat and the dog " * 5, "en"), ("le chat est sur la table et le chien " * 5, "fr"), (None, "en"), ("x", None)]
    model = langid.fit_languages(frame(spark, train, "text string, lang string"))
    assert list(model.dictionaries) == ["en", "fr"]
    rows = [(1, None, "a", "s", "z", "h"), (2, "", None, None, None, None), (3, "123 !!", "x", "s", "z", "h"), (4, "the cat sat on the mat and the dog", "fr", "s", "z", "h"), (4, "the cat sat on the mat and the dog", "fr", "s", "z", "h"), (None, LONG, None, "s", "z", "h"), (6, "LE CHAT EST SUR LA TABLE", "en", "s", "z", "h")]
    got = langid.identify(frame(spark, rows, DOCS), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "en", "fr"]
    assert [r.accepted for r in got][:4] == [False, False, False, True]
    assert got[0].score == 0 and got[3].lang == "fr"  # labels are never read
    kept = langid.keep_known(frame(spark, rows, DOCS), model)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and kept.count() == 4
    empty = langid.fit_languages(frame(spark, [], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(frame(spark, rows, DOCS), empty).collect()} == {"und"}
    assert langid.identify(frame(spark, [], DOCS), model).count() == 0
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 8 for i in range(200)]
    many = [(w, f"l{i}") for i, w in enumerate(words)] * 3
    model = langid.fit_languages(frame(spark, many, "text string, lang string"), texts=2)
    assert len(model.dictionaries) == 200  # any number of labels, one text at least of each
    got = langid.identify(frame(spark, [(i, w) for i, w in enumerate(words[:60])], "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id}" for r in got)


# ---- personal data ----------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None,
    "",
    "nothing here",
    "é mail a.b+c@x-y.example.com, b@c.d_e@f.g x@y a@b.c.",
    "ip 1.2.3.4.5 256.1.1.1 0001.2.3.255 1.2.3 9.9.9.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 12345678901234567890123",
    "call +1 (415) 555-2671 or +49 30 901820 or +1 2 or ++12345678901",
    "😀 4111111111111111 😀 x@y.z",
    "7" * 100_000,
    "1 " * 50_000,
    "a@b.c " * 3_000,
    "1.2.3.4 " * 3_000,
    "a@" + "b." * 20_000 + "c",
    "+" + "1 " * 20_000,
]


def test_base_spans_equal_plain_matching(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, TEXTS[5], None, None)]
    got = personal.find_personal_data(frame(spark, rows, "doc_id long, text string, spans string, kind string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[5] if r.doc_id is None else TEXTS[r.doc_id]
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.is_base]
        assert base == plain_spans(text), r.doc_id
    assert personal.find_personal_data(frame(spark, [], "doc_id long, text string")).count() == 0


def test_numbers_that_fail_their_checksum_are_not_added(spark):
    """Half of the long numbers pass; the others look alike in every other way, and none of them becomes a span."""
    good, bad = "4539578763621486", "4539578763621487"
    rows = [(i, f"pay {good if i % 2 else bad} now, it was {1900 + i} and {i} of us") for i in range(60)]
    got = {r.doc_id: r.spans for r in personal.find_personal_data(frame(spark, rows, "doc_id long, text string")).collect()}
    assert [[(s.kind, s.start, s.end) for s in got[i]] for i in range(2)] == [[], [("card", 4, 20)]]
    assert all(len(got[i]) == i % 2 for i in range(60))


def test_personal_query_equals_plain_matching(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = entry.queries()["op5_personal_spans"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = df.collect()
    assert len(got) == len(docs)
    for r in got:
        spans = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_classifier_adds_what_labelers_agree_on(spark):
    rows = [(i, f"please call 415-555-{1000 + i} today, version 2.{i} of page {i}") for i in range(60)]
    rows += [(100 + i, f"write to me{i}@site.org or +1 (415) 555-{1000 + i}, in {1900 + i}") for i in range(60)]
    got = {r.doc_id: r.spans for r in personal.find_personal_data(frame(spark, rows, "doc_id long, text string")).collect()}
    added = [s for spans in got.values() for s in spans if not s.is_base]
    assert added and all(s.kind == "phone" for s in added)
    assert all(rows[i][1][s.start : s.end] == f"415-555-{1000 + i}" for i in range(60) for s in got[i])


def test_mask(spark):
    text = "é write a@b.cd or +1 (415) 555-2671."
    found = personal.find_personal_data(frame(spark, [(1, text)], "doc_id long, text string"))
    masked = found.withColumn("text", F.lit(text)).select(personal.mask(F.col("text"), F.col("spans"))).first()[0]
    assert masked == "é write <email> or <phone>."


# ---- quality ----------------------------------------------------------------------


def test_estimation_recovers_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < right, truth, ~truth) * 2 - 1 for right in (0.95, 0.8, 0.7, 0.6)], axis=1)
    votes[rng.random(votes.shape) < 0.3] = 0
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    after = weak.estimate({tuple(k): int(n) for k, n in zip(kinds.tolist(), counts, strict=True)})
    right = np.mean([(after[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)])
    lead = np.mean([(sum(v) > 0) == t for v, t in zip(votes.tolist(), truth, strict=True)])
    assert right > lead and right > 0.88


def test_quality_against_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = entry.queries()["op6_weak_quality"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    pairs = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "quality_pred").collect()
    good = [p.quality_pred for p in pairs if p.quality == 1]
    bad = [p.quality_pred for p in pairs if p.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "A fine sentence stands here.", "x"), (3, "A fine sentence stands here.", "x"), (None, LONG, None), (5, "###" * 50_000, None)]
    docs = frame(spark, rows, "doc_id long, text string, quality_score string")
    got = quality.score_quality(docs, quality.fit_quality(docs)).collect()
    assert len(got) == 6 and all(0 <= r.quality_score <= 1 for r in got) and got[2] == got[3]
    none = frame(spark, [], "doc_id long, text string")
    assert quality.score_quality(none, quality.fit_quality(none)).count() == 0
    assert {r.quality_score for r in quality.score_quality(docs, quality.fit_quality(none)).collect()} == {0.5}


def test_measures_by_hand():
    table, words, _ = quality.measures(pa.array(["Ab cd. Ab cd. É!", None, ""]))
    assert np.diff(words[1]).tolist() == [5, 0, 0]
    assert table[0, 0] == 0 and np.isclose(table[0, 1], 2 / 9) and np.isclose(table[0, 5], 3 / 5)
    assert not table[1:, :2].any()


# ---- chat -------------------------------------------------------------------------


def plain_cost(roles, costs):
    """Cheapest repair by trying everything, state by state."""
    best = {chat.START: 0.0}
    for role in roles:
        known = chat._known(role)
        new = {}
        for state, spent in best.items():
            for before, after, cost, _, _ in chat._choices(known, costs):
                if before == state and spent + cost < new.get(after, 1e17):
                    new[after] = spent + cost
        best = new
    return min(best.values())


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest))


def rebuilt(rows):
    out = []
    for r in sorted(rows, key=lambda r: r.turn):
        out += r.inserted
        if r.action != "merge":
            out.append(r.role)
            assert r.out_turn == len(out) - 1
    return out


def test_repairs_are_legal_and_cheapest(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)  # many segments, and segments of segments
    rng = np.random.default_rng(5)
    names = ["user", "assistant", "system", "User ", "bot", None, "narrator"]
    convs = {i: [names[k] for k in rng.integers(0, len(names), rng.integers(1, 60))] for i in range(40)}
    rows = [(i, t, r, f"text {t}" if t % 5 else None, "x") for i, roles in convs.items() for t, r in enumerate(roles)]
    got = chat.repair(frame(spark, rows, "conv_id long, turn long, role string, text string, action string")).collect()
    costs, by = chat.Costs(), {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    assert by.keys() == convs.keys() and len(got) == len(rows)
    for i, roles in convs.items():
        assert legal(rebuilt(by[i]))
        spent = 0.0
        for r in sorted(by[i], key=lambda r: r.turn):
            known = chat._known(roles[r.turn])
            change = 0.0 if r.role == known else costs.relabel if known else costs.unknown
            change += costs.system if r.action == "relabel" and r.role == "system" else 0.0
            spent += change + costs.insert * len(r.inserted) + (costs.merge if r.action == "merge" else 0)
        assert np.isclose(spent, plain_cost(roles, costs))
        whole = "".join(r.rendered for r in sorted(by[i], key=lambda r: r.turn))
        assert re.findall(r"<\|(\w+)\|>\n", whole) == [x for q in rebuilt(by[i]) for x in (q, "end")]


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", LONG), (2, 5, "assistant", "b")]
    got = sorted(chat.repair(frame(spark, rows, schema)).collect(), key=lambda r: (r.conv_id or 0, r.turn))
    assert [(r.conv_id, r.role, r.action) for r in got] == [
        (None, "user", "relabel"), (1, "system", "keep"), (1, "user", "keep"), (1, "user", "merge"), (2, "assistant", "keep"),
    ]
    assert got[4].inserted == ["user"] and got[4].rendered == "<|user|>\n<|end|>\n<|assistant|>\nb\n<|end|>\n"
    assert chat.repair(frame(spark, [], schema)).count() == 0


def test_chat_query_keeps_every_turn(spark):
    got = entry.queries()["op4_role_repair"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/conversations.parquet").count()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    assert all(legal(rebuilt(rows)) for rows in by.values())
