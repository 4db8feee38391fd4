"""Near copies, benchmark items, mixing, token files, fingerprints, pipeline: edge cases and plain models."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from caseloom.llm import bagminhash, bloomsketch, decontaminate, mixing, neardup, tokenfile, words
from caseloom.llm.common import Shelf
from conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
SCHEMA = "doc_id long, text string, source string, class_id string, _text string, size string"


def docs_of(spark, texts, source="s"):
    rows = [(i, t, source, "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def shingles(text):
    found = WORD.findall((text or "").lower())
    return [tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1 if found else 0))]


# ---- words and signatures ---------------------------------------------------------


def test_word_hashes_follow_words():
    texts = ["", None, "One two,three!", "one TWO three".lower(), "x" * 3_000_000, "é è é", " " * 2_000_000 + "one", "one\x00two"]
    hashes, rows = words.word_hashes(pa.array(texts))
    seen = {}
    for k, text in enumerate(texts):
        plain = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")
        own = hashes[rows[k] : rows[k + 1]]
        assert len(own) == len(plain)
        for w, h in zip(plain, own, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    runs, begins = words.shingle_hashes(hashes, rows)
    assert np.diff(begins).tolist() == [0, 0, 1, 1, 1, 1, 1, 1]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    keys = words.mix(np.arange(300, dtype=np.uint64))
    a = rng.integers(0, 40, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.integers(0, 40, 300))
    doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    regs = bagminhash.signatures(doc, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 8192)
    assert abs((regs[0] == regs[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


# ---- near copies ------------------------------------------------------------------


def plain_classes(texts):
    bags = {i: Counter(shingles(t)) for i, t in texts.items()}
    size, where, up = {i: sum(b.values()) for i, b in bags.items()}, {}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, bag in bags.items():
        for s in bag:
            where.setdefault(s, []).append(i)
    for i, bag in bags.items():
        shared = Counter()
        for s, n in bag.items():
            for j in where[s]:
                if j < i:
                    shared[j] += min(n, bags[j][s])
        for j, n in shared.items():
            if n >= 0.8 * (size[i] + size[j] - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in texts}


def varied(base, edits, rng):
    out = list(base)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"w{rng.integers(1 << 40)}"
    return " ".join(out)


def test_classes_equal_plain_model(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 8)  # many blocks in a bucket
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(300)]
    # around the threshold: five shingles are lost with every edit
    texts = {1000 - k: varied(base, int(rng.integers(4, 13)), rng) for k in range(90)}
    texts |= {2000 + k: varied([f"c{k // 3}x{j}" for j in range(80)], k % 3, rng) for k in range(60)}
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts.items())).collect()}
    expected = plain_classes(dict(sorted(texts.items())))
    assert {i: r.class_id for i, r in got.items()} == expected
    sizes = Counter(expected.values())
    assert all(r.class_size == sizes[expected[i]] and r.is_kept == (i == expected[i]) for i, r in got.items())


def test_near_query_equals_plain_model(spark):
    got = {r.doc_id: r.class_id for r in entry.queries()["op1_bagminhash_classes"](spark, SF).collect()}
    assert got == plain_classes(dict(sorted(documents(spark).items())))


def test_near_edges(spark):
    long = "alpha beta gamma delta epsilon " * 40_000
    texts = [(1, None), (2, None), (3, ""), (4, ""), (5, "!!"), (6, "one two"), (7, "One two"), (8, "one two"), (8, "one two"), (None, "one two"), (9, long), (10, long + "zeta"), (None, None)]
    docs = docs_of(spark, texts)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    by = Counter((r.doc_id, r.class_id, r.class_size, r.is_kept) for r in got)
    assert by[(6, 6, 5, True)] == 1 and by[(7, 6, 5, False)] == 1 and by[(8, 6, 5, False)] == 2 and by[(None, 6, 5, False)] == 1
    assert by[(9, 9, 2, True)] == 1 and by[(10, 9, 2, False)] == 1
    assert all(r.is_kept and r.class_size == 1 for r in got if r.doc_id in (1, 2, 3, 4, 5))
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
    twice = docs_of(spark, [(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g")])
    assert neardup.drop_near_duplicates(twice).count() == 1
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0 and neardup.drop_near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(400) if k != 200] + [(1000, k) for k in range(1001, 1300)] + [(7, 7)]
    got = neardup.components(spark.createDataFrame(links, "_a long, _b long"), Shelf()).collect()
    roots = {}
    for r in got:
        roots.setdefault(r._root, set()).add(r._node)
    assert sorted(map(len, roots.values())) == [200, 201, 300]


# ---- benchmark items --------------------------------------------------------------


def plain_hits(texts, items):
    kept = {i: set(shingles(t)) for i, t in items.items() if shingles(t)}
    out = {}
    for d, text in texts.items():
        own = set(shingles(text))
        for i, item in kept.items():
            share = len(item & own) / len(item)
            if share >= 0.8:
                out[d, i] = share
    return out


def test_items_equal_plain_model(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"v{k}" for k in range(4000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = {i: say(n) for i, n in enumerate([1, 3, 5, 6, 9, 13, 20, 21, 36, 37, 60, 150, 700])}
    items[50], items[51] = "same same same same same same same same", items[6] + " " + say(3)
    texts = {}
    for d in range(120):
        item = items[int(rng.choice(list(items)))].split()
        if d % 3 == 1:
            item = item[: int(len(item) * rng.uniform(0.75, 1))]
        if d % 3 == 2 and len(item) > 30:
            item[int(rng.integers(len(item)))] = "changed"
        texts[d] = f"{say(int(rng.integers(0, 3000)))} {' '.join(item)} {say(int(rng.integers(0, 300)))}"
    texts |= {500 + i: t.upper() for i, t in items.items()}
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontaminate.find_items(docs_of(spark, texts.items()), table).collect()
    expected = plain_hits(texts, items)
    assert {(r.doc_id, r.item_id): round(r.containment, 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}


def test_item_query_and_edges(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op9_contained_items"](spark, SF).collect()}
    assert got == set(plain_hits(documents(spark), items))
    rows = [(1, None), (2, ""), (3, "the item of six whole words"), (3, "the item of six whole words"), (None, "The item, of six whole words!")]
    docs = docs_of(spark, rows)
    table = spark.createDataFrame([(1, "the item of six whole words", "t"), (1, "the item of six whole words", "t"), (2, None, "t"), (3, "", "t"), (None, "the item of six", "t")], "item_id long, text string, doc_id string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.find_items(docs, table).collect()) == [(0, 1), (3, 1), (3, 1)]
    clean = decontaminate.drop_contaminated(docs, table)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2]
    none = table.filter("item_id > 9")
    assert decontaminate.find_items(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == 5
    assert decontaminate.find_items(docs_of(spark, []), table).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(5)]
    docs = docs_of(spark, [(i, f"before {t} after") for i, t in items] + [(9, "clean words only in this one")])
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, table).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, table).collect()] == [9]


# ---- mixing -----------------------------------------------------------------------


def plain_targets(sizes, share=1.5, cap=2.0):
    """sizes by source; weights 5, 2, 1 in code point order, NULL last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped and sizes[s]]
        left = total - sum(cap * sizes[s] for s in clamped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in clamped else level * weight[s] if sizes[s] else 0.0 for s in names}
        clamped |= over


def check_mix(rows, texts):
    """rows: (doc_id, source, size, target, taken)."""
    sizes, taken, targets = Counter(), Counter(), {}
    for doc, source, size, target, took in rows:
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[doc] or "")) and 0 <= took <= 2 * size
        sizes[source] += size
        taken[source] += took
        targets[source] = target
    expected = plain_targets(dict(sizes))
    assert all(np.isclose(targets[s], expected[s]) and abs(taken[s] - targets[s]) <= 1 for s in targets)


def test_mix_query_equals_plain_model(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {r.doc_id: r.source for r in rows}
    run = lambda: sorted(entry.queries()["op2_water_filling"](spark, SF).collect())
    got = run()
    assert got == run() and len(got) == len(rows)
    check_mix([(r.doc_id, source[r.doc_id], r.size, r.target, r.taken) for r in got], {r.doc_id: r.text for r in rows})


def test_mix_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    names = [None, "", "a", "é", "", "😀", "B"]
    texts = {k: " ".join(["w"] * (k * 7 % 40)) for k in range(200)} | {300: None, 301: "", 302: "w " * 60_000}
    source = {k: names[k % 7] for k in texts}
    rows = [(k, t, source[k], "x", "y", "z") for k, t in texts.items()] + [(5, texts[5], source[5], "x", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    check_mix([(r.doc_id, source[r.doc_id], r["size"], r.target, r.taken) for r in got], texts)
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    none = docs_of(spark, [])
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).count() == 0
    no_name = docs_of(spark, [(None, None), (None, "a b c")], None)
    assert [r.source_size for r in mixing.mix_plan(no_name).collect()] == [3, 3]


# ---- token files ------------------------------------------------------------------

HARD = ["", None, " ", "  a  b", "a  b 　c", "a    b\n\n c\t d ", "<|endoftext|> x <|endoftext|>", "don't  'll 12 34, e.g. (x)", "é è  ê\u0085 x", "日本 語 テ ", "a" * 5000, " \n \n", "x\x7f y\x1c z", "é, f… g… , h", "word " * 60_000, "É.È ×,÷ .."]


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_pieces_give_the_ids_of_whole_texts(spark):
    texts = HARD + list(documents(spark).values())[:60]
    ids, each = tokenfile.PieceTokenizer(PATH).encode(pa.array(texts), 2)
    assert ids.tolist() == [i for d in plain_ids(texts) for i in d] and each.tolist() == [len(d) for d in plain_ids(texts)]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(8)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 200, 700), rng.integers(0, 1 << 32, 5000, dtype=np.uint64), np.array([0, 255, 256, 65535, 65536, (1 << 32) - 1])):
        file = tokenfile.TokenFile.parse(tokenfile.encode_ids(np.asarray(ids, np.uint32), np.array([0, len(ids)])))
        assert file.all_ids().tolist() == list(ids) and len(file) == len(ids)
        assert all(file.token(i) == ids[i] for i in range(0, len(ids), 7))


def check_tokens(rows, docs):
    """docs: (doc_id, text) in file order."""
    at = 0
    for r, ids in zip(sorted(rows, key=lambda r: r.start), plain_ids([t for _, t in docs]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [d for d, _ in docs]


def test_token_query_equals_plain_encoding(spark):
    check_tokens(entry.queries()["op7_token_codes"](spark, SF).collect(), sorted(documents(spark).items()))


def test_token_edges(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "range_bounds", lambda df, key, rows: [3, 9])
    monkeypatch.setattr(tokenfile, "FILE_TOKENS", 5)  # several files for a range
    monkeypatch.setattr(tokenfile, "_BYTES", 8)
    docs = [(None, "null id"), (1, "b c"), (1, "z"), (3, None)] + [(5 + k, t) for k, t in enumerate(HARD)] + [(4, "q"), (4, "q")]
    rows = tokenfile.token_table(docs_of(spark, docs), PATH).collect()
    check_tokens(rows, sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")))
    assert tokenfile.token_table(docs_of(spark, []), PATH).count() == 0


# ---- fingerprints -----------------------------------------------------------------


def pieces(text):
    parts = re.split(r"[ \t\n\x0b\f\r]*[\r\n][ \t\n\x0b\f\r]*|(?<=[.!?]) +(?=[A-EÀ-Ë])", text)
    return {p for p in parts if p.strip(" ")}


def check_fingerprints(rows, texts):
    order, seen = sorted(texts), {}
    texts = {i: t or "" for i, t in texts.items()}
    for k, i in enumerate(order):
        own, follow = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + follow[:half]
        a, e, n = pieces(own), pieces(edited), pieces(follow)
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        r = rows[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert np.isclose(r.near_edited, like(a, e)) and np.isclose(r.near_next, like(a, n))
        for text, mark in ((own, r.fingerprint), (edited, r.edited_fingerprint)):
            assert seen.setdefault(text, mark) == mark


def test_fingerprint_query_equals_plain_sets(spark):
    df = entry.queries()["op8_paragraph_sketches"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r.doc_id: r for r in df.collect()}
    check_fingerprints(rows, documents(spark))


def test_fingerprint_edges(spark, monkeypatch):
    monkeypatch.setattr(bloomsketch, "CELLS", 0.2)  # too small at first: sketches fail and are retried
    monkeypatch.setattr(bloomsketch, "range_bounds", lambda df, key: [3, 7])
    lines = "\n".join(f"line {k}" for k in range(5000))
    texts = {1: None, 2: "", 3: "one line", 4: "a\n\nb\r\nc", 5: lines, 6: lines, 7: lines[: len(lines) // 2] + "\nmore", 8: "😀 x. Bé😀\n" * 50, 9: "y. A b"}
    rows = {r.doc_id: r for r in bloomsketch.fingerprints(docs_of(spark, texts.items())).collect()}
    check_fingerprints(rows, texts)
    assert rows[5].fingerprint == rows[6].fingerprint and rows[5].near_next == 1.0
    assert len(rows[6].added) + len(rows[6].removed) > 0
    alone = bloomsketch.fingerprints(docs_of(spark, [(1, "a\nb"), (1, "a\nb"), (None, "c")])).collect()
    assert len(alone) == 3 and bloomsketch.fingerprints(docs_of(spark, [])).count() == 0


# ---- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    previous = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, previous, SF)
        assert after.columns == docs.columns
        before_ids, after_ids = Counter(r.doc_id for r in previous.collect()), Counter(r.doc_id for r in after.collect())
        texts = {r.doc_id: r.text for r in previous.collect()}
        if name == "language":
            assert len(after_ids) > 0.97 * len(before_ids)
        if name == "near copies":
            assert set(after_ids) == set(plain_classes(dict(sorted(texts.items()))).values())
        if name == "benchmark":
            assert set(before_ids) - set(after_ids) == {d for d, _ in plain_hits(texts, items)}
        if name == "mix":
            assert max(after_ids.values()) <= 2 and after_ids.total() > len(before_ids)
        previous = spark.createDataFrame(after.collect(), docs.schema)
    final = entry.queries()["pipeline"](spark, SF).collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in previous.collect())
    check_tokens(final, sorted((r.doc_id, r.text) for r in previous.collect()))


def test_no_operator_swallows_a_missing_import():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for path in [root / "corpus_pipeline.py", *(root / "caseloom/llm").glob("*.py")]:
        assert "ImportError" not in path.read_text()
