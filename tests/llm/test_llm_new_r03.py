"""Alignment of tokenizers, prefix tries and licence notices against plain models, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from caseloom.llm import alignment, licences, prefixtrie
from conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- alignment --------------------------------------------------------------------


def plain_alignment(texts):
    """Whole texts, one after another, with no cut and no cache."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    value = alignment._byte_values()
    bytes_a = {i: bytes(value[c] for c in s) for s, i in one.get_vocab().items() if all(c in value for c in s)}
    rows, links, documents = [], [], Counter()
    for text in texts:
        row, own = (0, 0, 0, 0, ""), Counter()
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            part_a = [bytes_a[i] for i in a]
            part_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(part_a) == b"".join(part_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(p) for p in part_a]), np.cumsum([len(p) for p in part_b])
                groups, low = [], 0
                for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                    groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if low < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))))
                    low = end
                for x, y in groups:
                    own.update((i, j) for i in x for j in y)
                said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                row = (len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(said.encode()).hexdigest())
        rows.append(row)
        links.append(own)
        documents.update(own.keys())
    best = defaultdict(int)
    for (i, _), n in documents.items():
        best[i] = max(best[i], n)
    return [
        (*r[:4], sum(m for (i, j), m in own.items() if documents[i, j] == best[i]), sum(m * documents[p] for p, m in own.items()), r[4])
        for r, own in zip(rows, links, strict=True)
    ]


def aligned(df):
    rows = alignment.align_documents(df, A, B).collect()
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "a\n b", "a \n", "\n", "<|endoftext|> x", "a" * 3000, "😀" * 200, "x▁y", "漢字" * 300, "ﬁ x",
    "</s><s> <0x41>", "\x1c a", "a　 b", "é é", "x\x00y", "the the the the", "the the the the",
]


@pytest.mark.parametrize("links", [40, alignment.CHUNK_LINKS])
def test_alignment_equals_plain_model(spark, monkeypatch, links):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    rnd = random.Random(7)
    texts = ODD + ["".join(rnd.choice("ab c  \n\t.,éß▁漢😀01<|>　\x00 ") for _ in range(rnd.randint(1, 50))) for _ in range(120)]
    rows = [(i, t, "x", 0, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, pair int, _text string")
    assert aligned(df) == dict(enumerate(plain_alignment(texts)))


def test_alignment_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = entry.queries()["op11_pair_bitmaps"](spark, SF).collect()
    want = dict(zip([r.doc_id for r in rows], plain_alignment([r.text for r in rows]), strict=True))
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found} == want


def test_alignment_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(df, A, B).count() == 0
    two = spark.createDataFrame([(1, "one word"), (1, "one word"), (None, "one")], "doc_id long, text string")
    rows = alignment.align_documents(two, A, B).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1] and rows[1] == rows[2]
    assert rows[0].count_sum == 3 and rows[1].count_sum == 3 + 2


def test_bitmaps_give_back_their_links():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(900), 12)
    pair = np.concatenate([np.sort(rng.choice(40, 12, replace=False)) for _ in range(900)]) ** 3
    times = rng.integers(1, 300, len(doc))
    sums = Counter()
    for own, plane, dense, bits, count in alignment.planes(doc.astype(np.uint16), pair, times, 900):
        for p, b, n in zip(own.tolist(), bits.to_pylist(), count.tolist(), strict=True):
            raw = np.frombuffer(b, np.uint8)
            found = np.flatnonzero(np.unpackbits(raw, bitorder="little")) if dense else raw.view("<u2")
            assert len(found) == n
            for d in found.tolist():
                sums[d, p] += 1 if plane == 0 else 1 << (plane - 1)
    assert sums == Counter({(d, p): t for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True)})


def test_whole_texts_where_a_tokenizer_cannot_be_cut():
    cut, whole = alignment.PairAligner(A, B), alignment.PairAligner(A, B)
    assert cut.cuts
    whole.cuts = False
    texts = [*ODD, "Some words, more words.\n\n And  more"]
    one, two = cut.align(texts), whole.align(texts)
    assert one[1] == two[1]
    for x, y in zip((one[0], *one[2:]), (two[0], *two[2:]), strict=True):
        assert (x == y).all()


# ---- prefix trie ------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1] or 0))] for c, x in turns.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + x[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
        ends[tuple(x)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, key string, shard int")
    return sorted(map(tuple, prefixtrie.prefix_trie(df, **how).select(*TRIE).collect()))


@pytest.mark.parametrize("cells", [1, 40, prefixtrie.CELLS])
def test_trie_equals_plain_model(spark, cells):
    rnd = random.Random(5)
    rows = []
    for c in range(60):
        # a crowd of equal conversations, and few different turns otherwise
        n = 3 if c % 3 == 0 else rnd.randint(0, 12)
        for k in range(n):
            text = "same é" if c % 3 == 0 else rnd.choice(["a", "bé", None, "", "long " * 50])
            rows.append((c, None if c % 7 == 0 and k == 1 else k, None if c % 11 == 0 else rnd.choice(["user", "tool"]) if c % 3 else "user", text))
    rows += [(100, k, "user", f"turn {k // 2}") for k in range(300)] + [(101, k, "user", f"turn {k // 2}") for k in range(250)]
    rows += [(200, 0, "user", "only"), (None, 0, "user", "no conversation")]
    rnd.shuffle(rows)
    assert trie(spark, rows, cells=cells) == plain_trie(rows)


def test_trie_of_a_crowd(spark):
    """Equal conversations over many shards and blocks are one path."""
    rows = [(5 * c, k, "user", f"turn {k}") for c in range(400) for k in range(3)]
    found = trie(spark, rows, cells=64)
    assert found == plain_trie(rows) and len(found) == 4


def test_trie_of_nothing_and_of_repeated_rows(spark):
    assert trie(spark, []) == []
    rows = [(3, 1, "user", "a"), (3, 1, "user", "a"), (4, None, None, None), (4, None, None, None), (9, 0, "u", "x")]
    assert trie(spark, rows) == plain_trie(rows)
    turnless = [(c, 0, "user", "x") for c in (11, 12) if zlib.crc32(str(c).encode()) % 9 > 0]
    assert turnless and trie(spark, turnless) == plain_trie(turnless)  # all of them end at the root
    whole = prefixtrie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), group=None)
    assert whole.filter("depth = 2").count() == 2


def test_trie_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = connection.sql(entry.oracle_sql()["op12_prefix_trie"]).select(",".join(TRIE)).fetchall()
    got = entry.queries()["op12_prefix_trie"](spark, SF).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ---- licences ---------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_licences(texts):
    every = (*licences.BASE, *licences.TEMPLATES)
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    words = [WORD.findall(t) for t in low]
    frequency = Counter(w for x in words for w in set(x))
    weight = lambda w: 1 + math.log((1 + len(texts)) / (1 + frequency[w]))
    rows = []
    for x in words:
        places, labels, base, score = [], set(), set(), 0.0
        for t in every:
            own = t.text.split()
            keys = licences._key_places(t)
            rare = sorted({w for w in own if w in x}, key=lambda w: (-weight(w), w))[: licences.LOOKUPS]
            for at in range(-len(own) + 1, len(x)):
                stands = [0 <= at + q < len(x) and x[at + q] == w for q, w in enumerate(own)]
                agreed = {w for w, s in zip(own, stands, strict=True) if s and w in rare}
                share = sum(weight(w) for w, s in zip(own, stands, strict=True) if s) / sum(map(weight, own))
                if not agreed or len(agreed) < len(rare) * licences.AGREE or not all(stands[q] for q in keys) or share < licences.COVER - 1e-9:
                    continue
                labels.add(t.label)
                score = max(score, 1.0 if t.base else share)
                if t.base:
                    base.add(t.label)
                    places.append(at)
        rows.append((len(x), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6)))
    return rows


def scanned(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licences.scan_licences(df).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:6] == w[:6], i
        assert abs(got[i][6] - w[6]) < 2e-6, i


def test_licences_equal_plain_model(spark):
    notices = [t.text for t in (*licences.BASE, *licences.TEMPLATES)]
    texts = [
        None, "", "...", "Released UNDER the\nMIT-license; under the mit license.", "underthe mit license", "mit license under the",
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License and some version 3",
        "Licensed under CC BY-NC 4.0", "cc by n c", "cc-by 4.0", "All rights reserved.", "the Kelvin under the mit license", "é under the mit license é",
        "Apache License, Version 2" * 3, "apache license " * 400 + "version 2", "under the mit license " * 300, "version 2 " * 2000,
    ]
    rnd = random.Random(3)
    pool = sorted({w for n in notices for w in n.split()})
    for _ in range(150):
        words = rnd.choice(notices).split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(pool)
        texts.append(" ".join(rnd.choices(pool, k=rnd.randint(0, 9)) + words + rnd.choices(pool, k=rnd.randint(0, 9))))
    rows = [(i, t, "a", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, known string, template int, place int")
    same(scanned(df), dict(enumerate(plain_licences(texts))))


def test_licences_of_documents_without_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = entry.queries()["op13_licence_words"](spark, SF)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in found.collect()}
    same(got, dict(zip([r.doc_id for r in rows], plain_licences([r.text for r in rows]), strict=True)))


def test_licences_of_nothing_and_of_repeated_rows(spark):
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "under the mit license"), (1, "under the mit license"), (None, None)], "doc_id long, text string")
    rows = licences.scan_licences(df).orderBy("doc_id").collect()
    assert rows[1] == rows[2] and rows[1].base_labels == "mit" and rows[0].labels == "" and rows[0].first_word is None
    with pytest.raises(ValueError):
        licences._key_places(licences.Template("x", "one two", ("two three",)))
    assert licences.scan_licences(df.withColumn("text", F.lit("one two")), templates=(), base=(licences.Template("x", "one two", ("two",), True),)).filter("n_base = 1").count() == 3
