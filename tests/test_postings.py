import random

import pyarrow as pa
import pytest

from caseloom.operators import postings as po, search as se

ALPHABET = "abAB é_%\\\0ß😀."


def like(text, query):
    """``LIKE '%query%'`` by plain matching."""
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    text, pattern = fold(text), "%" + fold(query) + "%"
    reach = {0}
    for c in pattern:
        if c == "%":
            reach = set(range(min(reach), len(text) + 1)) if reach else set()
        else:
            reach = {i + 1 for i in reach if i < len(text) and (c == "_" or text[i] == c)}
    return len(text) in reach


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(400)]
    # across the border of two pieces, also with characters of two code units
    long = "x" * 4094 + "needle" + "y" * 5000 + "é😀end"
    texts += [long, "😀" * 4095 + "needle", None, "", "NEEDLE", "need\nle"]
    return [(f"r{i % 50}", i, t) for i, t in enumerate(texts)] + [("r1", 1, texts[1])]


@pytest.fixture(scope="module")
def chunks(spark, rows):
    df = spark.createDataFrame(rows, "record_id string, chunk_index long, text string")
    return df.selectExpr("*", "'clash' as block", "'clash' as gram")


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return po.write_postings(chunks, str(tmp_path_factory.mktemp("keywords") / "index"), shelves=3)


QUERIES = ["needle", "NEEDLE", "a", "A ", "ab_", "a_b", "a%b%a", "é😀", "😀😀😀", "\\", "\\%a", "_", "%", "", "%%é", "\0", "ß.",
           "aab", "b\0", "e%y_é", "nee%dle", "absent", "d\nl", "É"]


@pytest.mark.parametrize("query", QUERIES)
def test_matches_equal_plain_matching(rows, index, query):
    got = sorted((r.record_id, r.chunk_index) for r in po.keyword_matches(index, query).collect())
    assert got == sorted((r, c) for r, c, t in rows if t is not None and like(t, query))


def test_search_by_index_equals_search_by_scan(spark, chunks, index):
    records = spark.createDataFrame(
        [(f"r{i}", "a needle" if i % 7 == 0 else None if i % 5 == 0 else "title") for i in range(45)], "id string, title string"
    ).selectExpr("id", "title", "'x' agency", "'d' release_date", "'u' document_url", "'p' local_path")
    artifacts = spark.createDataFrame([("r0", "s1"), ("r0", "s2"), ("r3", "s3")], "record_id string, sha256 string")
    for query in ("needle", "a_", "%", "title"):
        for k in (3, 1000):
            plain = se.keyword_search(query, chunks, records, artifacts, k=k)
            by_index = se.keyword_search(query, None, records, artifacts, k=k, index=index)
            assert sorted(map(str, plain.collect())) == sorted(map(str, by_index.collect())), query


def test_only_lists_and_shelves_asked_for_are_read(index):
    plan = po.candidates(index, "needle")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [dle,edl,eed,nee])]" in plan
    short = po.candidates(index, "Ne")._jdf.queryExecution().toString()
    assert "StringStartsWith(gram,ne)" in short
    found = po.on_shelves(index, po.candidates(index, "needle").limit(1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shelf" in found or "PartitionFilters: [shelf" in found


def test_shelves_are_numbered_without_gaps(index, rows):
    entries = index.entries.collect()
    assert len(entries) == len(rows)
    for shelf in range(3):
        places = sorted(e.place for e in entries if e.shelf == shelf)
        assert len(places) > 64 and places == list(range(len(places)))


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "record_id string, chunk_index long, text string")
    index = po.write_postings(none, str(tmp_path / "none"))
    assert index.entries.count() == index.postings.count() == 0
    for query in ("needle", "a", "%"):
        assert po.keyword_matches(index, query).count() == 0


def test_needles():
    assert po.needles("AbCd_x%yz") == ["abc", "bcd"]
    assert po.needles("ab%C") == ["ab", "c"]
    assert po.needles("%_%") == []


def listed(spots, texts):
    """(gram, shelf, place) as listed."""
    columns = [pa.array([s for s, _ in spots], pa.int32()), pa.array([p for _, p in spots], pa.int32())]
    columns.append(pa.array([t.encode() for t in texts], pa.binary()))
    batch = pa.RecordBatch.from_arrays(columns, ["shelf", "place", "text"])
    return {
        (row["gram"], row["shelf"], word * 64 + i)
        for lists in po._listed(iter([batch]))
        for row in lists.to_pylist()
        for word, bits in zip(row["words"], row["bits"], strict=True)
        for i in range(64)
        if bits >> i & 1
    }


def plainly(spots, texts):
    folded = ["".join(c.lower() if c.isascii() else c for c in t) + "\0\0" for t in texts]
    return {(t[i : i + 3], *spot) for spot, t in zip(spots, folded, strict=True) for i in range(len(t) - 2)}


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_lists_hold_every_gram_however_texts_are_cut(monkeypatch, piece):
    monkeypatch.setattr(po, "_PIECE", piece)
    rng = random.Random(8)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 3, 40]))) for _ in range(100)]
    spots = rng.sample([(shelf, place) for shelf in (0, 9, 65535) for place in range(200)], len(texts))
    assert listed(spots, texts) == plainly(spots, texts)
    assert listed([(0, 0)], ["needle"]) == plainly([(0, 0)], ["needle"])


def test_lists_of_very_many_characters():
    letters = "".join(map(chr, range(0x10000, 0x10000 + (1 << 17))))
    texts = [letters[i : i + 1500] for i in range(0, len(letters), 1500)]
    spots = [(1, 64 * i) for i in range(len(texts))]
    assert listed(spots, texts) == plainly(spots, texts)


def test_texts_are_not_shuffled(index):
    plan = po.keyword_matches(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
