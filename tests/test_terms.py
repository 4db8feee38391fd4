import random
import re

import pytest

from caseloom.operators import terms as te, texts as tx

WORDS = ["orb", "Orb", "disc", "tic-tac", "tic", "of the", "OF", "the", "é", "x2", "a_b", "the orb", "orb disc orb"]
GAPS = [" ", "  ", "-", ", ", "\n", "", "."]


def by_patterns(texts, terms):
    """Hits of alternations that name the longest terms first, and of dates."""
    out = set()
    kinds = sorted({kind for kind, _ in terms})
    for key, text in texts:
        for kind in kinds:
            longest_first = sorted({t for k, t in terms if k == kind}, key=len, reverse=True)
            pattern = r"(?i)\b(%s)\b" % "|".join(map(re.escape, longest_first))
            seen = {}
            for name in re.findall(pattern, text or ""):
                seen.setdefault(name.lower(), name)
            out |= {(key, name, kind, 0.85, "deterministic") for name in seen.values()}
        out |= {(key, d, "date", 0.8, "deterministic") for d in re.findall(r"\b\d{4}-\d\d-\d\d\b", text or "")}
    return out


def frames(spark, texts, terms):
    docs = spark.createDataFrame(texts, "record_id string, text string").selectExpr("*", "'clash' as name", "1 as pos")
    return docs, spark.createDataFrame(terms, "entity_type string, term string")


@pytest.mark.parametrize("seed", [1, 2])
def test_same_hits_as_patterns(spark, seed):
    rng = random.Random(seed)
    texts = [
        (f"r{i}", "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(40)))) for i in range(80)
    ]
    texts += [("null", None), ("empty", ""), ("dates", "on 2024-01-02 and 2024-01-02, 12024-01-02"), ("none", ". - ,")]
    terms = [
        ("w1", "orb"), ("w1", "the orb"), ("w1", "orb disc orb"), ("w1", "tic-tac"), ("w1", "disc  orb"), ("w1", "orb orb"),
        ("w2", "ORB"), ("w2", "of the"), ("w2", "é"), ("w2", "the"), ("w2", "The"), ("w3", "a_b"), ("w3", "x2"),
    ]
    docs, rows = frames(spark, texts, terms)
    got = te.extract_terms(docs, rows).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_patterns(texts, terms)


def test_fixed_dictionary_gives_what_its_patterns_give(spark):
    texts = [
        ("a", "The FBI saw an orb; fbi radar, FLIR and ir, Tic-Tac tic-tac. NASA2 is not nasa"),
        ("b", "hypersonic, instantaneous  acceleration, instantaneous acceleration on 2023-05-06"),
        ("c", "no hit"),
    ]
    docs, rows = frames(spark, texts, [(kind, t) for kind, terms in tx.DICTIONARY.items() for t in terms])
    plain = sorted(map(tuple, tx.extract_entities(docs).collect()))
    assert plain == sorted(map(tuple, te.extract_terms(docs, rows).collect())) and len(plain) > 8


def test_repeated_rows_and_long_chains_of_overlaps(spark):
    chain = " ".join(["a"] * 5001)
    docs, rows = frames(spark, [("k", chain)] * 3 + [("k", "a b")], [("w", "a a"), ("w", "b")])
    got = sorted((r.name, r.record_id) for r in te.extract_terms(docs, rows).collect())
    assert got == [("a a", "k"), ("b", "k")]


def test_empty_tables_and_terms_without_borders(spark):
    docs, rows = frames(spark, [("k", "c++ is c")], [("w", "c++"), ("w", None), ("w", "")])
    assert te.extract_terms(docs, rows).count() == 0
    assert te.extract_terms(docs.limit(0), rows).count() == 0


def test_many_terms(spark):
    terms = spark.range(100_000).selectExpr("'t' as entity_type", "concat('term', id, if(id % 2 = 0, ' tail', '')) as term")
    docs = spark.range(200).selectExpr("id as record_id", "concat('Term', id, ' tail; the term', id * 2 + 1, 'x') as text")
    got = {(r.record_id, r.name) for r in te.extract_terms(docs, terms).collect()}
    assert got == {(i, f"Term{i} tail" if i % 2 == 0 else f"Term{i}") for i in range(200)}
