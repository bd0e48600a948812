import itertools
import random
import re

from pyspark.sql import functions as F

from quillon.llm import near

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None and shingles(t)]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, rows):
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    expected = brute_force(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)
    return got


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_families_equal_brute_force(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for size, length, most in ((40, 120, 8), (25, 60, 5), (60, 200, 12), (8, 9, 2)):
        base = [f"v{rng.randrange(400)}" for _ in range(length)]
        for _ in range(size):
            rows.append((at * 7 % 1009, family(rng, base, rng.randrange(most + 1))))
            at += 1
    rows += [(5000 + k, " ".join(f"z{rng.randrange(10**5)}" for _ in range(40))) for k in range(20)]
    check(spark, rows)


def test_nulls_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, None), (7, "a b c d e"), (8, "A B C D E"), (7, "a b c d e"), (9, "x y z q r s t"), (9, "one two")]
    got = check(spark, rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1, 2, 3}


def test_chain_of_links(spark):
    words = [f"c{k}" for k in range(60)]
    # each shifts the last by three words: neighbours link, ends do not
    rows = [(k, " ".join(words[3 * k : 3 * k + 30])) for k in range(10)]
    check(spark, rows)


def test_empty_table(spark):
    assert near.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_keeps_columns_and_one_row_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "k"), (1, "a b c d e f", "m"), (1, "a b c d e f", "m"), (None, "a b c d e f", None), (8, "", "z")], "doc_id long, text string, component_id string")
    kept = near.filtered(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r.doc_id, r.component_id) for r in kept] == [(None, None), (1, "m"), (8, "z")]
    assert near.filtered(docs).columns == docs.columns
