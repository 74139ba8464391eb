import random
import re

import pytest

from ledgerloom.llm import minhash


def words(n, rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def edited(base, edits, rng):
    made = list(base)
    for _ in range(edits):
        made[rng.randrange(len(made))] = "".join(rng.choice("klmnop") for _ in range(6))
    return made


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent):
    """Components of all pairs' links: {row: (n_shingles, component)}."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(sets):
        for j, q in enumerate(sets[:i]):
            if p and q and docs[i][0] is not None and docs[j][0] is not None and 100 * len(p & q) >= percent * len(p | q):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((str(key), len(s), str(least.get(find(i)) if key is not None else None)) for i, ((key, _), s) in enumerate(zip(docs, sets)))


def ran(spark, docs, percent=85):
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


@pytest.mark.parametrize(("percent", "seed"), [(85, 1), (80, 2)])
def test_clouds_and_chains(spark, percent, seed):
    rng = random.Random(seed)
    docs = []
    for size in (60, 150, 400):
        base = words(size, rng)
        docs += [base] + [edited(base, rng.randrange(0, size // 25 + 2), rng) for _ in range(25)]
        chain = base
        for _ in range(8):  # neighbours are alike, the ends are not
            chain = edited(chain, max(1, size // 90), rng)
            docs.append(chain)
        second = edited(base, size // 30, rng)  # a group about a text that is not linked to the first
        docs += [edited(second, 1, rng) for _ in range(10)]
        docs += [base + words(size // 8, rng), base[: size * 9 // 10], base[: size * 8 // 10]]
    rng.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert ran(spark, rows, percent) == brute(rows, percent)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "É é"), (8, "é é"), (None, "one two"), (9, "a b c d e f"), (9, "a b c d e f"), (10, "x " * 30000), (11, "x " * 40000)]
    assert ran(spark, rows) == brute(rows, 85)


def test_one_id_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, "a b c d e f g")]
    got = ran(spark, rows)
    assert got == [("1", 3, "1"), ("1", 3, "1"), ("2", 3, "1"), ("3", 3, "1")]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_shingles int, bucket int, node int")
    assert minhash.near_duplicates(empty).collect() == []
    some = spark.createDataFrame([(5, "a b c d e f", 1, 2, 3), (4, "a b c d e f", 1, 2, 3)], empty.schema)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(some).collect()} == {(5, 4), (4, 4)}
    assert [r.doc_id for r in minhash.keep_first(some).collect()] == [4]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in minhash.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_many_documents_on_one_template(spark):
    """Documents that share half of their shingles meet in many buckets and are not linked; what is compared grows with their number, not its square."""
    rng = random.Random(5)
    template = words(120, rng)
    docs = [template[:60] + words(60, rng) for _ in range(400)]
    docs += [edited(docs[7], 1, rng), edited(docs[8], 2, rng), docs[9][:-2]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert ran(spark, rows) == brute(rows, 85)
