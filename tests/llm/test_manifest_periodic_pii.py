import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import manifest, periodic, pii

# Manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def steps_of(levels, place, fanout):
    out = []
    for level in levels[:-1]:
        first = place - place % fanout
        run = level[first : first + fanout]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= fanout
    return out


def by_hand(rows, changed, fanout):
    groups = {}
    for row in rows:
        groups.setdefault("0" if row[2] is None else "1" + row[2], []).append((row[0] is not None, row[0] or 0, H(*map(enc, row)), row))
    names = sorted(groups, key=str.encode)
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    top = climb([trees[g][-1][0] for g in names], fanout)
    out = []
    for i, g in enumerate(names):
        for place, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = steps_of(trees[g], place, fanout) + steps_of(top, i, fanout)
            h = H(*map(enc, changed(row)))
            for left, right in steps:
                h = H(left, h, right)
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], H(*[a + b for a, b in steps]), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,levels", [(2, 3), (3, 2)])
def test_manifest_against_a_tree_by_hand(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)  # so that a few rows make several tiers
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["s", None, "1:a"]), rng.choice(["hot"] * 6 + ["é", "z", "a"]), rng.choice([3, None]), rng.choice(["", None, "tëxt", "x" * 3000])) for i in range(90)]
    rows += [(None, "s", "hot", 1, "a"), (None, None, None, None, None), (5, "s", "hot", 1, "tie"), (7, "s", "one", 1, "alone"), rows[4], rows[4]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    got = manifest.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fanout)
    tamper = lambda r: (*r[:3], r[3] + 1 if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[3], r[4])
    want = by_hand(rows, tamper, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_little(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    assert manifest.manifest(spark.createDataFrame([], schema), "lang", "doc_id", columns).collect() == []
    (row,) = manifest.manifest(spark.createDataFrame([(1, "s", "en", 2, "ab")], schema), "lang", "doc_id", columns).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == H("1:1", "1:s", "2:en", "1:2", "2:ab") and row.proof_sha256 == H() and row.verified


# Periodic runs


def runs_by_hand(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_text(rng):
    letters = "abcde"[: rng.choice([1, 2, 3, 5])]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.6:
        words += ([rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.randint(2, 9))[: rng.randint(1, 70)] + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    return words


def test_runs_against_all_periods():
    rng = random.Random(5)
    for _ in range(400):
        texts, least = [some_text(rng) for _ in range(rng.randint(1, 4))], rng.choice([4, 12])
        for words, (got_words, got) in zip(texts, periodic.find_runs([" ".join(w).encode() for w in texts], None, least), strict=True):
            want = runs_by_hand(words, least)
            assert [tuple(r) for r in got.tolist()] == want and got_words == [w.encode() for w in words]
            dropped = {i for s, n, q in want for i in range(s + q, s + n)}
            assert periodic.collapse(got_words, got) == [w for i, w in enumerate(got_words) if i not in dropped]


def test_suffix_array_and_lcp():
    rng = random.Random(6)
    ids = np.asarray([rng.randrange(3) for _ in range(300)] + [9])
    index = periodic.SuffixArray.of(ids)
    suffixes = sorted(range(301), key=lambda i: ids[i:].tolist())
    assert index.order.tolist() == suffixes and index.inverse[index.order].tolist() == list(range(301))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(ids[a:], ids[b:])) if x != y), 301 - max(a, b))
    assert index.lcp().tolist() == [0] + [shared(a, b) for a, b in zip(suffixes, suffixes[1:])]


def test_op12_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(some_text(rng)) + rng.choice(["", "\n", "\x0b x"])) for i in range(60)] + [(100, None), (None, "a " * 30), (101, ""), (102, "é " * 13), (102, "é " * 13), (103, "w " * 60_000), (104, "z z z " * 12)]
    spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (j - a) % p] if j >= a else w for j, w in enumerate(words)]
        runs = runs_by_hand(words, 12) if n < 1000 else [(0, n, 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        drop = {j for s, m, q in runs for j in range(s + q, s + m)}
        text_of_runs = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, H(text_of_runs), H(" ".join(w for j, w in enumerate(words) if j not in drop))))
    got = periodic.op12_periodic(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_runs > 0 for r in got) > 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty, ["doc_id"]).collect() == []


# Personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {"email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))), "card": (CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (PHONE, lambda s: 8 <= len(digits(s)) <= 15)}
    return {k: [m.span() for m in p.finditer(text) if ok(m.group())] for k, (p, ok) in tests.items()}


def test_base_spans_against_plain_patterns():
    rng = random.Random(11)
    pieces = ["@", "a", "b.c", ".", "-", "+1", "(", ") ", " ", "4539578763621486", "1", "255", "256", "0", "00.1", "10.0.0.1", "x@y.z", "é", "+49 (30) 555-1234", "4111 1111 1111 1111", "%", "_", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == base_by_hand(text), text


def test_patterns_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1990 " * 50_000, "+1((((" * 30_000):
        pii.base_spans(text)
        assert sum(1 for _ in pii.proposals(text)) < 400_000


def people(rng, n):
    """(text, spans) with personal data of each kind, and numbers that are none."""
    def card():
        d = [4] + [rng.randrange(10) for _ in range(14)]
        total = sum(sum(divmod(c * (2 - i % 2), 10)) for i, c in enumerate(d))
        return "".join(map(str, d)) + str(-total % 10)

    out = []
    for i in range(n):
        kinds = {"email": f"who.{i}@mail{i % 10}.example.com", "ip": ".".join(str(rng.randrange(1, 256)) for _ in range(4)), "card": card(), "phone": f"+1 ({rng.randrange(100, 1000)}) 555-{rng.randrange(10000):04d}"}
        kind = rng.choice(list(kinds))
        text = f"some words {kinds[kind]} more words"
        if i % 3 == 0:
            text += f" and order {rng.randrange(10**15, 10**16 - 1) // 10 * 10 + 3} or 3.14.15"
        out.append((i, text, (kind, 11, 11 + len(kinds[kind]))))
    return out


def test_trees_add_what_the_patterns_swallow(spark):
    rows = people(random.Random(3), 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    models = pii.train(docs)
    assert set(models) == set(pii.KINDS) and all(m.threshold < 1 for m in models.values())
    swallowed = "call +1 (853) 555-7168 38.253.197.126 4880761348116108 now"
    (base, added), clean = pii.find([swallowed], models)[0], pii.find(["order 1234567890123456 of 2024-01-02, 3.14.15.926 and 10 20 30 40 50 60 70 80"], models)[0]
    assert ("phone", 5, 22) in added and ("card", 38, 54) in added and base["ip"] == [(23, 37)]
    assert clean[1] == [] and not any(clean[0].values())
    # Everything that is there is found, and on numbers that are none nothing is added.
    for (_, text, span), (base, added) in zip(rows, pii.find([t for _, t, _ in rows], models), strict=True):
        assert span in [(k, *s) for k in base for s in base[k]]
        assert all(pii.valid(k, text[a:b]) for k, a, b in added)


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = pii.Trees.fit(x[:2000], y[:2000])
    trees.calibrate(x[2000:3000], y[2000:3000])
    p = trees.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.97
    assert abs(p.mean() - y[3000:].mean()) < 0.05
    noisy = np.where(rng.random(4000) < 0.2, 1 - y, y)
    trees = pii.Trees.fit(x[:2000], noisy[:2000])
    trees.calibrate(x[2000:], noisy[2000:])
    near = (trees.probability(x) > 0.7) & (trees.probability(x) < 0.9)
    assert abs(noisy[near].mean() - trees.probability(x)[near].mean()) < 0.07


def test_best_choice_of_spans():
    rng = random.Random(4)
    for _ in range(200):
        spans = [(rng.random(), "card", a, a + rng.randint(1, 6)) for a in (rng.randrange(12) for _ in range(7))]
        best = max((sum(s[0] for i, s in enumerate(spans) if m >> i & 1) for m in range(128) if all(not (m >> i & 1 and m >> j & 1) or spans[i][3] <= spans[j][2] or spans[j][3] <= spans[i][2] for i in range(7) for j in range(i))))
        chosen = pii.choose(spans)
        assert abs(sum(max(s[0] for s in spans if s[1:] == c) for c in chosen) - best) < 1e-9


def test_op13_query(spark, tmp_path):
    rows = [(i, t) for i, t, _ in people(random.Random(9), 120)] + [(900, None), (901, ""), (None, "x@y.zz"), (902, "é 10.0.0.1 " * 3000), (903, "same x@y.zz"), (903, "same x@y.zz")]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op13_pii(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        base = base_by_hand(text or "")
        want.append((i, *(len(base[k]) for k in pii.KINDS), H(",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty, pii.train(empty), ["doc_id"]).collect() == []
