import random

import duckdb
import numpy as np
import xxhash
from tidemark.llm import simhash
from tidemark.llm.common import connected_components


def naive_fingerprint(text):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, prints):
    comp = list(range(len(ids)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                comp[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_golay_vectors_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    kx = simhash.segment_keys(x)
    assert {len(set(k)) for k in kx.tolist()} == {1, 6}
    for a in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, a, replace=False):
                y[i] ^= 1 << int(b)
        ky = simhash.segment_keys(y)
        assert all(set(p) & set(q) for p, q in zip(kx.tolist(), ky.tolist()))


def test_fingerprint_agrees_with_definition():
    rng = random.Random(2)
    words = ["Ab", "b", "Çe", "dEf", "x y"]
    for n in (0, 1, 3, 4, 5, 40, 9000):
        t = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(t) == naive_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_components_agree_with_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(80)) for _ in range(15)]
    rows = []
    for i in range(300):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice("qrstuv")
        rows.append((i * 7 % 301, " ".join(w), "extra"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "   ", "x"), (None, base[0], "x"), (3, rows[0][1], "x"), (3, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = [naive_fingerprint(r[1]) for r in rows]
    comps = naive_components([r[0] for r in rows], prints)
    want = sorted((r[0] is None, r[0] or 0, f"{p:016x}", c) for r, p, c in zip(rows, prints, comps))
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_at_planted_distances(spark):
    rng = random.Random(4)
    prints = []
    for _ in range(150):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(rng.choice([1, 1, 3])):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 5])):
                x ^= 1 << b
            prints.append(x)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long").distinct()
    comp = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df)).collect()}
    want = naive_components(signed, prints)
    assert [comp.get(p, p) for p in signed] == want


def test_whole_small_table(spark, sf_dir):
    from tidemark.llm.queries import queries

    got = queries()["op5_simhash_golay"](spark, sf_dir).toPandas()
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    prints = [naive_fingerprint(t) for _, t in docs]
    want = sorted(zip([d for d, _ in docs], [f"{p:016x}" for p in prints], naive_components([d for d, _ in docs], prints)))
    assert sorted(zip(got.doc_id, got.fingerprint, got.component_id)) == want


def test_one_of_each_group_without_ids_and_with_shared_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(60))
    t = [text() for _ in range(9)]
    rows = [(None, t[0], 1), (None, t[1], 2), (None, t[1], 2), (None, t[2], 3), (5, t[3], 4), (5, t[4], 5), (7, t[2], 6), (7, t[5], 7), (9, t[5], 8), (8, None, 9), (None, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(r.n for r in simhash.one_of_each_group(df).collect())
    assert got == [1, 2, 4, 5, 6, 7, 9]
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def test_one_of_each_group_whatever_the_names(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(60)) for _ in range(2))
    rows = [(3, b, 1, 2, 3, 4, 5), (5, b, 1, 2, 3, 4, 5), (5, a, 1, 2, 3, 4, 5), (7, a, 1, 2, 3, 4, 5), (None, a, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp int, __id int, __h int, id int, row int")
    got = simhash.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted([rows[0], rows[2]])
    large = spark.createDataFrame([(2**53 + 1, a), (None, b), (2**53 + 3, b)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each_group(large).collect()) == [2**53 + 1, 2**53 + 3]
    assert {r.doc_id for r in simhash.near_duplicates(large).collect()} == {2**53 + 1, None, 2**53 + 3}


def test_dotted_names_and_ties_by_the_whole_row(spark):
    text = "one two three four five six"
    rows = [(1, text, k, {"m": k}) for k in (5, 3, 9, 3)] + [(2, "other words stand here instead of these", 1, None)]
    schema = "doc_id long, text string, `a.b` long, maps map<string,long>"
    got = [[tuple(r)[:3] for r in simhash.one_of_each_group(spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3)).collect()] for k in (0, 2, 4)]
    assert sorted(got[0]) == sorted(got[1]) == sorted(got[2]) and len(got[0]) == 2
    assert simhash.one_of_each_group(spark.createDataFrame(rows, schema)).columns == ["doc_id", "text", "a.b", "maps"]
