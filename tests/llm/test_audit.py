import itertools
import random
import re

import duckdb
from tidemark.llm import audit
from tidemark.llm.queries import oracle_sql, queries


def brute(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = {}
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        parts.setdefault(lang or "", []).append((i, fails))
    out = []
    for part, rows in parts.items():
        lost = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                went = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                lost[f] += len(went)
                fail = sum(r[1][f] for r in rows)
                mine.append([part, order, k + 1, len(left), len(went), fail - len(went), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows), sum(r[0] in good for r in went), sum(r[0] in toxic for r in went), f])
        out += [tuple([*m[:-1], lost[m[-1]]]) for m in mine]
    return sorted(out)


def invented(seed=5):
    rng = random.Random(seed)
    docs = []
    for i in range(120):
        n = rng.choice([0, 3, 150, 199, 200, 260])
        vocabulary = rng.choice([["x"], [f"w{k}" for k in range(70)], [f"v{k}" for k in range(900)], ["Ab", "ÄÖ", "cd", *(f"é{k}" for k in range(300))]])
        text = rng.choice(["", " ", "\n\x0b"]) + rng.choice([" ", "\t", "\r\n"]).join(rng.choices(vocabulary, k=n)) + rng.choice(["", "", "#", " | ", "A" * 30])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(500 + k, rng.choice(docs)[1], rng.choice(["en", "fr"])) for k in range(60)]
    docs += [(None, docs[0][1], "en"), (None, None, None), (7, None, "de"), (docs[3]), (3, docs[3][1], "en"), (900, "", "de"), (901, None, "de"), (902, "long " * 50_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 560, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    rng.shuffle(docs)
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, "z", 1, "x") for r in docs], "doc_id long, text string, lang string, part string, A int, `a.b` string")
    return audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_agrees_with_applying_the_filters_one_by_one(spark):
    docs, labels = invented()
    got = run(spark, docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_empty_tables(spark):
    assert run(spark, [], []).collect() == []
    got = run(spark, [(1, None, None)], []).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.shapley for r in got} == {0, 120}


def test_sql_twin(spark, tmp_path):
    docs, labels = invented(9)
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries()["op13_filter_audit"](spark, f"file://{tmp_path}")
    assert sorted(con.sql(oracle_sql()["op13_filter_audit"]).fetchall()) == sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_shares_of_the_dividends_add_up():
    for f in range(5):
        rows = [c for c in audit.coefficients(5) if c[1] == f]
        assert len(rows) == 16 * 32 and len({(c[2], c[7]) for c in rows}) == 32
