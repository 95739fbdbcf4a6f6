import re

import duckdb
import regex
from tidemark.llm import licenses
from tidemark.llm.queries import oracle_sql, queries


def grams(w):
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def paragraphs(text):
    """(first offset, text) of stretches of lines, parted by lines without letter or digit; the parting lines belong to what is before."""
    out, at, held = [], 0, ""
    for line in re.findall(r"[^\n]*\n", text + "\n"):
        held += line
        if not regex.search(r"[\p{L}\p{N}]", line):
            out.append((at, held))
            at, held = at + len(held), ""
    return [*out, (at, held)]


def units(text):
    at = 0
    for i, part in enumerate(text.split("\n")):
        yield "line", i, at, part
        at += len(part) + 1
    for i, (a, part) in enumerate(paragraphs(text)):
        if "\n" in part.rstrip(" "):
            yield "paragraph", i, a, part


def windows(text):
    seg = regex.findall(r"[^\p{L}\p{N}]*[\p{L}\p{N}]+", text)
    w = [regex.sub(r"^[^\p{L}\p{N}]+", "", x).lower() for x in seg]
    ends = [0]
    for x in seg:
        ends.append(ends[-1] + len(x))
    for no, (name, t) in enumerate(licenses.TEMPLATES):
        words, b = licenses.words_of(t), set(licenses.bigrams_of(t))
        telling, first = set(licenses._telling(sorted(b, key=licenses.bigrams_of(t).index), 0.8)), {}
        for k, g in enumerate(f"{x} {y}" for x, y in zip(words, words[1:])):
            first.setdefault(g, k)
        spots = {max(0, k - first[g]) for k, g in enumerate(f"{x} {y}" for x, y in zip(w, w[1:])) if g in telling}
        rated = []
        for at in spots:
            g = grams(w[at : at + len(words)])
            d = 2 * len(g & b) / (len(g) + len(b)) if g else 0
            if d >= 0.8:
                rated.append((at, d))
        for at, d in rated:
            if not any(abs(o - at) < len(words) and (e > d or (e == d and o < at)) for o, e in rated):
                yield "window", at, ends[at] + len(seg[at]) - len(w[at]), ends[min(at + len(words), len(w))], name, no, round(d, 9)


def brute(docs):
    for d, text in docs:
        if text is None:
            continue
        for unit, i, at, part in units(text):
            g = grams(re.sub(r"[\W_]+", " ", part.lower()).split())
            for no, (name, t) in enumerate(licenses.TEMPLATES):
                b = set(licenses.bigrams_of(t))
                if g and b and 2 * len(g & b) / (len(g) + len(b)) >= 0.8:
                    end = at + len(part if unit == "line" else part.rstrip("\n"))
                    yield d, unit, i, at, min(end, len(text)), name, no, round(2 * len(g & b) / (len(g) + len(b)), 9)
        for x in windows(text):
            yield d, *x


def key(r):
    return tuple(map(str, r))


def test_agrees_with_brute_force(spark):
    mit, gpl = licenses.TEMPLATES[2][1], licenses.TEMPLATES[7][1]
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, 70, 70)) + mit[70:].replace(" to ", " to\n")
    docs = [(i, f"some words here\n  {t.upper()}  \nand more") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    docs += [(100, wrapped), (101, "intro text\nof a file\n\n" + wrapped + "\n\nend\nof it"), (102, gpl.replace("any", "some").replace("later", "newer")), (103, mit[:200]), (104, "All rights reserved. " * 40), (None, "All rights reserved."), (105, None), (106, ""), (107, "\n\n\n"), (108, "Licensed under the Apache Licence, Version 2.0."), (109, "word " * 5000 + mit)]
    whole = {n: x for n, x in licenses.TEMPLATES if len(x) > 700}
    for k, x in enumerate(whole.values()):
        lines = [" ".join(x.split()[i : i + 11]) for i in range(0, len(x.split()), 11)]
        docs += [(200 + k, "# head\r\n" + "\r\n".join(" * " + y for y in lines) + "\r\n *\r\n * tail of it\r\n"), (210 + k, "\n\n".join(["Copyright", *x.split(". ")])), (220 + k, "intro " * 50 + x + " outro" * 50)]
    docs += [(230, "see here: " + mit + " and so on for many more words than the notice has, " * 9), (231, "/*\r\n * " + gpl.replace(" under", "\r\n * under") + "\r\n *\r\n * other words\r\n */"), (232, "All rights reserved. " * 200)]
    docs += [docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, dice double")
    got = sorted(map(tuple, licenses.scan(df).collect()), key=key)
    want = sorted(brute(docs), key=key)
    assert got == want and len({r[5] for r in got}) == len({n for n, _ in licenses.TEMPLATES})
    for d, _, _, a, b, *_ in got:
        assert dict(docs)[d][a:b].strip()
    for k, name in enumerate(whole):  # wrapped in a comment, over many paragraphs, inside a long line
        assert all(any(r[0] == d and r[5] == name and r[7] > 0.9 for r in got) for d in (200 + k, 210 + k, 220 + k)), name
    assert any(r[0] == 230 and r[5] == "MIT" for r in got) and any(r[0] == 231 and r[5] == "GPL-3.0" for r in got)
    assert any(r[0] == 232 and r[1] == "line" and r[5] == "proprietary" for r in got) is (2 * 2 / (3 + 2) >= 0.8)
    assert licenses.scan(df.limit(0)).count() == 0


def test_sql_agrees_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries()["op6_license_scan"](spark, sf).collect()), key=key)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = con.sql(oracle_sql()["op6_license_scan"]).fetchall()
    assert got == sorted(rows, key=key) and got
    docs = con.sql("select doc_id, text from documents").fetchall()
    assert got == sorted(brute(docs), key=key)
