import random
import re
from collections import defaultdict

import duckdb
import pytest
from tidemark.llm import linededup

WIDE = re.compile("[฀-໿က-႟ក-៿々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")


def by_hand(text):
    """[(start, end, normalised words)] of a text's pieces, character by character."""
    tokens, at = [], None
    for k, c in enumerate(text + " "):
        if at is not None and (c.isspace() or WIDE.match(c) or WIDE.match(text[k - 1])):
            tokens.append((at, k))
            at = None
        if at is None and not c.isspace():
            at = k
    out = []
    for n, (a, b) in enumerate(tokens):
        new = n == 0
        if n:
            z, gap = tokens[n - 1][1], text[tokens[n - 1][1] : a]
            last, first = text[z - 1], text[a]
            if gap:
                new = "\n" in gap or last in ".!?…।॥؟۔。！？" or (first.isupper() and text[a + 1 : a + 2].islower())
            else:
                ended = last in "。！？।॥؟۔" or (last in "」』”’）" and text[z - 2] in "。！？।॥؟۔")
                new = ended and first not in "」』”’）。！？।॥؟۔"
        if new:
            out.append([a, b, []])
        out[-1][1] = b
        word = re.sub(r"^\W+|\W+$", "", text[a:b].lower())
        if word:
            out[-1][2].append(word)
    return [x for x in out if x[2]]


def brute(docs, unit=7, least=20):
    """{(doc, text): [(start, end)]} by definition."""
    rows = {d for d in docs if d[1] is not None}
    every = []
    for doc_id, text in rows:
        ps = by_hand(text)
        n = [len(p[2]) for p in ps]
        found = set()
        for i in range(len(ps)):
            j = next((j for j in range(i, len(ps)) if sum(n[i : j + 1]) >= unit), None)
            if j is not None:
                found.add((i, j))
        for i, j in found:
            key = tuple(w for p in ps[i : j + 1] for w in p[2])
            every.append((key, (doc_id is None, doc_id or 0, text, ps[i][0]), (doc_id, text), i, j, ps))
    first = {}
    for key, rank, doc, i, j, ps in every:
        first[key] = min(first.get(key, (rank, doc, j)), (rank, doc, j), key=lambda x: x[0])
    gone, begin = defaultdict(set), {}
    for key, rank, doc, i, j, ps in every:
        f_rank, f_doc, f_last = first[key]
        if rank > f_rank:
            if f_doc == doc and f_last >= i:  # the rest of it begins where the earliest occurrence ends
                i = f_last + 1
                begin[doc, i] = ps[f_last][1]
            gone[doc] |= set(range(i, j + 1))
    out = {}
    for doc, some in gone.items():
        ps, spans = by_hand(doc[1]), []
        for k in sorted(some):
            if k - 1 not in some:
                spans.append([begin.get((doc, k), ps[k][0]), 0, 0])
            spans[-1][1] = ps[k][1]
            spans[-1][2] += len(ps[k][2])
        spans = [(a, b) for a, b, n in spans if n >= least]
        if spans:
            out[doc] = spans
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def sentences(rng, n):
    return " ".join(words(rng, rng.randint(2, 12)).capitalize() + rng.choice([".", "!", "?"]) for _ in range(n))


def test_pieces():
    t = "One two three four. Five six.\nSHORT\n  Seven   Eight nine ten, eleven twelve? no stop \n\n--- ***\nend"
    p = linededup.pieces([None, t, "", " \n ", t])
    for text in (1, 4):
        mine = p["text"] == text
        assert [t[a:b] for a, b in zip(p["start"][mine], p["end"][mine])] == ["One two three four.", "Five six.", "SHORT", "Seven", "Eight nine ten, eleven twelve?", "no stop", "end"]
        assert p["n"][mine].tolist() == [4, 2, 1, 1, 5, 2, 1]
    assert set(p["text"].tolist()) == {1, 4}
    q = linededup.pieces(["Ab cd, ef gh.", "«ab  CD ef»\tGH!"])
    assert q["words"][:4].tolist() == q["words"][4:].tolist()


@pytest.mark.parametrize("seed", range(4))
def test_pieces_agree_with_definition(seed):
    rng = random.Random(seed)
    some = ["a", "B", "Ab", "É", "éa", "Éa", ".", "!", "…", ",", "-", "_", " ", " ", "\n", "\t", "\u00a0", "中", "文", "。", "」", "日本", "ß", "İ", "😀", "'", "5", "।", "ไทย", "\x1f"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "a"]
    p = linededup.pieces(texts)
    got = defaultdict(list)
    for k in range(len(p["n"])):
        got[p["text"][k]].append((p["start"][k], p["end"][k], p["n"][k]))
    for k, t in enumerate(texts):
        want = [(a, b, len(w)) for a, b, w in by_hand(t or "")]
        assert got[k] == want, repr(t)


def test_spans_agree_with_brute_force(spark):
    rng = random.Random(6)
    passages = [sentences(rng, 9) for _ in range(6)]
    lines = [words(rng, k) for k in (3, 9, 24)]
    rows = []
    for i in range(220):
        parts = [sentences(rng, rng.randint(0, 5))]
        for _ in range(rng.randint(0, 2)):
            parts += [words(rng, 3), rng.choice(passages), sentences(rng, 2)]
        text = " ".join(parts)
        if rng.random() < 0.5:
            text += "\n" + rng.choice(lines).upper() + "\n"
        rows.append((rng.randint(0, 10_000), text))
    rows += [(None, rows[0][1]), (None, None), (7, None), (8, ""), rows[3], rows[3], (rows[3][0], rows[4][1]), (9000, "ha! " * 100), (9001, "Ho he. " * 70)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "doc_id long, text string, start string, pos int, __key string, row int")
    want = brute(rows)
    # ranks between texts of one id go by hash, so only ids with one text are compared
    one = {d for d in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == d}) == 1}
    got = defaultdict(list)
    for r in linededup.repeated_spans(df).collect():
        got[r.doc_id].append((r.start, r.end))
    assert {k: sorted(set(v)) for k, v in got.items() if k in one} == {k[0]: sorted(v) for k, v in want.items() if k[0] in one}
    out = linededup.remove_repeats(df)
    assert out.columns == df.columns
    back = out.collect()
    assert len(back) == len(rows) and {(r["__key"], r.row, r.pos) for r in back} == {("y", 2, 1)}
    texts = defaultdict(set)
    for r in back:
        texts[r.doc_id].add(r.text)
    for (d, t), spans in want.items():
        if d in one:
            assert texts[d] == {linededup.cut_spans(t, [s[0] for s in spans], [s[1] for s in spans])}
    assert linededup.repeated_spans(df.limit(0)).count() == 0 and linededup.remove_repeats(df.limit(0)).count() == 0


def test_pasted_passage_goes_and_clean_texts_stay(spark):
    rng = random.Random(9)
    passage = sentences(rng, 10)
    rows = [(i, sentences(rng, 12) + (" " + words(rng, 2) + " " + passage + " " + sentences(rng, 6) if i % 10 == 0 else "")) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in linededup.remove_repeats(df).collect()}
    for i, t in rows:
        if i == 0 or i % 10:
            assert out[i] == t
        else:
            assert len(out[i].split()) <= len(t.split()) - len(passage.split()) + 3


def test_table(spark, sf_dir):
    from tidemark.llm.queries import queries

    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    want = sorted((d, a, b) for (d, _), spans in brute(docs).items() for a, b in spans)
    got = queries()["op8_line_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == want and len(want) > 5


def test_a_short_line_that_many_share_touches_none(spark):
    rng = random.Random(3)
    line = words(rng, 12)
    rows = [(i, sentences(rng, 4) + "\n" + line + "\n" + sentences(rng, 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.repeated_spans(df).count() == 0
    assert linededup.repeated_spans(df, least=12).count() == 59  # asked for, it goes


def test_passages_of_short_pieces_go(spark):
    rng = random.Random(12)
    short = lambda n: [words(rng, rng.randint(1, 3)).upper() + rng.choice(["!!", ".", "\n"]) for _ in range(n)]
    line = lambda n: "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(n)) + rng.choice("。！？")
    some = [short(40), [line(rng.randint(1, 9)) for _ in range(14)] + [line(9)], [words(rng, 3) + ".", words(rng, 4) + ".", words(rng, 5) + "."] + [words(rng, 3) + "." for _ in range(6)]]
    rows, planted = [], []
    for i in range(60):
        k = i % 4
        own = [[line(5) for _ in range(10)], [line(5) for _ in range(10)]] if k == 1 else [short(12), short(12)]
        glue = "" if k == 1 else " "
        if k < 3:
            a = glue.join(own[0]) + glue
            rows.append((i, a + glue.join(some[k]) + glue + glue.join(own[1])))
            planted.append((i, k, len(a), len(a) + len(glue.join(some[k]))))
        else:
            rows.append((i, glue.join(own[0] + own[1])))
    rows += [(100, "\n".join(some[0])), (101, "ha! " * 100), (102, rows[3][1])]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = defaultdict(set)
    for r in linededup.repeated_spans(df).collect():
        assert r.words >= 8 and not gone[r.doc_id] & set(range(r.start, r.end))
        gone[r.doc_id] |= set(range(r.start, r.end))
    # by definition, without units: a character goes if it stands in a planted passage that an earlier document has
    for i, k, a, b in planted:
        want = {p for p in range(a, b) if i >= 4 and not texts[i][p].isspace()}
        left = want - gone[i]
        assert {p for p in gone[i] if not texts[i][p].isspace()} <= want and len(texts[i][min(left, default=b) : b].split()) <= 6, (i, k)
    assert all(not gone[i] for i in range(3, 60, 4))
    for i in (100, 102):
        assert {p for p in range(len(texts[i])) if not texts[i][p].isspace()} <= gone[i]
    assert gone[101] and min(gone[101]) >= 27  # the first paragraph, 7 words, stays




def test_dotted_names_pass_through(spark):
    line = "a line that is long enough to count as a passage of many words, more than twenty of them in all, so that it goes"
    rows = [(1, line + "\nfirst", 1), (2, line + "\nsecond", 2), (None, None, 3)]
    got = linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"))
    assert got.columns == ["doc_id", "text", "a.b"]
    assert {r["a.b"]: r.text for r in got.collect()} == {1: line + "\nfirst", 2: "second", 3: None}
