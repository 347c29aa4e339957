import hashlib
import re
import zlib

from sheafwork.llm.sentence_spans import sentences_of, without_spans
from tests.llm.helpers import corpus, documents, empty, lower

SPACE = " \t\n\r\x0b\x0c"


def cut(t):
    edges, i = [0], 0
    while i < len(t):
        if t[i] == "\n" or i and t[i - 1] in ".!?" and t[i] in SPACE:
            while i < len(t) and t[i] in SPACE:
                i += 1
            edges.append(i)
        else:
            i += 1
    if edges[-1] != len(t):
        edges.append(len(t))
    out = []
    for a, b in zip(edges, edges[1:]):
        words = [(m.start() + a, m.end() + a) for m in re.finditer(f"[^{SPACE}]+", t[a:b])]
        start, n = a, 0
        for k, (x, y) in enumerate(words):
            n += 1
            if len(words) > 40 and k + 1 < len(words) and (n == 40 or zlib.crc32(lower(t[x:y]).encode()) % 16 == 0):
                out.append((start, words[k + 1][0]))
                start, n = words[k + 1][0], 0
        if words:
            out.append((start, b))
    return out


def expected(rows):
    first, gone = {}, {}
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        t = t or ""
        parts = [[w for w in re.split(f"[{SPACE}]+", lower(t[a:b])) if w] for a, b in cut(t)]
        for k in range(len(parts)):
            e = k + 2
            while e <= len(parts) and sum(map(len, parts[k:e])) < 24:
                e += 1
            if e <= len(parts):
                key = str(parts[k:e])
                if first.setdefault(key, (i, k)) != (i, k):
                    gone.setdefault(i, set()).update(range(k, e))
    out = []
    for i, t in rows:
        t = t or ""
        parts, kept, at = cut(t), "", 0
        for k in sorted(gone.get(i, ())):
            kept += t[at : parts[k][0]]
            at = parts[k][1]
        kept += t[at:]
        out.append((str(i), len(parts), len(gone.get(i, ())), len(t.encode()) - len(kept.encode()), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def test_report_matches_brute_force(spark):
    rows = corpus(9) + [(700, "no marks at all just words " * 30), (701, "so no marks at all just words " * 30)]
    rows += [rows[0], (None, rows[4][1])]
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.bytes_removed, r.kept_sha256, r.kept) for r in without_spans(documents(spark, rows)).collect())
    want = expected(rows)
    assert got == want and any(w[2] for w in want)


def removed_runs(texts, weigh, least, parts_of):
    """Parts of later occurrences of all runs, of any length, that weigh enough."""
    first, gone = {}, set()
    for i, t in enumerate(texts):
        parts = parts_of(t)
        for a in range(len(parts)):
            for e in range(a + 1, len(parts) + 1):
                if sum(weigh(p) for p in parts[a:e]) >= least and first.setdefault(str([p[0] for p in parts[a:e]]), (i, a)) != (i, a):
                    gone.update((i, k) for k in range(a, e))
    return gone


def test_all_runs_of_sentences_without_a_minimum_of_words(spark):
    from sheafwork.llm import queries

    tail = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18. x1 x2 x3 x4 x5 x6 x7. y1 y2 y3 y4 y5."
    rows = [(1, f"Own start here. {tail} Its own end."), (2, f"Another one here. {tail} And another end of it."), (3, "Short one. And two. Alone is this."), (4, "Not this. Short one. And two.")]
    gone = removed_runs([t for _, t in rows], lambda p: 1, 2, lambda t: [(t[a:b].strip(), 1) for a, b in cut(t)])
    seen = {}
    for r in queries.span_report(documents(spark, rows), **how_of(queries.op10_sentence_spans)).collect():
        seen[r.doc_id] = r.n_removed
    assert seen == {i + 1: sum(k[0] == i for k in gone) for i in range(4)} == {1: 0, 2: 3, 3: 0, 4: 2}


def test_passages_without_marks(spark):
    import random

    from sheafwork.llm import queries
    from sheafwork.llm import sentence_spans as S

    r, rows = random.Random(5), []
    words = lambda n: " ".join("".join(r.choice("abcdeiorstn") for _ in range(r.randint(2, 7))) for _ in range(n))
    for k in range(40):
        passage = words(50)
        rows += [(2 * k, f"{words(60)} {passage} {words(60)}"), (2 * k + 1, f"{words(45)} {passage} {words(70)}. {words(6)}.")]
    rows += [(100, f"{rows[0][1]}. Two more. {words(50)}"), (101, f"Two more. {rows[2][1]}. Two more. {words(44)}")]
    out = {x.doc_id: x for x in queries.span_report(documents(spark, rows), **how_of(queries.op10_sentence_spans)).collect()}
    for k in range(40):
        assert out[2 * k].n_removed == 0 and out[2 * k + 1].bytes_removed > 36 * 3
    parts = lambda t: [(t[a:b].strip().lower(), piece) for a, b, piece in S.parts_of(t.encode(), True)]
    gone = removed_runs([t for _, t in rows], lambda p: 2 if p[1] else 5, 10, parts)
    assert {i: x.n_removed for i, x in out.items()} == {i: sum(g[0] == k for g in gone) for k, (i, _) in enumerate(rows)}


def how_of(query):
    """What a query passes to span_report."""
    from unittest.mock import patch

    with patch("sheafwork.llm.queries.table"), patch("sheafwork.llm.queries.span_report") as asked:
        query(None, "")
    return asked.call_args.kwargs


def test_sentences():
    assert [b"One. Two?\nThree"[a:b] for a, b in sentences_of(b"One. Two?\nThree")] == [b"One. ", b"Two?\n", b"Three"]
    assert sentences_of(b"") == sentences_of(b" \n ") == []


def test_empty_table(spark):
    assert without_spans(empty(spark)).count() == 0


def test_later_spans_across_batches():
    import random

    import pyarrow as pa

    from sheafwork.llm import sentence_spans as S

    r = random.Random(3)
    for ids, kind in ((range(3), pa.int64()), ("abc", pa.string())):
        rows = [(r.randint(0, 4), r.randint(0, 1), r.choice([None, *ids]), r.randint(0, 1), r.randint(0, 2), 2, False) for _ in range(300)]
        rows.sort(key=lambda x: (x[:2], x[2] is not None, x[2] or ids[0], x[3:5]))
        want, lead = [], {}
        for x in rows:
            if lead.setdefault(x[:2], x[2:5]) != x[2:5]:
                want.append(x[2:6])
        batches, at = [], 0
        while at < len(rows):
            some = rows[at : at + r.randint(1, 40)]
            at += len(some)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), [pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.int32(), pa.bool_()])], S.NAMES))
        assert [tuple(x.values()) for b in S.later_spans(iter(batches)) for x in b.to_pylist()] == want


def test_text_identifiers(spark):
    rows = [("b", "One here now. Two there then. Three."), ("a", "Zero. One here now. Two there then."), (None, "Nothing. One here now. Two there then.")]
    got = {x.doc_id: x.n_removed for x in without_spans(spark.createDataFrame(rows, "doc_id string, text string"), words=0, pieces=5).collect()}
    assert got == {None: 0, "a": 2, "b": 2}
