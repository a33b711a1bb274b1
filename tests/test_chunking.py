"""Chunkers against ordered Python loops."""

import random
import re

from quillmill.functions import lexicons as L
from quillmill.operators import chunking as C

EARLY = re.compile("|".join(L.EARLY_CLOSE), re.I)


def brute(text, least=250, most=900, hard=1100):
    ps = [p.strip() for p in text.split("\n\n") if p.strip()]
    out, cur, n, first = [], [], 0, 0
    for i, p in enumerate(ps):
        cur.append(p)
        n += len(p.split())
        close, early = n >= hard, None
        if not close and n >= least:
            m = EARLY.search(p.lower())
            early = m[0] if m else None
            close = bool(m) or n >= most
        if close:
            out.append([n, first, i, early is not None, early])
            cur, n, first = [], 0, i + 1
    if cur:
        if n >= least or not out:
            out.append([n, first, len(ps) - 1, False, None])
        else:
            out[-1] = [out[-1][0] + n, out[-1][1], len(ps) - 1, False, None]
    return [(w, a, b, e, r, "\n\n".join(ps[a : b + 1])) for w, a, b, e, r in out]


def test_paragraph_chunks(spark):
    r = random.Random(1)
    texts = ["", "   ", "one", None]
    for n in (249, 250, 899, 900, 901, 1100):
        texts.append(" ".join(["w"] * n))
    for _ in range(60):
        ps = [" ".join(["word"] * r.choice([3, 50, 249, 250, 400, 900, 1200])) + r.choice(["", " in other words", " Ultimately"]) for _ in range(r.randrange(1, 9))]
        texts.append("\n\n".join(ps))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for x in C.paragraph_chunks(df, "id", "t").orderBy("id", "index").collect():
        got.setdefault(x.id, []).append((x.word_count, x.start_paragraph, x.end_paragraph, x.closed_early, x.early_close_reason, x.text))
    for i, t in enumerate(texts):
        assert got.get(i, []) == (brute(t) if t is not None else []), i


def test_window_chunks(spark):
    texts = [" ".join(str(i) for i in range(n)) for n in (0, 1, 2000, 2001, 3900, 3901, 6000)]
    df = spark.createDataFrame([(i, t, f"T{i}") for i, t in enumerate(texts)], "id int, t string, title string")
    got = {}
    for x in C.window_chunks(df, "id", "t", "title").orderBy("id", "part").collect():
        got.setdefault(x.id, []).append((x.chunk, x.chunk_title))
    for i, t in enumerate(texts):
        ws, exp, start = t.split(), [], 0
        if len(ws) <= 2000:
            exp = [t]
        else:
            while start < len(ws):
                end = min(start + 2000, len(ws))
                exp.append(" ".join(ws[start:end]))
                start = end - 100
                if start >= len(ws) - 100:
                    break
        assert [c for c, _ in got[i]] == exp
        assert got[i][0][1] == (f"T{i} (Part 1/{len(exp)})" if len(exp) > 1 else f"T{i}")
