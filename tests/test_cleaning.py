"""Cleaning operators against plain Python versions."""

import re
from collections import Counter

from pyspark.sql import functions as F

from quillmill.functions import lexicons as L
from quillmill.operators import cleaning as T


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_encoding(spark):
    t = "“a” ‘b’ –—…\xa0\xadﬁt ﬂy�"
    exp = t
    for a, b in L.ENCODING:
        exp = exp.replace(a, b)
    assert one(spark, t, T.fix_encoding) == exp


def test_page_numbers(spark):
    lines = ["12", "Page 3 of 9", "- 4 -", "iv", "mix", "I", "a line", "", "12a", "12345"]
    exp = [x for x in lines if not any(re.fullmatch(p, x, re.I) for p in L.PAGE_NUMBER_LINES)]
    assert one(spark, "\n".join(lines), T.drop_page_numbers) == "\n".join(exp)


def test_repeated_lines(spark):
    rows = [("a", "\n".join(["Head", "x1"] * 3 + [f"line {i}" for i in range(50)])), ("b", "Head\nHead\nHead"), ("c", None), ("d", "\n".join(["abc"] * 60 + ["Abcd "] * 2 + ["ABCD"]))]
    out = {r.id: r.cleaned for r in T.drop_repeated_lines(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}

    def brute(t):
        ls = t.split("\n")
        if len(ls) < 50:
            return t
        n = Counter(x.strip().lower() for x in ls if 3 < len(x.strip()) < 100)
        often = {k for k, v in n.items() if v >= 3 and len(k.split()) < 10}
        return "\n".join(x for x in ls if x.strip().lower() not in often)

    assert out == {i: (brute(t) if t is not None else None) for i, t in rows}


def test_contents_fold(spark):
    def brute(t):
        inside, strange, out = False, 0, []
        for x in t.split("\n"):
            if any(re.fullmatch(p, x.strip().lower()) for p in L.TOC_START):
                inside, strange = True, 0
            elif not inside:
                out.append(x)
            elif re.fullmatch(L.TOC_LINE, x):
                strange = 0
            elif x.strip():
                strange += 1
                if strange >= 5:
                    inside = False
                    out.append(x)
        return "\n".join(out)

    toc = "Contents\nChapter One ........ 5\n\nChapter Two ........ 12\n"
    cases = ["a\nb", toc + "a\nb\nc\nd\ne\nf", toc + "a\nb\n" + "Chapter Three .... 9\nc\nd\ne\nf\ng\nh", toc, "x\n" + toc + "a\n\nb\n\nc", "Contents\nContents\n1\n2\n3\n4\n5\n6", ""]
    for c in cases:
        assert one(spark, c, T.drop_contents) == brute(c), c


def test_front_and_back_matter(spark):
    body = [f"line {i}" for i in range(60)]
    text = "\n".join(body[:3] + ["Acknowledgments", "thanks", "Chapter 1"] + body[3:])
    assert one(spark, text, T.cut_acknowledgments) == "\n".join(body[:3] + ["Chapter 1"] + body[3:])
    alone = "\n".join(body[:3] + ["Acknowledgements"] + body[3:])
    assert one(spark, alone, T.cut_acknowledgments) == "\n".join(body)
    late = "\n".join(body[:20] + ["Acknowledgments"] + body[20:])
    assert one(spark, late, T.cut_acknowledgments) == late
    long_ = [f"line {i}" for i in range(100)]
    at = list(long_)
    at[85] = " Index "
    assert one(spark, "\n".join(at), T.cut_back_matter) == "\n".join(at[:85])
    before = list(long_)
    before[84] = "Index"
    assert one(spark, "\n".join(before), T.cut_back_matter) == "\n".join(before)
    assert one(spark, "\n".join(at[1:]), T.cut_back_matter) == "\n".join(at[1:])


def test_blanks_articles_transcripts(spark):
    assert one(spark, "a \t\xa0b  \n\n\n\nc ", T.collapse_blanks) == "a b\n\nc"
    assert one(spark, " Hi  there\nShare this: a b\nkeep\nTags: x, y\nRelated posts: q\n\nend Comments (3)", T.clean_article) == "Hi there\n\nkeep\n\n\n\nend"
    assert one(spark, "[Music]\n0:12\nsome [applause] words\n1:02:03\n12:99 no", T.clean_transcript) == "some  words\n\n12:99 no"


def test_pipeline_counts(spark):
    df = spark.createDataFrame([("a", "“x”\n12\ntext ﬁ\n\n\n\nend", 1), ("b", "", 0), ("c", None, 3)], "id string, t string, p int")
    rows = {r.id: r for r in T.cleaned(df, "id", "t", "p").collect()}
    assert rows["a"].cleaned == '"x"\ntext fi\n\nend' and rows["a"].removed["page_numbers"] == 3
    assert rows["b"].removed_share == 0 and rows["c"].cleaned is None
    conf = spark.range(1).select(T.confidence(F.lit(0.35), F.lit(50), F.lit(1), F.lit(2))).first()[0]
    assert abs(conf - 0.26) < 1e-9
