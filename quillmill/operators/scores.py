"""Scores of a text on five axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import lexicons as L
from quillmill.functions.text import any_of, contains_word, count_of, first_words, sentences, tokens, word_count


def _lits(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def _present(text: Column, parts: list[str], each: int) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + F.when(F.instr(text, p) > 0, each).otherwise(0)
    return total


def punch(text: Column) -> Column:
    """A1: feeling, contrast and address in the first fifty words; a short first or second sentence."""
    head = F.lower(first_words(text, 50))
    feeling = F.least(F.size(F.array_intersect(tokens(head), _lits(L.EMOTIONAL))) * 10, F.lit(30))
    contrast = F.lit(0)
    for w in L.CONTRAST_OPENING:
        contrast = contrast + F.when(contains_word(head, w), 15).otherwise(0)
    address = F.when((F.instr(head, " you ") > 0) | head.startswith("you"), 20).otherwise(0)
    parts = F.slice(sentences(text), 1, 2)
    short = F.when(F.exists(parts, lambda s: word_count(s) < 15), 20).otherwise(0)
    return F.when(F.size(parts) == 0, 0).otherwise(F.least(feeling + F.least(contrast, F.lit(30)) + address + short, F.lit(100)))


def identity(text: Column) -> Column:
    """A2: phrases of belonging and of aspiration, once a bonus for a stake."""
    low = F.lower(text)
    stake = F.when(low.rlike(any_of(L.IDENTITY_COST)), 20).otherwise(0)
    return F.least(_present(low, L.TRIBAL, 12) + _present(low, L.ASPIRATION, 8) + stake, F.lit(100))


def tension(text: Column) -> Column:
    """A3: contrasts, negations, paradox, question; a blamed party within fifty characters of either.

    The window is one expression: a term, and a negation or contrast no further than the window
    allows on either side of the term's start.
    """
    low = F.lower(text)
    contrast, negation = F.lit(0), F.lit(0)
    for w in L.CONTRAST_TENSION:
        contrast = contrast + count_of(low, f" {w} ")
    for w in L.NEGATIONS:
        negation = negation + count_of(low, w)
    paradox = F.when(low.rlike("the more .{5,30}, the (less|more)"), 20).otherwise(0)
    question = F.when(low.rlike(r"\?.*you (think|believe|assume)"), 20).otherwise(0)
    blame = F.when(blamed(low), 15).otherwise(0)
    return F.least(F.least(contrast * 12, F.lit(36)) + F.least(negation * 8, F.lit(24)) + paradox + question + blame, F.lit(100))


def blamed(low: Column, terms: list[str] = L.BLAME, reach: int = 50) -> Column:
    """Whether a blame term has a negation or contrast within ``reach`` characters before or from its start.

    The text is cut at the terms (each search starts where the last ended, or fails at once); a fold carries the last ``reach`` characters, so the cost is
    linear in the text however many terms it has.
    """
    any_term = "(?:" + "|".join(terms) + r")\b"
    pattern = rf"(?sU)\G(.*?)\b(?={any_term})(?=(.{{0,{reach}}}))({any_term})"
    between, ahead, term = (F.regexp_extract_all(low, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
    parts = F.arrays_zip(between.alias("b"), ahead.alias("a"), term.alias("t"))
    zero = F.struct(F.lit("").alias("carry"), F.lit(False).alias("hit"))

    def step(s: Column, x: Column) -> Column:
        before = F.right(F.concat(s["carry"], x["b"]), F.lit(reach))
        return F.struct(F.concat(before, x["t"]).alias("carry"), (s["hit"] | _tense(F.concat(before, x["a"]))).alias("hit"))

    return F.aggregate(parts, zero, step, lambda s: s["hit"])


def _tense(context: Column) -> Column:
    hit = F.lit(False)
    for n in L.NEGATIONS:
        hit = hit | (F.instr(context, n) > 0)
    for w in L.CONTRAST_TENSION:
        hit = hit | contains_word(context, w)
    return hit


def quotability(text: Column) -> Column:
    """A4: the best sentence on its own."""
    feeling, concrete, action = _lits(L.EMOTIONAL), _lits(L.CONCRETE_NOUNS), _lits(L.ACTION_VERBS)

    def score(s: Column) -> Column:
        low, n = F.lower(s), word_count(s)
        ts = tokens(low)
        size = F.when(n.between(8, 20), 30).when(n < 8, 15).otherwise(0)
        free = F.when(low.rlike("^(" + "|".join(L.CONTEXT_STARTERS) + ")"), 0).otherwise(20)
        felt = F.when(F.arrays_overlap(ts, feeling), 25).otherwise(0)
        first = F.regexp_extract(low, r"^(\S+)", 1)
        urge = F.when((F.instr(low, " you ") > 0) | first.isin(L.IMPERATIVE_STARTERS), 25).otherwise(0)
        vague = F.when(~F.arrays_overlap(ts, concrete) & ~F.arrays_overlap(ts, action), 20).otherwise(0)
        return F.greatest(size + free + felt + urge - vague, F.lit(0))

    long_ = F.filter(sentences(text), lambda s: F.length(s) > 10)
    return F.least(F.coalesce(F.array_max(F.transform(long_, score)), F.lit(0)), F.lit(100))


def novelty_from_cosine(cosine: Column) -> Column:
    """A5: distance from the usual, between 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(20.0) + (F.lit(1.0) - cosine) * 100)).cast("int")


def axis_scores(texts: DataFrame, text: str, novelty: Column | None = None) -> DataFrame:
    """All axes and their total; without a model novelty is 40; little edge lowers it."""
    raw = F.lit(40) if novelty is None else novelty
    t = F.col(text)
    df = texts.withColumns({"punch": punch(t), "identity": identity(t), "tension": tension(t), "quotability": quotability(t), "__raw": raw})
    df = df.withColumn("novelty", F.when(F.col("identity") + F.col("tension") < 60, (F.col("__raw") * 0.6).cast("int")).otherwise(F.col("__raw").cast("int")))
    return df.withColumn("total", F.col("punch") + F.col("identity") + F.col("tension") + F.col("quotability") + F.col("novelty")).drop("__raw")


def centroid_novelty(vectors: DataFrame, id_col: str, vector: str, group: str) -> DataFrame:
    """A5 per group: cosine of each vector with its group's mean direction, and the score.

    One average a position (vectors have one length), so partial sums are combined map-side in one pass and no group is gathered.
    """
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = vectors.withColumn("__u", F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)))
    first = unit.filter("__u is not null").select(F.size("__u").alias("n")).first()
    size = first.n if first else 0
    mean = unit.filter("__u is not null").groupBy(group).agg(F.array(*[F.avg(F.get("__u", F.lit(i))) for i in range(size)]).cast("array<double>").alias("__m"))
    mnorm = F.sqrt(F.aggregate(F.transform("__m", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    dot = F.aggregate(F.zip_with("__u", "__m", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = unit.join(mean, group).withColumn("cosine", F.when(mnorm > 0, dot / mnorm).otherwise(F.lit(0.0)))
    return out.select(id_col, group, "cosine", novelty_from_cosine(F.col("cosine")).alias("novelty"))
