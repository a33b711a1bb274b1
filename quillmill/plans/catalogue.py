"""The registered queries over the driver's tables; their oracles are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import word_count
from quillmill.operators import admission as A
from quillmill.operators import calendar as K
from quillmill.operators import chunking as C
from quillmill.operators import cleaning as T
from quillmill.operators import elite as E
from quillmill.operators import relational as R
from quillmill.operators import planning as N
from quillmill.operators import rendering as M
from quillmill.operators import rules as U
from quillmill.operators import scores as S
from quillmill.operators import topk as W
from quillmill.operators import urls as H
from quillmill.plans import parameters as P
from quillmill.plans.oracle import oracle_sql
from quillmill.plans.pipeline import passages
from quillmill.runtime import ship, spread, table
from quillmill.operators.enrich import enriched, retry_after
from quillmill.sources.page_blocks import page_text
from quillmill.sources.text_files import archives, text_blocks

ship(__name__)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents")).filter("text is not null")


def _scans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraction_results").dropDuplicates(["doc_id"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["doc_id", "chunk_index"]).withColumn("wc", word_count(F.col("text")))


def _atoms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "content_atoms").dropDuplicates(["id", "updated_at", "virality_score"])


def _reservoir(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "content_reservoir").dropDuplicates(["id"])


def _ingest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_ingest").dropDuplicates(["id"])


# Cleaning


@query
def clean_encoding_whitespace(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.collapse_blanks(T.fix_encoding(F.col("text")))).alias("cleaned_md5"))


@query
def drop_page_number_lines(s, d):
    return _scans(s, d).select("doc_id", F.md5(T.drop_page_numbers(F.col("raw_text"))).alias("cleaned_md5"))


@query
def drop_repeated_lines(s, d):
    out = T.drop_repeated_lines(_docs(s, d), "doc_id", "text", min_lines=20, min_count=2)
    return out.select("doc_id", F.md5("cleaned").alias("cleaned_md5"))


@query
def contents_fold(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.drop_contents(F.col("text"))).alias("cleaned_md5"))


@query
def acknowledgments_cut(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.cut_acknowledgments(F.col("text"))).alias("cleaned_md5"))


@query
def back_matter_truncate(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.cut_back_matter(F.col("text"), min_lines=20)).alias("cleaned_md5"))


@query
def article_clean(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.clean_article(F.col("text"))).alias("cleaned_md5"))


@query
def transcript_clean(s, d):
    return _reservoir(s, d).filter("raw_text is not null").select("id", F.md5(T.clean_transcript(F.col("raw_text"))).alias("cleaned_md5"))


@query
def cleaning_pipeline(s, d):
    c = T.cleaned(_scans(s, d).filter("raw_text is not null"), "doc_id", "raw_text", "pages")
    conf = T.confidence(F.col("removed_share"), F.length("cleaned"), F.col("pages"), F.size("warnings"))
    return c.select("doc_id", F.length("cleaned").alias("chars"), F.coalesce(F.col("removed")["page_numbers"], F.lit(0)).alias("page_number_chars"), F.round("removed_share", 6).alias("removed_share"), F.round(conf, 6).alias("clean_confidence"))


# Chunking


@query
def chunk_paragraph_fold(s, d):
    c = C.paragraph_chunks(_docs(s, d), "doc_id", "text")
    return c.withColumn("text_md5", F.md5("text")).drop("text")


@query
def chunk_stats(s, d):
    return C.chunk_stats(C.paragraph_chunks(_docs(s, d), "doc_id", "text"), "doc_id")


@query
def chunk_overlap_windows(s, d):
    c = C.window_chunks(_docs(s, d).select("doc_id", "text", "title"), "doc_id", "text", "title", size=400, overlap=50)
    return c.select("doc_id", F.col("part").cast("bigint").alias("part"), F.col("parts").cast("bigint").alias("parts"), F.md5("chunk").alias("chunk_md5"), "chunk_title")


# Rules and scores


@query
def signal_families(s, d):
    c = _chunks(s, d)
    return c.select("doc_id", "chunk_index", F.array_join(U.signals(F.col("text"), P.CORPUS_SIGNALS), ",").alias("signals"))


@query
def rule_filter_decision(s, d):
    c = _chunks(s, d)
    return c.select("doc_id", "chunk_index", U.rule_decision(F.col("text"), F.col("wc"), families=P.CORPUS_SIGNALS).alias("decision"))


@query
def drop_reason_histogram(s, d):
    c = _chunks(s, d).select(U.rule_decision(F.col("text"), F.col("wc"), families=P.CORPUS_SIGNALS).alias("decision"))
    return c.groupBy("decision").agg(F.count(F.lit(1)).alias("chunks"))


@query
def quotation_shares(s, d):
    return _docs(s, d).select("doc_id", F.round(U.quotation_share(F.col("text")), 9).alias("quoted"))


@query
def opening_gate(s, d):
    return _chunks(s, d).select("doc_id", "chunk_index", U.opening_gate(F.col("text")).alias("passes"))


def _scored(s, d) -> DataFrame:
    # texts are judged where they are read; what is shuffled to count re-deliveries once is scores
    gated = spread(table(s, d, "chunks")).filter(U.opening_gate(F.col("text")))
    scored = S.axis_scores(gated, "text").select("doc_id", "chunk_index", "punch", "identity", "tension", "quotability", "novelty", "total")
    return scored.dropDuplicates(["doc_id", "chunk_index"])


@query
def axis_scores(s, d):
    return _scored(s, d)


@query
def elite_selection(s, d):
    """Gate, score, choose: the flagship."""
    chosen = E.elite(_scored(s, d), "doc_id", "chunk_index", P.ELITE_AXES, fill_to=1, fill_total=60, fill_edge=0)
    return chosen.select("doc_id", "chunk_index", "total", "adjusted_total", F.array_join("axes", ",").alias("axes"))


@query
def elite_defaults(s, d):
    """E1-E3 with all five axes and the default quotas, over shelves of many documents' chunks."""
    place = F.concat_ws("-", "doc_id", F.lpad(F.col("chunk_index").cast("string"), 9, "0"))
    shelves = _scored(s, d).withColumn("shelf", F.left("doc_id", F.lit(1))).withColumn("place", place)
    return E.elite(shelves, "shelf", "place").select("shelf", "place", "total", "adjusted_total", F.array_join("axes", ",").alias("axes"))


@query
def elite_stats(s, d):
    gated = _chunks(s, d).select("doc_id", "chunk_index", U.opening_gate(F.col("text")).alias("passes"))
    return E.selection_stats(gated, elite_selection(s, d), "doc_id", few=2)


@query
def passage_pipeline(s, d):
    """Scanned books from raw text to chosen passages."""
    out = passages(_scans(s, d), "doc_id", "raw_text", "pages", P.CORPUS_SIGNALS, P.ELITE_AXES, least=60, most=300, hard=400)
    return out.select("doc_id", "index", "word_count", "total", "adjusted_total", F.array_join("axes", ",").alias("axes"))


@query
def novelty_scores(s, d):
    n = S.centroid_novelty(table(s, d, "embeddings"), "vec_id", "embedding", "label")
    return n.select("vec_id", "label", F.round("cosine", 6).alias("cosine"), "novelty")


# Admission


@query
def dedup_first_wins(s, d):
    return A.first_by_content(_ingest(s, d).select("id", "raw_content"), "raw_content", [F.col("id")]).select("id")


@query
def admission_two_keys(s, d):
    rows = _ingest(s, d).filter("raw_content is not null").select("id", "raw_content", "source_identifier")
    return A.two_key_admission(rows, "raw_content", "source_identifier", "id").select("id")


@query
def admission_against_history(s, d):
    rows = _ingest(s, d).select("id", "status", F.md5("raw_content").alias("c"), H.url_key(F.col("source_url")).alias("u"))
    return A.not_in_history(rows.filter("status = 'PENDING'"), rows.filter("status <> 'PENDING'"), [("c", "c"), ("u", "u")]).select("id")


@query
def reservoir_transfer(s, d):
    r = _reservoir(s, d).filter(F.col("source_type").isin("BOOK", "BLOG", "YOUTUBE"))
    return r.select("id", F.concat_ws(":", F.lit("reservoir"), "source_id", F.col("chunk_index").cast("string")).alias("source_identifier"), F.lit("PENDING").alias("status"), (F.col("times_used") + 1).alias("times_used"))


@query
def validation_reasons(s, d):
    t = _ingest(s, d)
    extra = [("no_address", F.coalesce(F.col("source_url") == "", F.lit(True)))]
    return t.select("id", F.array_join(A.validation_reasons(F.col("raw_content"), 300, 5000, extra=extra), ",").alias("reasons"))


@query
def rejection_records(s, d):
    t = _ingest(s, d).withColumn("why", A.validation_reasons(F.col("raw_content"), 300, 5000))
    return A.rejection_records(t, "id", "raw_content", "why", "VALIDATION").select("id", "phase", "reasons")


@query
def next_chunk_index(s, d):
    r = _reservoir(s, d)
    out = A.next_index(r.filter("status = 'AVAILABLE'").select("id", "source_id"), r.filter("status <> 'AVAILABLE'"), "source_id", "chunk_index", F.col("id"))
    return out.select("id", "source_id", "next_index")


@query
def slug_collisions(s, d):
    names = _docs(s, d).select("doc_id", "author").filter("author is not null")
    return A.resolved_slugs(names, "author", F.col("doc_id")).select("doc_id", "unique_slug")


@query
def import_routing(s, d):
    i = _ingest(s, d).withColumn("key", H.url_key(F.col("source_url")))
    new = i.filter("status = 'PENDING'").select("id", "key", F.col("source_type").alias("author"), F.col("raw_title").alias("title"))
    old = i.filter("status = 'PASSED'")
    authors = s.createDataFrame([("BLOG",), ("REDDIT",), ("YOUTUBE",)], "author string")
    titles = old.filter("raw_title is not null").select(F.col("source_type").alias("author"), F.col("raw_title").alias("title"))
    out = A.routed(new, "key", "id", old.filter("key is not null"), authors, "author", titles, "title")
    return out.select("id", "outcome")


# Addresses


@query
def url_dedup_key(s, d):
    return _ingest(s, d).filter("source_url is not null").select("id", H.url_key(F.col("source_url")).alias("key"))


@query
def url_untracked(s, d):
    i = _ingest(s, d).filter("source_url is not null").withColumn("key", H.url_key(F.col("source_url")))
    return A.not_in_history(i.filter("status = 'PENDING'"), i.filter("status = 'PASSED'"), [("key", "key")]).select("id", "key")


@query
def url_titles(s, d):
    return _ingest(s, d).filter("source_url like 'http%'").select("id", H.host(F.col("source_url")).alias("host"), H.title_of_url(F.col("source_url")).alias("title"))


@query
def url_pattern_match(s, d):
    return _ingest(s, d).filter("source_url is not null").select("id", H.first_pattern(F.col("source_url"), P.URL_PATTERNS).alias("owner"))


# Filters


@query
def pending_newest_first(s, d):
    return _ingest(s, d).filter("status = 'PENDING'").orderBy(F.desc("ingested_at"), "id").select("id", "source_type").limit(50)


@query
def pending_oldest_first(s, d):
    return _ingest(s, d).filter("status = 'PENDING'").orderBy("ingested_at", "id").select("id", "source_type").limit(100)


@query
def batch_sizes(s, d):
    return _ingest(s, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "PASSED").alias("passed"))


@query
def json_path_filter(s, d):
    words = F.get_json_object("raw_metadata", "$.words").cast("int")
    return _ingest(s, d).filter(words >= 200).select("id", words.alias("words"))


@query
def posts_by_score(s, d):
    score = F.coalesce(F.get_json_object("raw_metadata", "$.score").cast("int"), F.lit(0))
    real = ~F.col("raw_content").isin("[removed]", "[deleted]") & (F.length("raw_content") >= 300)
    end = F.lit(P.AS_OF).cast("timestamp")
    recent = F.col("ingested_at") >= end - F.expr("interval 60 days")
    return _ingest(s, d).filter((F.col("source_type") == "REDDIT") & (score >= 10) & real & recent).select("id", score.alias("score"))


@query
def array_containment(s, d):
    return _atoms(s, d).filter(R.contains_all(F.col("format_fit"), ["REEL"]) & F.col("deleted_at").isNull()).select("id", F.nanvl("virality_score", F.lit(None)).alias("virality_score")).distinct()


@query
def secondary_pillar_containment(s, d):
    return _atoms(s, d).filter(R.contains_all(F.col("secondary_pillars"), ["PHILOSOPHY"]) & (F.col("lifecycle_state") == "ACTIVE")).select("id").distinct()


# Joins


@query
def ingest_to_atoms(s, d):
    a = _atoms(s, d).filter("raw_ingest_id is not null").select("id", "raw_ingest_id").distinct()
    i = _ingest(s, d).select(F.col("id").alias("raw_ingest_id"), "source_type")
    return a.join(i, "raw_ingest_id").groupBy("source_type").agg(F.count(F.lit(1)).alias("atoms"), F.countDistinct("raw_ingest_id").alias("sources"))


@query
def orders_of_week(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    week = R.week_rows(o, "o_orderdate", 1997, 20).filter("o_orderstatus = 'O'")
    return week.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_returnflag")


@query
def latest_child(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    j = o.filter("o_orderstatus = 'F'").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    top = W.best_n(j, ["o_orderkey"], [F.desc("l_shipdate"), F.col("l_linenumber")], 1)
    return top.select("o_orderkey", "l_linenumber", "l_shipdate")


@query
def unused_since_window(s, d):
    ev = table(s, d, "events")
    users = ev.select("user_id").distinct()
    return R.unused_since(users, ev.filter("event_type = 'purchase'"), ["user_id"], "ts", P.EVENTS_END, 7)


@query
def unused_pairs(s, d):
    ev = table(s, d, "events")
    pairs = ev.select("user_id", "event_type").distinct()
    return R.unused_since(pairs, ev, ["user_id", "event_type"], "ts", P.EVENTS_END, 10)


@query
def rekeyed_regions(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    m = r.filter("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("o"), F.col("r_name").alias("n"))
    return R.rekeyed(n.select("n_nationkey", F.col("n_regionkey").cast("string").alias("region")), "region", m, "o", "n")


@query
def titles_known(s, d):
    r = _reservoir(s, d).filter("raw_title is not null and source_author is not null").select("id", "raw_title", "source_author", "status")
    new = r.filter("status = 'AVAILABLE'").drop("status")
    out = R.title_known(new, "raw_title", "source_author", r.filter("status <> 'AVAILABLE'"))
    return out.select("id", "known")


# Aggregates


@query
def status_counts(s, d):
    return R.status_counts(_reservoir(s, d), "status")


@query
def source_type_counts(s, d):
    return _reservoir(s, d).filter("status = 'AVAILABLE'").groupBy("source_type").agg(F.count(F.lit(1)).alias("rows"))


def _week(s, d, days: int) -> DataFrame:
    return R.window_counts(table(s, d, "events"), "event_type", "ts", P.EVENTS_END, days)


@query
def window_counts(s, d):
    return _week(s, d, 14)


@query
def diversity_evenness(s, d):
    return R.evenness(_week(s, d, 28), "rows", 8).select(F.round("evenness", 9).alias("evenness"))


@query
def saturation_shares(s, d):
    out = R.shares(_week(s, d, 28), "rows", 0.21)
    return out.select("event_type", "rows", F.round("share", 9).alias("share"), "saturated")


@query
def underused_groups(s, d):
    ev = table(s, d, "events")
    recent = R.window_counts(ev, "user_id", "ts", P.EVENTS_END, 3)
    return R.underused(ev, "user_id", recent, "rows").select("user_id", "rows")


@query
def grouping_sets_report(s, d):
    r = _reservoir(s, d)
    sets = r.groupingSets([[F.col("pillar")], [F.col("source_type")], [F.col("pillar"), F.col("source_type")]], F.col("pillar"), F.col("source_type"))
    return sets.agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().cast("bigint").alias("level"))


@query
def week_bounds(s, d):
    day = F.col("o_orderdate").cast("date")
    o = table(s, d, "orders").select(K.iso_year(day).alias("week_year"), K.iso_week(day).alias("week"), day.alias("day"))
    return o.groupBy("week_year", "week").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("rows"))


@query
def week_package_stats(s, d):
    day = F.col("o_orderdate").cast("date")
    o = table(s, d, "orders").withColumn("week", K.monday(day))
    return o.groupBy("week").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.round(F.avg("o_totalprice"), 1).alias("mean_price"),
    )


@query
def iso_week_calendar(s, d):
    day = F.col("o_orderdate").cast("date")
    o = table(s, d, "orders").select(day.alias("day")).distinct()
    return o.select("day", K.iso_year(F.col("day")).alias("week_year"), K.iso_week(F.col("day")).alias("week"), K.monday(F.col("day")).alias("monday"), F.date_format("day", "MMM dd, yyyy").alias("label"))


# Ranked picks


@query
def top_per_group(s, d):
    top = W.best_n(table(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5)
    return top.select("p_brand", "p_partkey", "p_retailprice", "rank")


@query
def two_tier_candidates(s, d):
    p = table(s, d, "part")
    out = W.two_tier(p.filter("p_size = 1"), p.filter("p_size = 2"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], limit=30, least=10)
    return out.select("p_brand", "p_partkey", "tier")


@query
def quota_sample_hash(s, d):
    out = W.quota_sample(_reservoir(s, d).filter("status = 'AVAILABLE'"), "source_type", "id", {"YOUTUBE": 10, "BLOG": 13, "BOOK": 2})
    return out.select("source_type", "id", "rank")


@query
def ratio_allocation(s, d):
    out = W.ratio_allocation(_ingest(s, d).filter("status = 'PENDING'"), "source_type", [F.col("ingested_at"), F.col("id")], {"REDDIT": 0.5, "BLOG": 0.3, "BOOK": 0.2}, 40)
    return out.select("id", "source_type", "backfill")


@query
def arg_max_scores(s, d):
    li = table(s, d, "lineitem").withColumn("score", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return W.arg_max(li, ["l_suppkey"], "score", [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_suppkey", "l_orderkey", "l_linenumber")


# Set operations


@query
def pillars_union_all(s, d):
    a = _reservoir(s, d).select("pillar").filter("pillar is not null")
    b = table(s, d, "documents").select("pillar").filter("pillar is not null")
    return a.unionByName(b).groupBy("pillar").agg(F.count(F.lit(1)).alias("rows"))


@query
def shared_authors(s, d):
    return _reservoir(s, d).select(F.col("source_author").alias("author")).intersect(table(s, d, "extraction_results").select("author"))


@query
def hosts_only_in_documents(s, d):
    a = table(s, d, "documents").select(F.col("source").alias("host")).filter("host is not null")
    b = _ingest(s, d).select(H.host(F.col("source_url")).alias("host")).filter("host is not null")
    return a.distinct().join(b.distinct(), "host", "left_anti")


@query
def token_overlap(s, d):
    a = _atoms(s, d).select("id", "format_fit", "secondary_pillars").dropDuplicates(["id"])
    return a.select("id", F.size(F.array_intersect("format_fit", F.array(F.lit("REEL"), F.lit("QUOTE")))).alias("shared"), F.size(F.array_except("format_fit", F.array(F.lit("REEL")))).alias("others"))


@query
def merged_dimension(s, d):
    sup = table(s, d, "supplier").select(F.col("s_nationkey").cast("int").alias("key"), F.lit("supplier").alias("origin")).distinct()
    cus = table(s, d, "customer").select(F.col("c_nationkey").cast("int").alias("key"), F.lit("customer").alias("origin")).distinct()
    return R.merged(sup.filter("key < 12"), cus, "key")


# Projections, lookups and counters


@query
def record_projection(s, d):
    i = _ingest(s, d)
    body = F.when(F.coalesce(F.col("raw_content"), F.lit("")) == "", F.col("raw_title")).otherwise(F.concat_ws("\n\n", "raw_title", "raw_content"))
    return i.select("id", F.md5(body).alias("body_md5"), F.concat_ws(":", "source_type", "source_identifier").alias("source_key"))


@query
def lookup_with_default(s, d):
    first = F.element_at(F.create_map(*[F.lit(x) for kv in P.PILLAR_TONE.items() for x in kv]), F.col("pillar"))
    return _reservoir(s, d).select("id", F.coalesce(first, F.lit("CURIOUS")).alias("tone"))


@query
def harvest_status(s, d):
    b = _ingest(s, d).groupBy("source_type").agg(F.count_if(F.col("status") == "ERROR").alias("errors"), F.count_if(F.col("status") != "ERROR").alias("stored"))
    return b.withColumn("outcome", F.when((F.col("errors") > 0) & (F.col("stored") == 0), "failed").when(F.col("errors") > 0, "partial").otherwise("success"))


@query
def import_progress(s, d):
    r = _reservoir(s, d).filter("source_author is not null").groupBy("source_author").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_id").alias("sources"))
    share = F.round(F.col("chunks") * 100.0 / 40, 1)
    return r.withColumn("percent", share).withColumn("bucket", F.when(F.col("chunks") >= 40, "done").when(F.col("chunks") >= 10, "active").otherwise("remaining"))


@query
def first_and_last_lines(s, d):
    ls = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _chunks(s, d).select("doc_id", "chunk_index", F.md5(F.get(ls, F.lit(0))).alias("first_md5"), F.md5(F.element_at(ls, -1)).alias("last_md5"), F.size(ls).alias("lines"))


@query
def nested_projection(s, d):
    a = _atoms(s, d).dropDuplicates(["id"])
    return a.select("id", F.size("classification.emotional_triggers").alias("triggers"), F.to_json(F.struct(F.col("classification.proof_type").alias("proof"), F.col("classification.hook_mechanism").alias("hook"))).alias("packed"))


@query
def latest_by_version(s, d):
    a = table(s, d, "content_atoms")
    top = W.best_n(a, ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("virality_score")], 1)
    return top.select("id", "updated_at")


# Rendering


@query
def rendered_lists(s, d):
    a = _atoms(s, d).dropDuplicates(["id"])
    return a.select("id", M.numbered(F.col("format_fit")).alias("numbered"), M.bullets(F.col("secondary_pillars")).alias("bullets"))


@query
def file_names(s, d):
    o = table(s, d, "orders")
    day = F.date_format("o_orderdate", "EEEE")
    kind = F.when(F.col("o_orderstatus") == "F", "reel").otherwise("carousel")
    return o.select("o_orderkey", M.file_name((F.col("o_orderkey") % 21 + 1).cast("int"), day, kind, F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 24).cast("int"))).alias("name"))


@query
def week_overview(s, d):
    o = table(s, d, "orders").withColumn("week", K.monday(F.col("o_orderdate").cast("date")))
    line = F.concat(F.lit("- "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus"))
    return M.overview(o, ["week"], "o_orderkey", line).select("week", F.md5("body").alias("body_md5"))


@query
def length_failures(s, d):
    parts = F.filter(F.split("text", "\n\n"), lambda p: p != "")
    return _chunks(s, d).select("doc_id", "chunk_index", F.array_join(M.length_failures(parts, 400, 4, 8, 2200), ",").alias("failures"))


def _pieces(s, d) -> DataFrame:
    a = _atoms(s, d).dropDuplicates(["id"]).select("id", F.get("format_fit", F.lit(0)).alias("kind"), "atomic_components.*")
    reel = F.struct(F.col("emotional_hook").alias("hook_line"), F.array("core_concept", "supporting_evidence").alias("body"), F.col("actionable_insight").alias("punch_line"))
    slides = F.array(F.struct(F.col("core_concept").alias("headline"), F.col("supporting_evidence").alias("body")), F.struct(F.col("emotional_hook").alias("headline"), F.col("actionable_insight").alias("body")))
    quote = F.struct(F.col("quotable_snippet").alias("quote_text"), F.lit(None).cast("string").alias("quote_text_alt"))
    return a.select("id", "kind", reel.alias("reel"), slides.alias("slides"), quote.alias("quote"))


@query
def piece_texts(s, d):
    """H1, H4: all text, first and last line of a piece by its format."""
    p = _pieces(s, d)
    parts = [F.col(c) for c in ("kind", "reel", "slides", "quote")]
    last = M.last_line(*parts)
    return p.select("id", F.md5(M.full_text(*parts)).alias("full_md5"), M.first_line(*parts).alias("first"), last.alias("last"), M.summary_ending(last).alias("ending"))


@query
def piece_bodies(s, d):
    """M1: Markdown by format."""
    p = _pieces(s, d)
    return p.select("id", F.md5(M.piece_body(F.col("kind"), F.col("reel"), F.col("slides"), F.col("quote"))).alias("body_md5"))


def _rated(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    score = lambda k: ((F.col("l_partkey") + k * F.col("l_linenumber")) % 11).cast("int")
    return li.select("l_orderkey", "l_linenumber", F.create_map(*[x for k, (n, _) in enumerate(P.CRITERIA) for x in (F.lit(n), score(k + 1))]).alias("scores"))


@query
def score_gate(s, d):
    """H7, H8, M4: mean, verdict, what needs attention; a score out of range fails the row, not the run."""
    r = M.score_summary(_rated(s, d), "scores", P.CRITERIA, explain=["voice", "hook", "share"])
    return r.select("l_orderkey", "l_linenumber", F.round("mean", 6).alias("mean"), "passed_all", "attention", "error")


@query
def brief_documents(s, d):
    """M2, M3: header with badge, body, table of scores and footer as one document."""
    r = M.score_summary(_rated(s, d), "scores", P.CRITERIA, explain=["voice", "hook", "share"])
    status = F.when(F.col("error").isNotNull(), "REJECTED").when(F.col("passed_all"), "APPROVED").otherwise("FLAGGED")
    doc = M.brief([M.header(F.lit("ORDER"), F.col("l_orderkey"), status, M.split_list(F.col("attention"))), M.score_table("scores", P.CRITERIA), M.footer([("order", F.col("l_orderkey").cast("string")), ("line", F.col("l_linenumber").cast("string"))])])
    return r.select("l_orderkey", "l_linenumber", status.alias("status"), F.md5(doc).alias("doc_md5"))


# Planning


def _slots(s) -> DataFrame:
    return s.createDataFrame(P.SLOTS, "slot int, pillar string, format string")


def _angles(s) -> DataFrame:
    return s.createDataFrame(P.ANGLES, "angle string, active boolean, pillars array<string>, formats array<string>, levels array<int>, multiplier double")


def _items(s, d) -> DataFrame:
    """The latest version of every atom."""
    latest = table(s, d, "content_atoms").groupBy("id").agg(F.max_by(F.struct("primary_pillar", "format_fit", "complexity_score", "virality_score", "lifecycle_state"), F.struct("updated_at", F.coalesce(F.nanvl("virality_score", F.lit(-1.0)), F.lit(-1.0)))).alias("a"))
    return latest.filter("a.lifecycle_state = 'ACTIVE'").select(F.col("id").alias("item"), F.upper(F.trim("a.primary_pillar")).alias("pillar"), F.col("a.format_fit").alias("formats"), F.col("a.complexity_score").alias("level"), F.nanvl("a.virality_score", F.lit(None)).alias("virality"))


@query
def slot_candidates(s, d):
    """J4 with F12-F14, counted per slot and angle."""
    c = N.slot_candidates(_slots(s), _items(s, d), _angles(s), "level", fallback=2)
    return c.groupBy("slot", "angle", "fallback").agg(F.count(F.lit(1)).alias("items"), F.max("virality").alias("best"))


@query
def fallback_angles(s, d):
    return N.angles_of_format(_angles(s), 2).select("format", "angle", "multiplier", "rank")


@query
def weekly_assignment(s, d):
    """W10 over J4's candidates."""
    c = N.slot_candidates(_slots(s), _items(s, d).filter("virality is not null"), _angles(s), "level", fallback=2)
    scored = c.select("slot", "item", "angle", F.round(F.col("virality") * F.col("multiplier"), 6).alias("score"))
    return N.greedy_assignment(scored, len(P.SLOTS))


@query
def diversity_report(s, d):
    ev = table(s, d, "events")
    return N.diversity_report(ev, "event_type", _week(s, d, 28), "rows", 8, 0.2).select(F.round("evenness", 9).alias("evenness"), "underused", "saturated")


@query
def utilisation(s, d):
    return N.utilisation(_week(s, d, 28), "event_type", "rows", P.RATES).select(F.round("utilisation", 9).alias("utilisation"))


@query
def run_counters(s, d):
    st = F.col("o_orderstatus")
    return N.outcome_counts(table(s, d, "orders"), {"filled": st == "F", "failed": st == "P", "late": (st == "O") & (F.col("o_orderpriority") == "1-URGENT")})


@query
def seeding_summary(s, d):
    st = F.col("status")
    return N.outcome_counts(_ingest(s, d), {"success": st == "PASSED", "failed": st == "ERROR", "skipped": st == "PENDING"}, ["source_type"])


# Lookups of one thing each


@query
def unfilled_orders_of_week(s, d):
    """rows of the week without a child of a kind, in order."""
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    week = R.week_rows(o, "o_orderdate", 1997, 20)
    return week.join(li.filter("l_returnflag = 'N'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")


@query
def week_present(s, d):
    o = table(s, d, "orders")
    a, b = R.exists_any(R.week_rows(o, "o_orderdate", 1997, 20)), R.exists_any(R.week_rows(o, "o_orderdate", 2031, 20))
    return a.select(F.lit("1997-20").alias("week"), "present").unionByName(b.select(F.lit("2031-20").alias("week"), "present"))


@query
def first_of_week(s, d):
    """open rows of the week in order, at most 21."""
    return R.week_rows(table(s, d, "orders"), "o_orderdate", 1997, 20).filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(21)


@query
def sources_by_title_and_author(s, d):
    """pending pieces of some pillars, authors compared without regard to case."""
    r = _reservoir(s, d).filter(F.col("pillar").isin("PRODUCTIVITY", "PHILOSOPHY") & (F.col("status") == "QUEUED") & F.lower("source_author").like("a%"))
    return r.select("id", "raw_title", F.lower("source_author").alias("author"))


@query
def rows_of_latest_batch(s, d):
    """the rows of one batch, the newest first."""
    i = _ingest(s, d)
    latest = i.agg(F.max("batch_id").alias("batch_id"))
    return i.join(latest, "batch_id").orderBy(F.desc("ingested_at"), "id").select("id", "batch_id")


@query
def point_lookups(s, d):
    """rows by id; ids without a row come out as not found."""
    keys = table(s, d, "lineitem").select((F.col("l_orderkey") * 2).alias("wanted")).distinct()
    return R.looked_up(keys, "wanted", table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query
def template_by_day(s, d):
    """a template's rows by their keys, beside the others."""
    t = _slots(s)
    return t.filter(F.col("pillar") == "PRODUCTIVITY").withColumn("part", F.lit("wanted")).unionByName(t.filter(F.col("pillar") != "PRODUCTIVITY").withColumn("part", F.lit("other")))


@query
def lookback_filter(s, d):
    epoch = F.when(F.col("ingested_at").isNotNull(), F.unix_timestamp("ingested_at"))
    return _ingest(s, d).filter(R.within_lookback(epoch, P.AS_OF, 60)).select("id")


@query
def scaled_quota_sample(s, d):
    """W4 on W3: quotas scaled to 6 in all."""
    out = W.quota_sample(_reservoir(s, d).filter("status = 'AVAILABLE'"), "source_type", "id", W.scaled_quotas({"YOUTUBE": 10, "BLOG": 13, "BOOK": 3}, 6))
    return out.select("source_type", "id", "rank")


@query
def random_sample_hash(s, d):
    """A fixed sample of the available rows, in the order of their ids' hashes."""
    return _reservoir(s, d).filter("status = 'AVAILABLE'").orderBy(F.md5("id"), "id").limit(40).select("id", "source_type")


@query
def video_keys(s, d):
    """The video's id where the address has one, else the normalised address's key."""
    return _ingest(s, d).filter("source_url is not null").select("id", H.video_key(F.col("source_url")).alias("key"))


@query
def body_previews(s, d):
    """M7."""
    return _docs(s, d).select("doc_id", F.md5(M.preview(F.col("text"))).alias("preview_md5"))


@query
def page_blocks_in_order(s, d):
    """Blocks of laid-out pages as text."""
    li = table(s, d, "lineitem")
    x0, y0 = F.col("l_quantity").cast("double"), (F.col("l_suppkey") * 7 % 800).cast("double")
    blocks = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page_num"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_partkey") % 600).alias("x1"), (y0 + 10).alias("y1"),
        F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.when(F.col("l_linenumber") % 5 == 0, 1).otherwise(0).alias("block_type"), F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string")).alias("text"),
    )
    return page_text(blocks).select("doc_id", F.md5("text").alias("text_md5"))


@query
def block_files(s, d):
    """Delimited files of addresses and pasted articles."""
    t = _docs(s, d).filter("source is not null")
    value = F.concat(F.lit("URL: "), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n-----\nno address here"))
    return text_blocks(t.select(value.alias("value"))).select("url", F.md5("content").alias("content_md5"))


@query
def archive_round_trip(s, d):
    """Archives written from documents and read back."""
    t = table(s, d, "documents").filter("text is not null and title is not null and author is not null")
    file = F.concat(F.lit("URL: https://"), F.col("source"), F.lit("\nTITLE: "), F.col("title"), F.lit("\nAUTHOR_ID: "), F.col("author"), F.lit("\n---\n"), F.col("text"))
    return archives(t.filter("source is not null").select("doc_id", file.alias("value"))).select("doc_id", "url", "title", "author_id", "valid")


@query
def retry_hints(s, d):
    """2.12: the seconds a service asks to wait."""
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("429: try again in "), (F.col("o_orderkey") % 50).cast("string"), F.lit(".5s"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("try again in "), (F.col("o_orderkey") % 900).cast("string"), F.lit("ms"))).otherwise("no").alias("m"))
    return o.select("o_orderkey", retry_after(F.col("m")).alias("wait"))


@query
def enriched_stub(s, d):
    """A deterministic model through the enrichment contract; rows it can't take carry their error."""
    out = enriched(_chunks(s, d).select("doc_id", "chunk_index", "wc"), ["doc_id", "chunk_index", "wc"], _stub_model, "level int", attempts=1)
    return out.select("doc_id", "chunk_index", "level", F.col("error").isNotNull().alias("failed"))


def _stub_model(pdf):
    if (pdf["wc"] > 2000).any():
        raise ValueError("too long")
    return pdf.assign(level=(pdf["wc"] % 5 + 1).astype("int32"))[["level"]]


__all__ = ["queries", "oracle_sql"]
