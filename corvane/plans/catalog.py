"""Every registered query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scores, text
from corvane.functions import vectors as vec
from corvane.operators import curate, dedupe, dense, fusion, lexical, stats
from corvane.plans import index as index_plans
from corvane.plans import ingest as ingest_plans
from corvane.plans import search as search_plans
from corvane.plans import store, views
from corvane.session import materialise, scratch_dir, spread
from corvane.sources import curated as curated_io
from corvane.sources import repositories
from corvane.sources.schemas import CURATED_SCHEMA, RAW_SCHEMA, STORED_SCHEMA
from corvane.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCORES = ["score", "dense_score", "lexical_score", "metadata_score"]
HIT = ["query_id", "position", "id", "name_with_owner", *SCORES]
LISTS = ["languages", "topics"]


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in LISTS if c in df.columns})


# --- curation -------------------------------------------------------------------------------


@register
def clean_html(spark: SparkSession, sf: str) -> DataFrame:
    return spread(views.table(spark, sf, "pages")).select("page_id", text.clean_text(F.col("html")).alias("clean"))


@register
def identity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return curate.with_identity(views.raw_repos(spark, sf)).select("seq", F.col("nameWithOwner").alias("name_with_owner"))


@register
def fill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    filled = curate.fill_defaults(views.raw_repos(spark, sf))
    return filled.select(
        "seq",
        F.col("primaryLanguage").alias("primary_language"),
        "license",
        F.col("isFork").alias("is_fork"),
        F.col("isArchived").alias("is_archived"),
        *[F.col(raw).alias(name) for raw, name in curate.COUNTS.items()],
    )


@register
def nested_names(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_repos(spark, sf).select(
        "seq",
        F.array_join(text.names_of(F.col("languages")), ",").alias("languages"),
        F.array_join(text.names_of(F.col("topics"), lower=True), ",").alias("topics"),
    )


def _event_times(spark: SparkSession, sf: str) -> DataFrame:
    """Event times as text in several spellings, some of them invalid."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_type")
    spelled = (
        F.when(kind == "click", F.concat(iso, F.lit("Z")))
        .when(kind == "error", F.concat(iso, F.lit("+02:00")))
        .when(kind == "purchase", iso)
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("at "), iso))
    )
    return views.table(spark, sf, "events").select("event_id", spelled.alias("raw"))


@register
def parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return _event_times(spark, sf).select("event_id", F.unix_micros(text.parse_iso(F.col("raw"))).alias("epoch_us"))


@register
def recency_decay(spark: SparkSession, sf: str) -> DataFrame:
    days = scores.days_since(text.parse_iso(F.col("pushedAt")), views.REFERENCE)
    return views.raw_repos(spark, sf).select(
        "seq", F.round(days, 6).alias("days"), F.round(scores.recency(days), 6).alias("recency")
    )


@register
def recency_decay_days(spark: SparkSession, sf: str) -> DataFrame:
    days = scores.calendar_days_since(F.col("pushedAt"), views.REFERENCE)
    return views.raw_repos(spark, sf).select("seq", days.alias("days"), F.round(scores.recency(days), 6).alias("recency"))


@register
def activity_score(spark: SparkSession, sf: str) -> DataFrame:
    return views.repos(spark, sf).select("id", "activity_score")


@register
def activity_score_days(spark: SparkSession, sf: str) -> DataFrame:
    return views.repos(spark, sf, whole_days=True).select("id", "activity_score")


@register
def popularity_score(spark: SparkSession, sf: str) -> DataFrame:
    return views.repos(spark, sf).select("id", "popularity_score")


@register
def search_document(spark: SparkSession, sf: str) -> DataFrame:
    return views.repos(spark, sf).select("id", "synthesized_text")


@register
def search_document_compact(spark: SparkSession, sf: str) -> DataFrame:
    return views.repos(spark, sf, style="compact").select("id", "synthesized_text")


@register
def curate_records(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_lists(views.repos(spark, sf))


@register
def payload_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_lists(curate.payload(views.repos(spark, sf)))


@register
def result_cards(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_lists(curate.result_card(views.repos(spark, sf)))


# --- de-duplication and ingest --------------------------------------------------------------


@register
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return dedupe.dedupe_first(docs, "text", "doc_id").select("doc_id", "source", "text")


@register
def anti_join_existing(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return dedupe.only_new(docs, views.table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


INGESTED = ["seq", "name_with_owner", "owner", "name", "description", "primary_language", "stars", "activity_score",
            "popularity_score", "synthesized_text"]


@register
def ingest_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_plans.ingest(views.raw_arrivals(spark, sf), views.stored_arrivals(spark, sf)).select(*INGESTED)


@register
def sample_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The ingest sample: the first 100 new, valid, distinct records in input order."""
    rows = ingest_plans.ingest(views.raw_arrivals(spark, sf), views.stored_arrivals(spark, sf), n=100)
    return rows.select("seq", "name_with_owner", "stars")


@register
def sample_bernoulli(spark: SparkSession, sf: str) -> DataFrame:
    return repositories.sample_fraction(views.table(spark, sf, "documents"), 0.5).select("doc_id", "n_chars")


@register
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "source")
    return dedupe.assign_ids(docs, ["source", "doc_id"], start=1)


@register
def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("value"))
    new = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("value"))
    return curated_io.upsert_by_key(stored, new, "id")


@register
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select(
        F.col("doc_id"),
        F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("name_with_owner"),
        F.when(F.col("lang") != "de", F.col("source")).alias("owner"),
        F.col("text").alias("name"),
        F.col("lang").alias("primary_language"),
        F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("pushed_at"),
        F.lit(None).cast("string").alias("license"),
        F.col("text").alias("synthesized_text"),
    )
    _, bad = dedupe.validate(docs)
    return bad.select("doc_id", F.array_join("violations", ",").alias("violations"))


# --- sources, sinks and streaming -----------------------------------------------------------


def _curated_again(rows: DataFrame) -> DataFrame:
    return _joined_lists(curate.curate(rows, reference=views.REFERENCE).drop("seq"))


@register
def json_lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records written as JSON lines, read back with the raw schema and curated."""
    path = scratch_dir(spark, "lines")
    views.raw_repos(spark, sf).drop("seq").write.json(path)
    return _curated_again(repositories.read_repositories(spark, path, "lines"))


@register
def json_array_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of up to 500 records each, with elements that are not objects, read back and curated."""
    path = scratch_dir(spark, "array")
    raw = views.raw_repos(spark, sf)
    item = F.to_json(F.struct(*RAW_SCHEMA.fieldNames()))
    # An array file is one value by definition, so each takes a fixed range of customer keys.
    arrays = raw.groupBy(F.floor(F.col("seq") / 500)).agg(F.array_join(F.collect_list(item), ",\n").alias("items"))
    arrays.select(F.concat(F.lit('[1,\n"text",\n'), "items", F.lit("\n]")).alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    return _curated_again(repositories.read_repositories(spark, path, "array"))


@register
def json_array_to_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays with one object per line, split into JSON lines without reading a file whole."""
    array, lines = scratch_dir(spark, "array"), scratch_dir(spark, "lines")
    item = F.to_json(F.struct(*RAW_SCHEMA.fieldNames()))
    rows = views.raw_repos(spark, sf).select(F.concat(F.lit("  "), item, F.lit(",")).alias("value"))
    rows.write.text(array)
    repositories.array_to_lines(spark, array).write.text(lines)
    return _curated_again(repositories.read_repositories(spark, lines, "lines"))


@register
def partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written by language and read back through one partition."""
    path = scratch_dir(spark, "by-language")
    docs = views.docs(spark, sf)
    curated_io.write_curated(docs, path, partition_by="primary_language")
    return stats.filter_hits(curated_io.read_curated(spark, path, docs.schema), language="de")


@register
def format_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "orc")
    docs = views.docs(spark, sf)
    curated_io.write_curated(docs, path, fmt="orc")
    return spark.read.schema(docs.schema).orc(path)


#: About the most text of one arriving file; there are four files at least.
ARRIVAL_BYTES = 128 << 20


def _arrival_files(spark: SparkSession, sf: str) -> str:
    path = scratch_dir(spark, "arrivals")
    size = views.table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(4, -(-size // ARRIVAL_BYTES))
    # Files in order of their names; sorted, so that file order is document order.
    rows = views.raw_arrivals(spark, sf).repartitionByRange(files, "seq").sortWithinPartitions("seq")
    rows.drop("seq").write.json(path)
    return path


@register
def batch_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads into one table: the second finds only what the first left out."""
    source, path = _arrival_files(spark, sf), scratch_dir(spark, "curated")
    ingest_plans.ingest_path(spark, source, path, load_id=0, n=100)
    ingest_plans.ingest_path(spark, source, path, load_id=1)
    return spark.read.parquet(path).select("id", "name_with_owner", "stars", F.col("load_id").cast("int").alias("load_id"))


@register
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """The reports of three loads: the first hundred records, all others, and the same again."""
    source, path = _arrival_files(spark, sf), scratch_dir(spark, "curated")
    reports = [ingest_plans.ingest_path(spark, source, path, load_id=k, n=n) for k, n in enumerate((100, None, None))]
    rows = [(k, r.existing, r.saved, r.rejected) for k, r in enumerate(reports)]
    return spark.createDataFrame(rows, "load_id int, existing bigint, saved bigint, rejected bigint")


@register
def stats_from_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the table from what each of its loads has kept."""
    source, path = _arrival_files(spark, sf), scratch_dir(spark, "curated")
    for k, n in enumerate((100, None)):
        ingest_plans.ingest_path(spark, source, path, load_id=k, n=n)
    record = stats.stats_from_states(spark.read.parquet(f"{path}-stats"), views.table(spark, sf, "embeddings"))
    spelled = F.transform("top_languages", lambda x: F.concat(x["language"], F.lit("="), x["count"].cast("string")))
    return record.withColumn("top_languages", F.array_join(spelled, ","))


@register
def job_reruns(spark: SparkSession, sf: str) -> DataFrame:
    """Four loads: even documents, all, the first one again with every fourth only, and all again.

    Keys that the second run of the first load lets go come back in the last load, with the ids they had.
    """
    raw, path = views.raw_arrivals(spark, sf), scratch_dir(spark, "curated")
    for load_id, rows in (("a", raw.where("seq % 2 = 0")), ("b", raw), ("a", raw.where("seq % 4 = 0")), ("c", raw)):
        ingest_plans.load_batch(rows, path, load_id)
    return spark.read.schema(STORED_SCHEMA).parquet(path).select("id", "name_with_owner", "stars", "load_id")


@register
def unreadable_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records with a count that is no number, with its text."""
    raw = views.raw_repos(spark, sf).withColumn("stars", F.format_number(F.col("stars").cast("bigint"), 0))
    return raw.select("seq", F.array_join(dedupe.unreadable(), ";").alias("unreadable")).where("unreadable <> ''")


@register
def mixed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Names from lists of objects, strings, numbers, flags, lists and nulls, read from files."""
    path = scratch_dir(spark, "lines")
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    first = F.concat(F.lit('{"nameWithOwner": "c/'), key, F.lit('", "languages": ["Go", 5, true, ["'), segment, F.lit('"], {"name": "'), segment)
    line = F.concat(first, F.lit('", "size": 3}, null, 1.5, "'), segment, F.lit('"], "topics": [{"title": "x"}, "{", "5", '), key, F.lit(", {}]}"))
    views.table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    read = repositories.read_repositories(spark, path, "lines")
    return read.select(
        F.col("nameWithOwner").alias("name_with_owner"),
        F.array_join(text.names_of(F.col("languages")), ",").alias("languages"),
        F.array_join(text.names_of(F.col("topics"), lower=True), ",").alias("topics"),
    )


@register
def json_array_pretty(spark: SparkSession, sf: str) -> DataFrame:
    """Indented arrays with other elements between the records, and strings full of brackets and quotes."""
    path = scratch_dir(spark, "array")
    raw = views.raw_repos(spark, sf).withColumn("license", F.concat(F.lit('a "}{][" \\ b'), F.nullif("license", F.lit(""))))
    item = F.regexp_replace(F.to_json(F.struct(*RAW_SCHEMA.fieldNames())), '(?<=[^\\\\]),"', ',\n    "')
    arrays = raw.groupBy(F.floor(F.col("seq") / 500)).agg(F.array_join(F.collect_list(item), ",\n  ").alias("items"))
    arrays.select(F.concat(F.lit('[\n  7, "{", [{"nested": 1}],\n  '), "items", F.lit("\n]\n")).alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    return _curated_again(repositories.read_repositories(spark, path, "array"))


@register
def stream_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Files arriving one by one through the streaming load."""
    source, path = _arrival_files(spark, sf), scratch_dir(spark, "curated")
    query = streaming.stream_ingest(spark, source, path, scratch_dir(spark, "progress"), files_per_batch=1)
    query.awaitTermination()
    return spark.read.schema(CURATED_SCHEMA).parquet(path).select("name_with_owner", "owner", "stars")


@register
def stream_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Term statistics of an index fed by the streaming load."""
    source, path, out = _arrival_files(spark, sf), scratch_dir(spark, "curated"), scratch_dir(spark, "index")
    streaming.stream_ingest(spark, source, path, scratch_dir(spark, "progress")).awaitTermination()
    streaming.stream_index(spark, path, out, scratch_dir(spark, "progress")).awaitTermination()
    found = streaming.read_streamed_index(spark, out).term_stats
    return found.where(F.col("term") != lexical.TOTALS).select("term", "df", "total_len")


# --- filters, look-ups and statistics -------------------------------------------------------


@register
def filter_min_stars(spark: SparkSession, sf: str) -> DataFrame:
    return stats.filter_hits(views.docs(spark, sf), min_stars=1000)


@register
def filter_language(spark: SparkSession, sf: str) -> DataFrame:
    return stats.filter_hits(views.docs(spark, sf), language="fr")


@register
def lookup_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return stats.lookup(views.repos(spark, sf), "NATION_19", "Customer#000000001").select(
        "id", "name_with_owner", "stars", "activity_score"
    )


@register
def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.table_stats(views.repos(spark, sf))


@register
def top_languages(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_languages(views.repos(spark, sf))


@register
def distinct_languages(spark: SparkSession, sf: str) -> DataFrame:
    return stats.languages(views.repos(spark, sf))


@register
def stats_record(spark: SparkSession, sf: str) -> DataFrame:
    record = stats.stats_record(views.repos(spark, sf), views.table(spark, sf, "embeddings"))
    spelled = F.transform("top_languages", lambda x: F.concat(x["language"], F.lit("="), x["count"].cast("string")))
    return record.withColumn("top_languages", F.array_join(spelled, ","))


@register
def index_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_freshness(views.table(spark, sf, "embeddings"), views.table(spark, sf, "documents"))


# --- text and vector retrieval --------------------------------------------------------------


@register
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.build_postings(views.doc_texts(spark, sf))


@register
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.corpus_stats(lexical.doc_tokens(views.doc_texts(spark, sf)))
    return found.withColumn("avg_len", F.round("avg_len", 6))


def _bm25(spark: SparkSession, sf: str, idf: bool) -> DataFrame:
    return lexical.bm25_topk(
        views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"),
        lexical.doc_tokens(views.doc_texts(spark, sf)),
        fusion.candidate_limit(0, 20),
        idf=idf,
    )


@register
def bm25_okapi(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, True)


@register
def bm25_tf_only(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, False)


@register
def query_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "benchmark").select("item_id", vec.query_text(F.col("text")).alias("query_text"))


@register
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode_outer(vec.l2_normalise(F.transform("embedding", lambda x: x * F.lit(3.0)))).alias("pos", "x")
    )
    return rows.select("vec_id", "pos", F.round("x", 6).alias("x"))


@register
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The hashing encoder over whole documents, one row per set dimension."""
    rows = vec.embed_hashed(views.doc_texts(spark, sf).select("id", "text"))
    return rows.select("id", F.posexplode_outer("embedding").alias("dim", "x")).where("x != 0")


@register
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.dense_topk(views.query_batch(spark, sf), views.vectors(spark, sf), fusion.candidate_limit(0, 20))


def _ann(spark: SparkSession, sf: str, probes: int) -> DataFrame:
    stored = views.vectors(spark, sf)
    model = dense.train_cells(stored, cells=16)
    placed = dense.assign_cells(stored, model)
    return dense.ann_topk(views.query_batch(spark, sf), placed, model, fusion.candidate_limit(0, 20), probes)


@register
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate top-k through 8 of 16 cells."""
    return _ann(spark, sf, 8)


@register
def ann_topk_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Probing every cell is exact."""
    return _ann(spark, sf, 16)


@register
def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The built index, joined on id: vector width, length and distinct terms of each record."""
    curated = views.docs(spark, sf).join(views.doc_texts(spark, sf).select("id", F.col("text").alias("synthesized_text")), "id")
    stored = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    built = index_plans.build_index(curated, embed=lambda texts: texts.join(stored, "id"))
    return index_plans.index_rows(built)


# --- ranking and search ---------------------------------------------------------------------


def _lists(spark: SparkSession, sf: str) -> list[DataFrame]:
    queries, found = views.query_batch(spark, sf), views.doc_index(spark, sf)
    n = fusion.candidate_limit(0, 20)
    return [search_plans.retrieve(queries, found, mode, n) for mode in ("semantic", "lexical")]


@register
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_hits(fusion.rrf(_lists(spark, sf)))


@register
def minmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.minmax_normalise(_bm25(spark, sf, True))
    return hits.select("query_id", "id", F.round("norm", 4).alias("norm"))


@register
def metadata_score(spark: SparkSession, sf: str) -> DataFrame:
    score = scores.metadata_score(F.col("stars"), F.col("activity_score"), F.col("primary_language"), "EN")
    return views.docs(spark, sf).select("id", F.round(score, 4).alias("metadata_score"))


def _search(spark: SparkSession, sf: str, **options) -> search_plans.SearchResult:
    return search_plans.search(views.query_batch(spark, sf), views.doc_index(spark, sf), **options)


@register
def search_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, mode="semantic").hits.select(*HIT)


@register
def search_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, mode="lexical").hits.select(*HIT)


@register
def search_lexical_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, mode="lexical", idf=False).hits.select(*HIT)


@register
def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf).hits.select(*HIT)


@register
def search_hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, language="en", min_stars=1000).hits.select(*HIT)


@register
def search_text_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Semantic search from text alone: documents and prefixed queries share the hashing encoder."""
    items = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    prefixed = items.withColumn("prefixed", vec.query_text(F.col("text")))
    queries = vec.embed_hashed(prefixed, "prefixed").select("query_id", "text", "embedding")
    texts = views.doc_texts(spark, sf)
    found = search_plans.Index(views.docs(spark, sf), vec.embed_hashed(texts).drop("text"), lexical.doc_tokens(texts))
    return search_plans.search(queries, found, mode="semantic").hits.select(*HIT)


def _stored(spark: SparkSession, sf: str, cells: int = 0) -> search_plans.Index:
    path = scratch_dir(spark, "index")
    store.write_index(views.doc_index(spark, sf), path, cells)
    return store.read_index(spark, path)


@register
def stored_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same hybrid search against an index that was written and read back: postings, floors, versions."""
    return search_plans.search(views.query_batch(spark, sf), _stored(spark, sf)).hits.select(*HIT)


@register
def stored_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Filters inside the stored postings and vectors."""
    options = {"language": "en", "min_stars": 1000}
    return search_plans.search(views.query_batch(spark, sf), _stored(spark, sf), **options).hits.select(*HIT)


@register
def search_ann(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search through stored vector cells, with every cell probed: equal to the exact search."""
    return search_plans.search(views.query_batch(spark, sf), _stored(spark, sf, cells=16), probes=16).hits.select(*HIT)


@register
def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """An index of an earlier state, brought to the tables' state by changes: equal to one built from scratch.

    The earlier state lacks every fifth document, has other texts and languages for every third, and holds
    documents that are gone now.
    """
    now = views.curated_docs(spark, sf)
    other = F.col("id") % 3 == 0
    before = now.where("id % 5 != 4").withColumns(
        {
            "synthesized_text": F.when(other, F.concat(F.lit("outdated words "), "synthesized_text")).otherwise(F.col("synthesized_text")),
            "primary_language": F.when(other, F.lit("xx")).otherwise(F.col("primary_language")),
        }
    )
    before = before.unionByName(now.where("id % 7 = 1").withColumn("id", F.col("id") + 10_000_000))
    stored = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")

    def build(curated: DataFrame) -> search_plans.Index:
        return index_plans.build_index(curated, embed=lambda texts: texts.join(stored, "id"))

    path = scratch_dir(spark, "index")
    store.sync_index(spark, path, before, build)
    store.sync_index(spark, path, now, build)
    return search_plans.search(views.query_batch(spark, sf), store.read_index(spark, path)).hits.select(*HIT)


@register
def page_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Four pages of sixty rows, each continued behind the last row of the one before."""
    queries, found, pages = views.query_batch(spark, sf), index_plans.settled(views.doc_index(spark, sf)), []
    for mode in ("semantic", "lexical"):
        after = None
        for k in range(4):
            # A query whose last page was not full has no further one.
            asked = queries if after is None else queries.join(after.select("query_id"), "query_id", "left_semi")
            page = materialise(search_plans.page_after(asked, found, after, mode, limit=60), "page")
            pages.append(page.select(F.lit(mode).alias("mode"), "query_id", (F.col("rank") + 60 * k).alias("rank"), "id", "score"))
            after = page.where("rank = 60")
    return functools.reduce(DataFrame.unionByName, pages)


@register
def dense_topk_floors(spark: SparkSession, sf: str) -> DataFrame:
    """The exact top-k by parts, each giving the next one its floors."""
    stored = views.vectors(spark, sf)
    return dense.threshold_topk(views.query_batch(spark, sf), stored, fusion.candidate_limit(0, 20), stored.count())


@register
def search_empty(spark: SparkSession, sf: str) -> DataFrame:
    """A filter that no record meets: every query still has its summary row."""
    return _search(spark, sf, language="tlh").summary


@register
def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, mode="lexical", language="fr", offset=10, limit=50).summary


@register
def search_report(spark: SparkSession, sf: str) -> DataFrame:
    return search_plans.search_report(views.query_batch(spark, sf), views.doc_index(spark, sf))


def _sorted(spark: SparkSession, sf: str, by: str) -> DataFrame:
    return _search(spark, sf, mode="semantic", sort_by=by).hits.select(*HIT)


@register
def sort_stars(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted(spark, sf, "stars")


@register
def sort_activity(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted(spark, sf, "activity")


@register
def sort_recency(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted(spark, sf, "recency")


@register
def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, mode="semantic", offset=40, limit=20).hits.select(*HIT)


@register
def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    totals = views.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"))
    return fusion.page_summary(totals, "total", page_number=3, size=15)
