"""One query per operator over the plain tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sangloc.functions import address, metrics, money, text
from sangloc.operators import (
    company_rules,
    content_rules,
    lexicon,
    pay_rules,
    place_rules,
    places,
    quality,
    report,
    rewrite,
    salary,
    similarity,
    title_rules,
    vectors,
    verdict,
)
from sangloc.operators.generate import explode_rows, inline_rows
from sangloc.operators.corpus_state import CorpusState
from sangloc.plans.moderation import corpus_texts, moderate, rule_posts
from sangloc.sources import lexicons, postings, sinks, views
from sangloc.streaming.moderation import moderate_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return views.text_table(spark, folder, "documents")


def _on_documents(name: str, **columns: Callable[[Column], Column]) -> None:
    """Register a query that maps the text of every document."""

    @query(name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _documents(spark, folder).select("doc_id", *[fn(F.col("text")).alias(c) for c, fn in columns.items()])


def _rule_query(name: str, run: Callable[[DataFrame, SparkSession, str], DataFrame], *extra: str) -> None:
    """Register a rule over the postings: its count, message and repaired columns."""

    @query(f"rule_{name}")
    def rule(spark: SparkSession, folder: str) -> DataFrame:
        df = run(views.busy_postings(spark, folder), spark, folder)
        return df.select("post_id", F.col(f"{name}_count").alias("violations"), F.col(f"{name}_msg").alias("message"), *extra)


# --- sources and sinks -------------------------------------------------------------------


@query("read_postings")
def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings written as files of JSON envelopes, one a line, and read back."""
    path = sinks.shared_folder(spark, "envelopes")
    _envelopes(views.postings(spark, folder)).select("body").write.text(path)
    return postings.rule_columns(postings.read_postings(spark, path, "jsonl")).select(
        "post_id", "title", "company", "city_codes", "province", "district", "address", "employment", "money_str",
        F.length("description").alias("n_description"), F.array_join("tu_khoa", "|").alias("keywords"),
    )


def _envelopes(posts: DataFrame, missing: Column | None = None) -> DataFrame:
    """(request_id, body): a posting's envelope as JSON text."""
    named = {ours: theirs for ours, theirs in postings.RULE_COLUMNS.items() if ours in posts.columns}
    fields = F.struct(*[F.col(ours).cast("string").alias(theirs) for ours, theirs in named.items()])
    posting = fields if missing is None else F.when(~missing, fields)
    inner = F.struct(F.lit(True).alias("result"), posting.alias("data"))
    envelope = F.struct(inner.alias("data"), F.array("source", "employment").alias("tu_khoa"))
    return posts.select(F.col("post_id").alias("request_id"), F.to_json(envelope).alias("body"))


@query("quarantine")
def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Requests without a posting (here: documents of under 200 characters) set aside and put back."""
    raw = _envelopes(views.postings(spark, folder), F.length("description") < 200)
    parsed = postings.rule_columns(postings.parse_envelope(raw, "body"))
    good, missing = postings.quarantine(parsed, F.col("has_posting"))
    return good.select("request_id", "has_posting").unionByName(missing, allowMissingColumns=True).select(
        "request_id", "has_posting", "num_error", "status", "message"
    )


@query("read_lexicon")
def read_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Region and nation names written as a line file (names repeat) and read as a lexicon."""
    nation, region = views.table(spark, folder, "nation"), views.table(spark, folder, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.explode(F.array(F.concat(F.lit(" "), "n_name"), "r_name", F.lit(""))).alias("value")
    )
    path = sinks.shared_folder(spark, "lexicon")
    names.write.text(path)
    return lexicons.read_lexicon(spark, path)


@query("lexicon_from_map")
def lexicon_from_map(spark: SparkSession, folder: str) -> DataFrame:
    """Region -> set of nation and supplier names, to one row per pair."""
    nation, region = views.table(spark, folder, "nation"), views.table(spark, folder, "region")
    supplier = views.table(spark, folder, "supplier")
    named = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", F.array("n_name", "s_name").alias("names"))
    )
    return lexicons.long_lexicon(named, "r_name", "names", "name")


@query("write_moderated")
def write_moderated(spark: SparkSession, folder: str) -> DataFrame:
    """The final records of all postings, partitioned by status, written and read back."""
    df = _moderated(spark, folder)
    path = sinks.write_moderated(sinks.response_json(df), sinks.shared_folder(spark, "records"))
    said = {c: F.get_json_object("response", f"$.{c}") for c in ("status_text", "error")}
    said |= {c: F.get_json_object("response", f"$.posting.{c}") for c in ("title", "description", "address", "district")}
    said["num_error"] = F.get_json_object("response", "$.num_error").cast("int")
    said["company_message"] = F.get_json_object("response", f"$.message['{verdict.LABELS[7]}']")
    return spark.read.parquet(path).select("post_id", "status", *[c.alias(name) for name, c in said.items()])


# --- cleaning and repair -----------------------------------------------------------------


@query("html_to_text")
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return views.text_table(spark, folder, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("compose_unicode")
def compose_unicode(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with é and à taken apart, put together again."""
    apart = F.replace("text", F.lit("\u00e9"), F.lit("e\u0301"))
    apart = F.replace(apart, F.lit("\u00e0"), F.lit("a\u0300"))
    return _documents(spark, folder).select("doc_id", text.compose_unicode(apart).alias("text"))


_on_documents("fold_accents", text=text.fold_accents)
_on_documents("strip_phrase", text=lambda c: text.strip_phrase(c, "of the"))
_on_documents("strip_special", text=text.strip_special)
_on_documents("standardize_text", text=text.standardize_text)
_on_documents("wrap_html", html=text.wrap_html)
_on_documents(
    "tokens", n_tokens=lambda c: F.size(text.tokens(c)), tokens=lambda c: F.array_join(text.tokens(c), "|")
)
_on_documents(
    "sentences", n_sentences=lambda c: F.size(text.sentences(c)), sentences=lambda c: F.array_join(text.sentences(c), "|")
)


@query("normalize_address")
def normalize_address(spark: SparkSession, folder: str) -> DataFrame:
    return views.supplier_addresses(spark, folder).select(
        "s_suppkey", address.normalize_address(F.col("address")).alias("address")
    )


@query("strip_place_suffix")
def strip_place_suffix(spark: SparkSession, folder: str) -> DataFrame:
    df = views.supplier_addresses(spark, folder).withColumn("a", address.normalize_address(F.col("address")))
    return df.select(
        "s_suppkey", address.strip_place_suffix(F.col("a"), F.col("province"), F.col("district")).alias("detail")
    )


@query("trim_specials_until")
def trim_specials_until(spark: SparkSession, folder: str) -> DataFrame:
    df = content_rules.rule_special_ratio(pay_rules.with_section_text(views.busy_postings(spark, folder)))
    return df.select("post_id", *[f"{s}_fixed" for s in pay_rules.SECTIONS])


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return views.sections(views.busy_postings(spark, folder))


@query("drop_noise_words")
def drop_noise_words(spark: SparkSession, folder: str) -> DataFrame:
    kept = money.drop_noise_words(F.lower(text.html_to_text(F.col("text"))))
    return _sections(spark, folder).select("post_id", "section", kept.alias("text"))


@query("squash_money_text")
def squash_money_text(spark: SparkSession, folder: str) -> DataFrame:
    squashed = money.squash_money_text(text.html_to_text(F.col("text")))
    return _sections(spark, folder).select("post_id", "section", squashed.alias("text"))


# --- lexicons ----------------------------------------------------------------------------


@query("compound_phrases")
def compound_phrases(spark: SparkSession, folder: str) -> DataFrame:
    phrases = views.benchmark_phrases(views.table(spark, folder, "benchmark"))
    df = lexicon.compound_phrases(_documents(spark, folder), "doc_id", text.bare_tokens(F.col("text")), phrases)
    return df.select("doc_id", F.size("compounds").alias("n_tokens"), F.array_join("compounds", " ").alias("text"))


@query("remove_stopwords")
def remove_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    stop = views.short_words(views.table(spark, folder, "benchmark"))
    df = lexicon.remove_stopwords(_documents(spark, folder), "doc_id", text.bare_tokens(F.col("text")), stop)
    return df.select("doc_id", F.size("kept").alias("n_kept"), F.array_join("kept", " ").alias("text"))


@query("location_mentions")
def location_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Places in title, sections and address of every posting, one row each."""
    dims = views.dictionaries(spark, folder)
    posts = views.busy_postings(spark, folder)
    whole = F.concat_ws(" ", "title", "description", "requirements", text.html_to_text(F.col("benefits")), "address")
    df = lexicon.location_mentions(posts, "post_id", text.bare_tokens(whole), dims.places)
    return inline_rows(df, ["post_id"], "places", "words")


@query("topic_overlap")
def topic_overlap(spark: SparkSession, folder: str) -> DataFrame:
    dims = views.dictionaries(spark, folder)
    posts = views.busy_postings(spark, folder)
    posts = posts.withColumn("t", text.bare_tokens(F.col("title"))).withColumn("b", text.bare_tokens(F.col("description")))
    return lexicon.topic_overlap(posts, "post_id", "t", "b", dims.topics).select("post_id", "topic_hits")


@query("resolve_province")
def resolve_province(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' nation names in three spellings against the aliases."""
    dims = views.dictionaries(spark, folder)
    customer, nation = views.table(spark, folder, "customer"), views.table(spark, folder, "nation")
    spelled = (
        F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name"))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("T "), F.lower("n_name")))
        .otherwise(F.concat(F.lit("near "), "n_name"))
    )
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", spelled.alias("place"))
    return places.resolve_province(named, F.col("place"), dims.province_alias)


def _supplier_places(spark: SparkSession, folder: str) -> DataFrame:
    df = views.supplier_addresses(spark, folder)
    return df.withColumn("a", address.normalize_address(F.col("address")))


@query("match_province_in_address")
def match_province_in_address(spark: SparkSession, folder: str) -> DataFrame:
    dims = views.dictionaries(spark, folder)
    df = places.match_province_in_address(_supplier_places(spark, folder), "s_suppkey", F.col("a"), dims.province_alias)
    return df.select("s_suppkey", "address_province")


@query("match_district_of_province")
def match_district_of_province(spark: SparkSession, folder: str) -> DataFrame:
    dims = views.dictionaries(spark, folder)
    df = places.match_district_of_province(
        _supplier_places(spark, folder), "s_suppkey", F.col("a"), F.col("address"), "province", dims.district_province
    )
    return explode_rows(df, ["s_suppkey"], "address_districts", "district")


# --- rules -------------------------------------------------------------------------------

_rule_query(
    "province_code",
    lambda df, spark, folder: place_rules.rule_province_code(df, views.dictionaries(spark, folder)),
    "city_codes_fixed",
)
_rule_query("nationwide", lambda df, *_: place_rules.rule_nationwide(df))
_rule_query(
    "address_detail", lambda df, *_: place_rules.rule_address_detail(place_rules.with_address_detail(df)), "address_detail"
)
_rule_query("multi_address", lambda df, *_: place_rules.rule_multi_address(place_rules.with_address_detail(df)))
_rule_query("address_missing", lambda df, *_: place_rules.rule_address_missing(place_rules.with_address_detail(df)))
_rule_query("employment_type", lambda df, *_: company_rules.rule_employment_type(df))
_rule_query("hourly_wage", lambda df, *_: pay_rules.rule_hourly_wage(pay_rules.with_section_text(df)))
_rule_query(
    "many_workplaces",
    lambda df, spark, folder: pay_rules.rule_many_workplaces(
        pay_rules.with_section_text(df), views.dictionaries(spark, folder)
    ),
)


def _with_amounts(df: DataFrame) -> DataFrame:
    return pay_rules.with_amounts(pay_rules.with_section_text(df))


_rule_query("negotiable_but_paid", lambda df, *_: pay_rules.rule_negotiable_but_paid(_with_amounts(df)))
_rule_query("salary_absent", lambda df, *_: pay_rules.rule_salary_absent(_with_amounts(df)))
_rule_query("many_salaries", lambda df, *_: pay_rules.rule_many_salaries(_with_amounts(df)))
_rule_query("salary_conflict", lambda df, *_: pay_rules.rule_salary_conflict(_with_amounts(df)))
_rule_query(
    "district_province",
    lambda df, spark, folder: place_rules.rule_district_province(df, views.dictionaries(spark, folder)),
    "district_fixed",
)


def _index_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The postings with place fields of their own; some list two provinces, in lower case or with the first one unknown."""
    posts = views.busy_postings(spark, folder)
    return posts.selectExpr("*", f"{views.INDEX_PROVINCE} AS place_province", f"{views.INDEX_DISTRICT} AS place_district")


@query("rule_district_province_index")
def rule_district_province_index(spark: SparkSession, folder: str) -> DataFrame:
    df = place_rules.rule_district_province_index(_index_postings(spark, folder), views.dictionaries(spark, folder))
    return df.select(
        "post_id", F.col("district_province_index_count").alias("violations"), F.col("district_province_index_msg").alias("message")
    )


@query("moderate_index")
def moderate_index(spark: SparkSession, folder: str) -> DataFrame:
    """The moderation job in its index profile."""
    posts, dims = _index_postings(spark, folder), views.dictionaries(spark, folder)
    df = moderate(posts, dims, profile="index")
    rules = ("salary_conflict", "district_province_index", "title_index")
    return df.select("post_id", "returned", "num_error", "status", *[F.col(f"{r}_count").alias(r) for r in rules])


_rule_query("company_banned_words", lambda df, *_: company_rules.rule_company_banned_words(df))
_rule_query("company_form", lambda df, *_: company_rules.rule_company_form(df))


def _titled(df: DataFrame) -> DataFrame:
    return df.withColumn("title_fixed", F.col("title"))


_rule_query("title_phone", lambda df, *_: title_rules.rule_title_phone(_titled(df)), "title_fixed")
_rule_query("title_special", lambda df, *_: title_rules.rule_title_special(_titled(df)), "title_fixed")
_rule_query("title_branch", lambda df, *_: title_rules.rule_title_branch(_titled(df)), "title_fixed")
_rule_query(
    "title_place",
    lambda df, spark, folder: title_rules.rule_title_place(_titled(df), views.dictionaries(spark, folder)),
    "title_fixed",
)
_rule_query("title_salary", lambda df, *_: title_rules.rule_title_salary(_titled(df)), "title_fixed")
_rule_query(
    "title_index", lambda df, spark, folder: title_rules.rule_title_index(df, views.dictionaries(spark, folder))
)
_rule_query("special_ratio", lambda df, *_: content_rules.rule_special_ratio(pay_rules.with_section_text(df)))
_rule_query(
    "title_body_mismatch",
    lambda df, spark, folder: content_rules.rule_title_body_mismatch(
        pay_rules.with_section_text(df), views.dictionaries(spark, folder), "title", "description_text"
    ),
)
_rule_query(
    "topic_mismatch",
    lambda df, spark, folder: content_rules.rule_topic_mismatch(
        pay_rules.with_section_text(df), views.dictionaries(spark, folder)
    ),
)


@query("rule_poor_text")
def rule_poor_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a text of its own, in the form R13 reads."""
    texts = _documents(spark, folder).select("doc_id", content_rules.poor_text_form(F.col("text")).alias("text"))
    return content_rules.poor_text(texts, "doc_id", keep_text=False).select("doc_id", "is_poor")


# --- quality metrics ---------------------------------------------------------------------

_on_documents("too_short", n_words=lambda c: F.size(text.tokens(c)), is_short=metrics.too_short)


@query("readability")
def readability(spark: SparkSession, folder: str) -> DataFrame:
    df = _documents(spark, folder).select("doc_id", metrics.readability(F.col("text")).alias("r"))
    score = F.col("r.score")
    return df.select("doc_id", "r.*", ((score < metrics.READABLE[0]) | (score > metrics.READABLE[1])).alias("is_unreadable"))


def _lower_words() -> Column:
    return content_rules.corpus_words(F.col("text"))


@query("unknown_word_ratio")
def unknown_word_ratio(spark: SparkSession, folder: str) -> DataFrame:
    df = sinks.staged(_documents(spark, folder).select("doc_id", _lower_words().alias("words")), "words")
    vocab = sinks.staged(quality.vocabulary(df, F.col("words")), "vocabulary")
    ratio = quality.unknown_word_ratio(df, "doc_id", F.col("words"), vocab)
    return ratio.select("doc_id", "n_words", "n_unknown", F.round("unknown_ratio", 6).alias("unknown_ratio"))


@query("corpus_perplexity")
def corpus_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    df = sinks.staged(_documents(spark, folder).select("doc_id", _lower_words().alias("words")), "words")
    model = sinks.staged(quality.bigram_model(df, F.col("words"), key="doc_id"), "bigram-model")
    scored = quality.corpus_perplexity(df, "doc_id", F.col("words"), model)
    return scored.select("doc_id", "n_bigrams", F.round("perplexity", 3).alias("perplexity"))


_on_documents(
    "type_token_ratio",
    type_token_ratio=lambda c: F.round(metrics.type_token_ratio(content_rules.corpus_words(c)), 6),
)
_on_documents("adjacent_coherence", coherence=lambda c: F.round(metrics.adjacent_coherence(c), 6))


@query("adjacent_coherence_vectors")
def adjacent_coherence_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean cosine of neighbouring vectors per label."""
    df = quality.neighbour_cosine(views.table(spark, folder, "embeddings"), "label", "vec_id", "embedding")
    return df.groupBy("label").agg(F.count("cosine").alias("n_pairs"), F.round(F.avg("cosine"), 6).alias("coherence"))


# --- similarity --------------------------------------------------------------------------


@query("pair_tfidf_cosine")
def pair_tfidf_cosine(spark: SparkSession, folder: str) -> DataFrame:
    df = similarity.with_tfidf(views.busy_postings(spark, folder), F.col("title"), F.col("description"))
    return df.select("post_id", F.round("tfidf", 6).alias("tfidf"))


def _word_columns(spark: SparkSession, folder: str) -> DataFrame:
    posts = views.busy_postings(spark, folder)
    return posts.select(
        "post_id",
        "title",
        "description",
        text.tokens(text.standardize_text(F.col("title"))).alias("title_words"),
        text.tokens(text.standardize_text(F.col("description"))).alias("body_words"),
    )


@query("bm25_score")
def bm25_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = similarity.bm25_score(_word_columns(spark, folder), "post_id", "title_words", "body_words")
    return scored.select("post_id", F.round("bm25", 5).alias("bm25"))


@query("bm25_top_k")
def bm25_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best documents for every benchmark text."""
    docs = _documents(spark, folder).select("doc_id", text.bare_tokens(F.col("text")).alias("words"))
    asked = views.table(spark, folder, "benchmark").select("item_id", text.bare_tokens(F.col("text")).alias("asked"))
    return similarity.bm25_top_k(docs, "doc_id", "words", asked, "item_id", "asked").select(
        "item_id", "doc_id", "rank", "bm25"
    )


@query("embedding_cosine")
def embedding_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with the next one, as a title and a body vector would come."""
    left = views.table(spark, folder, "embeddings")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cosine = metrics.embedding_cosine(F.col("embedding"), F.col("other"))
    return left.join(right, "vec_id").select("vec_id", F.round(cosine, 6).alias("cosine"))


@query("term_cosine")
def term_cosine(spark: SparkSession, folder: str) -> DataFrame:
    cosine = metrics.term_cosine(F.col("title_words"), F.col("body_words"))
    return _word_columns(spark, folder).select("post_id", F.round(cosine, 6).alias("cosine"))


@query("hybrid_score")
def hybrid_score(spark: SparkSession, folder: str) -> DataFrame:
    words = _word_columns(spark, folder)
    cosine = words.select("post_id", metrics.term_cosine(F.col("title_words"), F.col("body_words")).alias("cosine"))
    bm25 = similarity.bm25_score(words, "post_id", "title_words", "body_words")
    hybrid = similarity.hybrid_score(F.col("bm25"), F.col("cosine"))
    return bm25.join(cosine, "post_id").select("post_id", F.round(hybrid, 5).alias("hybrid"))


@query("final_score")
def final_score(spark: SparkSession, folder: str) -> DataFrame:
    words = _word_columns(spark, folder)
    scored = similarity.with_match_score(words, F.col("title"), F.col("description"), "title_words", "body_words")
    scored = scored.select("post_id", F.round("match_score", 6).alias("score"))
    return scored.withColumn("matches", F.col("score") >= metrics.MIN_MATCH_SCORE)


def _with_vectors(posts: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Postings with vectors as a model would give them: the title's is that of the same number, the body's the next one."""
    vectors = views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("embedding").alias("title_vector"))
    bodies = vectors.select((F.col("post_id") - 1).alias("post_id"), F.col("title_vector").alias("body_vector"))
    return posts.join(vectors, "post_id", "left").join(bodies, "post_id", "left")


@query("final_score_vectors")
def final_score_vectors(spark: SparkSession, folder: str) -> DataFrame:
    words = _with_vectors(_word_columns(spark, folder), spark, folder)
    scored = similarity.with_match_score(
        words, F.col("title"), F.col("description"), "title_words", "body_words", vectors=("title_vector", "body_vector")
    )
    return scored.select("post_id", F.round("match_score", 6).alias("score"))


@query("rule_title_body_mismatch_vectors")
def rule_title_body_mismatch_vectors(spark: SparkSession, folder: str) -> DataFrame:
    posts = _with_vectors(pay_rules.with_section_text(views.busy_postings(spark, folder)), spark, folder)
    df = content_rules.rule_title_body_mismatch(
        posts, views.dictionaries(spark, folder), "title", "description_text", vectors=("title_vector", "body_vector")
    )
    return df.select("post_id", F.col("title_body_mismatch_count").alias("violations"))


@query("hashed_cosine")
def hashed_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the hashed vectors of title and body."""
    df = _word_columns(spark, folder).select(
        "post_id", vectors.hashed_vector(F.col("title_words")).alias("t"), vectors.hashed_vector(F.col("body_words")).alias("b")
    )
    return df.select("post_id", F.round(metrics.embedding_cosine(F.col("t"), F.col("b")), 6).alias("cosine"))


# --- salary, verdict and reports ---------------------------------------------------------


@query("extract_salary")
def extract_salary(spark: SparkSession, folder: str) -> DataFrame:
    return salary.extract_salary(_sections(spark, folder))


def _moderated(spark: SparkSession, folder: str) -> DataFrame:
    """The moderated postings, a staged table."""
    dims = views.dictionaries(spark, folder)
    return moderate(views.busy_postings(spark, folder), dims)


@query("num_error")
def num_error(spark: SparkSession, folder: str) -> DataFrame:
    return _moderated(spark, folder).select("post_id", "returned", "num_error")


@query("message_map")
def message_map(spark: SparkSession, folder: str) -> DataFrame:
    df = _moderated(spark, folder).select("post_id", F.explode("messages").alias("label", "message"))
    return df.where(F.col("message") != "")


@query("verdict")
def verdict_query(spark: SparkSession, folder: str) -> DataFrame:
    return _moderated(spark, folder).select("post_id", "num_error", "status", "status_text")


@query("short_circuit")
def short_circuit(spark: SparkSession, folder: str) -> DataFrame:
    """R11 only for postings whose company name is clear."""
    dims = views.dictionaries(spark, folder)
    df = company_rules.rule_company_form(pay_rules.with_section_text(views.busy_postings(spark, folder)))
    df = verdict.short_circuit(
        df,
        F.col("company_form_count") > 0,
        lambda rows: content_rules.rule_title_body_mismatch(rows, dims, "title", "description_text"),
        match_score=F.lit(None).cast("double"),
        title_body_mismatch_count=F.lit(0),
        title_body_mismatch_msg=F.lit(""),
    )
    return df.select("post_id", "company_form_count", F.col("title_body_mismatch_count").alias("mismatch"))


@query("repaired_fields")
def repaired_fields(spark: SparkSession, folder: str) -> DataFrame:
    return verdict.repaired_fields(_moderated(spark, folder))


@query("rewrite_queue")
def rewrite_queue(spark: SparkSession, folder: str) -> DataFrame:
    df = _moderated(spark, folder).withColumn("title_fails", F.col("title_body_mismatch_count") > 0)
    texts = {f: F.col(f"{f}_fixed") for f in rewrite.HEADINGS} | {"description": F.col("description_asked")}
    return rewrite.rewrite_queue(df.withColumns(texts))


@query("parse_rewrite")
def parse_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    return rewrite.parse_rewrite(views.answers(spark, folder), ["conv_id", "turn"])


@query("merge_rewrite")
def merge_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of all turns put back into the postings of the same number; of each section the latest answer counts."""
    answers = views.answers(spark, folder).withColumnRenamed("conv_id", "post_id")
    parsed = rewrite.parse_rewrite(answers, ["post_id", "turn"])
    merged = rewrite.merge_rewrite(views.busy_postings(spark, folder), parsed, order="turn")
    return merged.select("post_id", *rewrite.HEADINGS)


@query("violations")
def violations(spark: SparkSession, folder: str) -> DataFrame:
    return verdict.violations(_moderated(spark, folder))


@query("rule_report")
def rule_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.rule_report(verdict.violations(_moderated(spark, folder), "post_id", "source"))


@query("worst_postings")
def worst_postings(spark: SparkSession, folder: str) -> DataFrame:
    return report.worst_postings(_moderated(spark, folder), 3).select("source", "post_id", "rank", "num_error")


@query("rule_label_agreement")
def rule_label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    flags = _documents(spark, folder).select("doc_id", metrics.hard_to_read(F.col("text")).alias("poor"))
    return report.rule_label_agreement(flags, views.table(spark, folder, "labels"), "doc_id", "poor", "quality")


@query("threshold_curve")
def threshold_curve(spark: SparkSession, folder: str) -> DataFrame:
    """What every cut of the votes of R13, of unknown words (in percent) and of perplexity would do against the quality labels."""
    labels = views.table(spark, folder, "labels")
    texts = _documents(spark, folder).select("doc_id", content_rules.poor_text_form(F.col("text")).alias("text"))
    texts = sinks.staged(texts, "texts")
    corpus, scored = quality.fit_and_score(texts, "doc_id", _lower_words())
    unknown = quality.unknown_word_ratio(texts, "doc_id", _lower_words(), corpus.vocabulary)
    unknown = sinks.staged(unknown.select("doc_id", "n_words", "n_unknown"), "unknown")
    votes = content_rules.all_votes(texts, "doc_id", "text", corpus, scored=scored)
    scores = {
        "votes": votes.select("doc_id", F.col("votes").alias("bucket")),
        "unknown_words": unknown.select("doc_id", F.floor(100 * F.col("n_unknown") / F.col("n_words")).cast("int").alias("bucket")),
        "perplexity": scored,
    }
    curves = [report.threshold_curve(s, labels, "doc_id", "bucket", "quality").withColumn("score", F.lit(n)) for n, s in scores.items()]
    return curves[0].unionByName(curves[1]).unionByName(curves[2])


@query("moderate_stream")
def moderate_stream_query(spark: SparkSession, folder: str) -> DataFrame:
    """The postings written as files, moderated as a stream, read back."""
    dims = views.dictionaries(spark, folder)
    arriving = sinks.shared_folder(spark, "arriving")
    views.busy_postings(spark, folder).write.parquet(arriving)
    posts = spark.read.parquet(arriving)
    ruled = rule_posts(posts, dims)
    corpus = quality.fit_corpus(corpus_texts(ruled, "post_id"), ["post_id", "section"], _lower_words())
    stream = spark.readStream.schema(posts.schema).parquet(arriving)
    out, checkpoint = sinks.shared_folder(spark, "stream"), sinks.shared_folder(spark, "stream-state")
    moderate_stream(
        stream, dims, out, checkpoint, corpus,
        lambda df: df.select("post_id", "num_error", "status", "status_text"),
    ).awaitTermination()
    return spark.read.parquet(out).select("post_id", "num_error", "status", "status_text")


@query("stream_corpus_state")
def stream_corpus_state(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts of the corpus that a stream of three batches built up, each judged against the ones before."""
    dims = views.dictionaries(spark, folder)
    arriving = sinks.shared_folder(spark, "arriving")
    views.busy_postings(spark, folder).write.parquet(arriving)
    posts = spark.read.parquet(arriving)
    files = len(posts.inputFiles())
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(arriving)
    state = CorpusState(spark, sinks.shared_folder(spark, "corpus-state"))
    out, checkpoint = sinks.shared_folder(spark, "stream"), sinks.shared_folder(spark, "stream-state")
    moderate_stream(stream, dims, out, checkpoint, state, lambda df: df.select("post_id", "status")).awaitTermination()
    return state.counts("vocabulary")
