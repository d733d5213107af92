"""The order of rules, the index profile, corpus state of a stream, cuts from the corpus."""

import collections

import pytest
from pyspark.sql import functions as F

from sangloc.operators import content_rules, quality
from sangloc.operators.corpus_state import CorpusState
from sangloc.operators.rules import STEPS, Node, ordered, rule_of
from sangloc.operators.verdict import FIRST_STAGE
from sangloc.operators.place_rules import rule_district_province_index
from sangloc.operators import places
from sangloc.plans.moderation import first_stage, moderate, rules_of

from test_rules import COLUMNS, counts, dims, posts  # noqa: F401


def node(name, reads=(), makes=(), repairs=()):
    return Node(name, lambda df: df, tuple(reads), tuple(makes), tuple(repairs), False)


def names(nodes):
    return [n.name for n in nodes]


def test_makers_come_before_readers_and_repairs_before_other_reads():
    rules = [node("judge", reads=["clean", "score"]), node("second", repairs=["clean"]), node("third", repairs=["clean"]),
             node("scorer", reads=["raw"], makes=["score"])]
    got = names(ordered(rules, ["raw", "clean"]))
    assert got.index("judge") == 3 and got.index("second") < got.index("third")
    with pytest.raises(ValueError, match="judge reads score"):
        ordered(rules[:1], ["raw", "clean"])


def test_only_steps_that_are_needed_run():
    few = names(ordered([rule_of("company_form", "posting"), rule_of("many_workplaces", "posting")], COLUMNS))
    assert set(few) == {"with_section_text", "company_form", "many_workplaces"}
    assert few.index("with_section_text") < few.index("many_workplaces")
    every = names(ordered(rules_of(FIRST_STAGE, "posting"), COLUMNS))
    assert set(STEPS) <= set(every) and every.index("with_section_text") < every.index("with_amounts") < every.index("many_salaries")
    index = names(ordered(rules_of(FIRST_STAGE, "index"), COLUMNS))
    assert {"salary_conflict", "district_province_index"} <= set(index) and not {"many_salaries", "district_province"} & set(index)


def test_columns_of_steps_go_after_their_last_use(spark, dims):  # noqa: F811
    out = first_stage(posts(spark, [{}]), dims)
    assert not {"declared_pay", "description_pay", "address_detail"} & set(out.columns)
    assert {"description_text", "returned", "city_codes_fixed", "district_fixed"} <= set(out.columns)


def test_index_profile_of_the_district_rule(spark, dims):  # noqa: F811
    cases = [
        {}, dict(province="Hồ Chí Minh"), dict(place_province="Hồ Chí Minh, hà nội"), dict(place_province="nowhere,HCM"), dict(place_province=" , "),
        dict(place_district="Quận Cầu Giấy"), dict(place_district="Quận 1, Quận 2"),
        dict(address="Số 5, Quận 1", place_province="HN,hcm", place_district="Quận Ba Đình"),
        dict(address="Số 5, Quận 1", place_province="nowhere"), dict(address=None, province=None, district=None),
    ]
    base = posts(spark, [{k: v for k, v in c.items() if k in COLUMNS} for c in cases])
    own = spark.createDataFrame(
        [(i, c.get("place_province"), c.get("place_district")) for i, c in enumerate(cases)], "post_id long, place_province string, place_district string"
    )
    df = rule_district_province_index(base.join(own, "post_id"), dims)
    want = [0, 1, 0, 1, 1, 1, 2, 1, 1, 1]
    assert counts(df, "district_province_index") == want
    large = {}
    for rows in (100, 0):
        named = places.names_mapped(base.select("post_id", F.array(F.lower("province"), F.lit("hcm"), F.lit("x")).alias("n")), "n", places.province_names(dims.province_alias), "found", rows)
        large[rows] = {r.post_id: sorted(r.found) for r in named.collect()}
    assert large[100] == large[0] and large[0][0] == ["Hà Nội", "Hồ Chí Minh"] and large[0][9] == ["Hồ Chí Minh"]


def test_index_job(spark, dims):  # noqa: F811
    cases = [dict(title="Kế toán 0912345678 chi nhánh 2"), dict(money_str="1 - 2 triệu"), {}]
    got = {r.post_id: r for r in moderate(posts(spark, cases), dims, profile="index").collect()}
    assert got[0].title_index_count == 3 and got[0].title_fixed == cases[0]["title"] and got[0].status != 2
    assert got[1].salary_conflict_count == 1 and got[1].returned and got[1].title_index_count == 0
    assert "many_salaries_count" not in got[2].__fields__


WORDS = "a b c d e f g h".split()


def texts(spark, start, n):
    rows = [(i, " ".join(WORDS[(i * j) % 8] for j in range(1, 12)) + f" rare{i % 7}") for i in range(start, start + n)]
    return spark.createDataFrame(rows, "id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_state_of_batches_equals_an_offline_count(spark, tmp_path):
    """Three batches, one of them twice, then compacted: the same as all texts at once; a batch sees only earlier ones."""
    state = CorpusState(spark, str(tmp_path / "state"))
    words = content_rules.corpus_words(F.col("text"))
    assert state.corpus(0) is None
    for batch in (0, 1, 1, 2):
        state.add(batch, texts(spark, 20 * batch, 20), "id", words)
    whole = texts(spark, 0, 60)
    want = rows_of(quality.vocabulary(whole, words)), rows_of(quality.bigram_counts(whole, words))
    assert (rows_of(state.counts("vocabulary")), rows_of(state.counts("bigrams"))) == want
    assert sum(n for _, n in rows_of(state.counts("sketch"))) == 60
    assert rows_of(state.counts("vocabulary", 2)) == rows_of(quality.vocabulary(texts(spark, 0, 40), words))
    sketch = rows_of(state.counts("sketch"))
    state.compact(1)
    assert state.parts() == ["base=1", "delta=2"]
    state.add(2, texts(spark, 40, 20), "id", words)
    assert (rows_of(state.counts("vocabulary")), rows_of(state.counts("bigrams"))) == want and rows_of(state.counts("sketch")) == sketch
    state.compact(2)
    assert state.parts() == ["base=2"] and rows_of(state.counts("bigrams")) == want[1]
    corpus = state.corpus()
    assert rows_of(corpus.model) == rows_of(quality.bigram_model(whole, words))
    corpus.remove()


def test_an_unfinished_sum_is_not_read(spark, tmp_path):
    state = CorpusState(spark, str(tmp_path / "state"))
    words = content_rules.corpus_words(F.col("text"))
    for batch in (0, 1):
        state.add(batch, texts(spark, 10 * batch, 10), "id", words)
    want = rows_of(state.counts("vocabulary"))
    state.counts("vocabulary", 1).write.parquet(str(tmp_path / "state/base=0/vocabulary"))
    assert state.parts() == ["delta=0", "delta=1"] and rows_of(state.counts("vocabulary")) == want
    state.compact(0)
    assert state.parts() == ["base=0", "delta=1"] and rows_of(state.counts("vocabulary")) == want


def test_the_cut_follows_the_corpus(spark, folder):
    """About five of a hundred texts are beyond it, also in a corpus twice as large; sketches add up."""
    words = content_rules.corpus_words(F.col("text"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    beyond = []
    for corpus_docs in (docs, twice):
        corpus, scored = quality.fit_and_score(corpus_docs, "doc_id", words)
        cut = quality.perplexity_cut(corpus.sketch)
        beyond.append({r.doc_id for r in scored.where(F.col("bucket") > cut).collect() if r.doc_id < 1000000})
        n = scored.count()
        assert 0 < scored.where(F.col("bucket") > cut).count() <= 0.05 * n
        assert quality.perplexity_cut(corpus.sketch.unionByName(corpus.sketch)) == cut
    assert len(beyond[0] ^ beyond[1]) <= 2
    assert quality.perplexity_cut(spark.createDataFrame([], "bucket int, n long")) is None


def test_hot_and_rare_words_are_scored_alike(spark):
    """A corpus in which one word is very frequent, against plain counting."""
    rows = [(i, " ".join(["the"] * 30 + [f"w{i % 50}", f"u{i}"])) for i in range(300)] + [(1000, "the"), (1001, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    words = content_rules.corpus_words(F.col("text"))
    used = collections.Counter(w for _, t in rows for w in set(t.split()))
    got = {r.id: (r.n_words, r.n_unknown) for r in quality.unknown_word_ratio(df, "id", words, quality.vocabulary(df, words)).collect()}
    assert got == {i: (len(t.split()), sum(used[w] < 3 for w in t.split())) for i, t in rows if t}
