"""No row, phrase or field is lost, whatever the size of a dictionary and the form of a key."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sangloc.functions.text import bare_tokens
from sangloc.operators import content_rules, lexicon, place_rules, places, quality, verdict
from sangloc.plans.moderation import moderate
from sangloc.sources import postings, sinks
from sangloc.streaming.moderation import moderate_stream
from test_rules import dims, posts  # noqa: F401


def envelope(new_id):
    return {"data": {"result": True, "data": {"new_id": new_id, "new_title": "Thợ\nmáy"}}, "tu_khoa": ["a"]}


def test_json_lines_keep_every_line(spark, tmp_path):
    lines = [json.dumps(envelope(str(i)), ensure_ascii=False) for i in range(5)] + ['{"data": broken', json.dumps({"data": {"data": None}})]
    (tmp_path / "many.jsonl").write_text("\n".join(lines), encoding="utf-8")
    df = postings.rule_columns(postings.read_postings(spark, str(tmp_path), "jsonl"))
    good, missing = postings.quarantine(df, F.col("has_posting"))
    assert sorted((r.post_id, r.title) for r in good.collect()) == [(str(i), "Thợ\nmáy") for i in range(5)]
    reasons = {(r.message, r.error) for r in missing.select("message", "error", "corrupt", "has_posting").collect()}
    assert reasons == {(None, postings.UNREADABLE), (verdict.MSG_NO_POSTING, None)}


def test_one_envelope_per_file_and_a_broken_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(envelope("1"), indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text("no json", encoding="utf-8")
    good, missing = postings.quarantine(postings.read_postings(spark, str(tmp_path)), F.col("has_posting"))
    assert good.count() == 1
    assert [r.error for r in missing.select("error", "file_name", "corrupt").collect()] == [postings.UNREADABLE]
    with pytest.raises(ValueError):
        postings.read_postings(spark, str(tmp_path), "csv")


ROWS = [(1, "một hai ba bốn năm sáu bảy tám chín"), (1, "một hai ba bốn năm sáu bảy tám chín"), (1, "chín"), (None, "tám chín"), (None, None), (2, "")]


@pytest.mark.parametrize("max_rows", [100, 0])
def test_long_phrases_and_repeated_or_null_keys(spark, max_rows):
    df = spark.createDataFrame(ROWS, "id int, text string").withColumn("w", bare_tokens(F.col("text")))
    phrases = spark.createDataFrame([("một hai ba bốn năm sáu bảy tám", "x"), ("tám chín", "y"), (None, "z")], "words string, kind string")
    hits = lexicon.phrase_hits(df, "id", F.col("w"), phrases, max_rows=max_rows).collect()
    assert sorted((str(r.id), [h.words for h in r.hits]) for r in hits) == [
        ("1", []), ("1", ["một hai ba bốn năm sáu bảy tám", "tám chín"]), ("1", ["một hai ba bốn năm sáu bảy tám", "tám chín"]),
        ("2", []), ("None", []), ("None", ["tám chín"]),
    ]
    stop = spark.createDataFrame([("chín",), ("hai ba",), (None,)], "word string")
    kept = lexicon.remove_stopwords(df, "id", F.col("w"), stop, max_rows=max_rows).collect()
    assert sorted((str(r.id), r.kept) for r in kept if r.kept is not None) == [
        ("1", []), ("1", ["một", "bốn", "năm", "sáu", "bảy", "tám"]), ("1", ["một", "bốn", "năm", "sáu", "bảy", "tám"]), ("2", []), ("None", ["tám"]),
    ]
    assert sum(r.kept is None for r in kept) == 1
    topics = spark.createDataFrame([("hai ba", "tám chín")], "term string, related_term string")
    got = lexicon.topic_overlap(df.withColumn("b", F.col("w")), "id", "w", "b", topics, max_rows=max_rows).collect()
    assert sorted((str(r.id), r.topic_hits) for r in got) == [("1", 1), ("1", 7), ("1", 7), ("2", 0), ("None", 0), ("None", 1)]


@pytest.mark.parametrize("max_rows", [100, 0])
def test_long_district_names_and_null_keys(spark, max_rows):
    known = spark.createDataFrame([("Huyện một hai ba bốn năm sáu bảy", "P")], "district string, province string")
    rows = [(None, "số 5 h một hai ba bốn năm sáu bảy", "huyện", "P"), (None, "số 6 h một hai", "huyện", "P"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, raw string, p string")
    got = places.match_district_of_province(df, "id", F.col("a"), F.col("raw"), "p", known, max_rows=max_rows).collect()
    assert sorted(r.address_districts for r in got) == [[], [], ["h một hai ba bốn năm sáu bảy"]]


def test_topics_of_several_words_in_raw_text(spark, dims):  # noqa: F811
    dims = type(dims)(dims.province_alias, dims.district_province, dims.places, dims.stopwords,
                      spark.createDataFrame([("kế toán", "thuế"), ("lái xe", "bằng lái")], "term string, related_term string"))
    cases = [dict(title="Kế toán", description="sổ thuế"), dict(title="Lái xe", description="có bằng lái"), dict(title="Lái xe", description="xe")]
    df = posts(spark, cases).withColumn("description_text", F.col("description"))
    got = content_rules.rule_topic_mismatch(df, dims).orderBy("post_id").collect()
    assert [r.topic_mismatch_count for r in got] == [0, 0, 1]


def test_null_groups_of_vectors_stay(spark):
    rows = [(None, 1, [1.0, 0.0]), (None, 5_000_000, [1.0, 0.0]), (7, 2, [0.0, 1.0]), (None, 10**12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, id long, v array<float>")
    for bucket_rows in (1, 2, 100):
        got = {r.id: r.cosine for r in quality.neighbour_cosine(df, "g", "id", "v", bucket_rows).collect()}
        assert got == {1: None, 5_000_000: 1.0, 10**12: 0.0, 2: None}


def folders(spark):
    return set(os.listdir(sinks.shared_folder(spark, "x").rsplit("/", 1)[0]))


def test_ids_with_a_slash_repairs_and_staged_tables(spark, dims):  # noqa: F811
    body = "Làm kế toán • tổng hợp toàn quốc. Kế toán tổng hợp làm sổ sách. " * 8
    frame = posts(spark, [dict(description=body, title="Kế toán tổng hợp toàn quốc"), dict(employment="Học việc", title="Thợ toàn quốc")])
    plain = frame.withColumn("post_id", F.concat(F.lit("a"), "post_id"))
    slashed = frame.withColumn("post_id", F.concat(F.lit("a/"), "post_id"))
    before = folders(spark)
    got, same = (moderate(x, dims).orderBy("post_id").drop("post_id") for x in (plain, slashed))
    assert got.collect() == same.collect()
    assert {x.rsplit("-", 1)[0] for x in folders(spark) - before} == {"moderated"}
    first, second = got.collect()
    assert not first.returned and second.returned
    assert "toàn quốc" not in first.title_fixed + first.description_fixed + second.title_fixed
    assert ("•" in first.description_fixed) == first.description_poor and "•" in first.description_asked
    assert second.benefits_fixed == second.benefits
    sinks.removed(got, same)
    assert folders(spark) == before


def test_address_is_repaired_where_the_place_rules_pass(spark, dims):  # noqa: F811
    cases = [dict(address="Số 5 đường Lớn, toàn quốc, Quận Ba Đình, Hà Nội"), dict(address="toàn quốc")]
    got = moderate(posts(spark, cases), dims).orderBy("post_id").collect()
    assert "toàn quốc" not in got[0].address_fixed and got[1].address_fixed == "toàn quốc"
    changed = verdict.repaired_fields(moderate(posts(spark, cases), dims)).where("field = 'address'").collect()
    assert [r.post_id for r in changed] == [0]


def test_own_place_fields_come_first(spark):
    df = posts(spark, [dict(address="Số 5 đường Lớn, Quận Mới, Nơi Mới"), dict(address="Số 5 đường Lớn, Quận Ba Đình, Hà Nội")])
    df = df.withColumn("place_province", F.when(F.col("post_id") == 0, "Nơi Mới")).withColumn("place_district", F.when(F.col("post_id") == 0, "Quận Mới"))
    got = place_rules.with_address_detail(df).orderBy("post_id").collect()
    assert got[1].address_detail == "số 5 đường lớn" and got[0].address_detail == "số 5 đường lớn"


def test_violations_of_all_rules_sum_up(spark, dims):  # noqa: F811
    cases = [dict(title="Kế toán 0912345678, Hà Nội!"), dict(employment="Học việc"), dict(company="Tuyển dụng việc làm"), dict(district="Quận Ba Đình, Quận Cầu Giấy")]
    df = moderate(posts(spark, cases), dims)
    found = verdict.violations(df).collect()
    assert {r.rule_id for r in found} & {"title_phone", "title_place", "poor_text", "special_ratio"}
    label = {r: i for i, rules in verdict.RULES_OF_LABEL.items() for r in rules}
    for row in df.collect():
        counts = {}
        for r in found:
            if r.post_id == row.post_id:
                counts.setdefault(label[r.rule_id], []).append(r["count"])
        assert sum(min(1, sum(c)) if i in verdict.COUNTED_ONCE else sum(c) for i, c in counts.items()) == row.num_error
    numbered = df.where("district LIKE '%,%'").first().messages["Điều kiện 6"].split("\n")
    assert [m.split(",")[0] for m in numbered] == [str(i + 1) for i in range(len(numbered))] and len(numbered) > 1


def test_stream_leaves_only_its_output(spark, dims, tmp_path):  # noqa: F811
    from sangloc.operators.quality import fit_corpus

    posts(spark, [{}]).write.parquet(str(tmp_path / "in"))
    texts = spark.createDataFrame([(1, "description", "kế toán tổng hợp")], "post_id long, section string, text string")
    corpus = fit_corpus(texts, ["post_id", "section"], content_rules.corpus_words(F.col("text")))
    before = folders(spark)
    for i in range(2):
        if i:
            posts(spark, [{}]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(posts(spark, [{}]).schema).parquet(str(tmp_path / "in"))
        moderate_stream(stream, dims, str(tmp_path / "out"), str(tmp_path / "state"), corpus, lambda d: d.select("post_id", "num_error")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert folders(spark) == before
