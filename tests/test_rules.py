"""Rules on own postings, one case per branch; the job, the envelope and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from sangloc.operators import company_rules, content_rules, pay_rules, place_rules, rewrite, title_rules
from sangloc.operators.rules import RULES, Dictionaries
from sangloc.plans.moderation import first_stage, moderate
from sangloc.sources import postings

COLUMNS = "title description requirements benefits city_codes province district address company employment money_str".split()
GOOD = dict(
    title="Kế toán tổng hợp", description="Làm kế toán tổng hợp.", requirements="Có kinh nghiệm", benefits="Lương 7-10 triệu",
    city_codes="1", province="Hà Nội", district="Quận Ba Đình", address="Số 5 đường Lớn, Quận Ba Đình, Hà Nội",
    company="Công ty TNHH Sao Mai", employment="Toàn thời gian cố định", money_str="7 - 10 triệu",
)


@pytest.fixture(scope="module")
def dims(spark):
    alias = [("Hà Nội", "Hà Nội", 1), ("HN", "Hà Nội", 1), ("Hồ Chí Minh", "Hồ Chí Minh", 2), ("HCM", "Hồ Chí Minh", 2), ("T HCM", "Hồ Chí Minh", 2)]
    districts = [("Quận Ba Đình", "Hà Nội"), ("Quận Cầu Giấy", "Hà Nội"), ("Quận 1", "Hồ Chí Minh"), ("Quận 2", "Hồ Chí Minh")]
    named = [("hà nội", "province"), ("hồ chí minh", "province"), ("ba đình", "district"), ("cầu giấy", "district"),
             ("an", "district"), ("nơi làm việc", "workplace")]
    return Dictionaries(
        spark.createDataFrame(alias, "alias string, province string, province_id int"),
        spark.createDataFrame(districts, "district string, province string"),
        spark.createDataFrame(named, "words string, kind string"),
        spark.createDataFrame([("và",)], "word string"),
        spark.createDataFrame([("kế_toán", "thuế")], "term string, related_term string"),
    )


def posts(spark, cases):
    rows = [(i, *[{**GOOD, **c}[k] for k in COLUMNS]) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "post_id long, " + ", ".join(f"{c} string" for c in COLUMNS))


def counts(df, name, *extra):
    return [tuple(r) if extra else r[0] for r in df.orderBy("post_id").select(f"{name}_count", *extra).collect()]


def test_province_code(spark, dims):
    cases = [{}, dict(city_codes="0"), dict(city_codes="64"), dict(city_codes=None), dict(city_codes="0", province="Nowhere"),
             dict(city_codes="x,5"), dict(city_codes="0,99", province="Nowhere")]
    got = counts(place_rules.rule_province_code(posts(spark, cases), dims), "province_code", "city_codes_fixed")
    assert got == [(0, "1"), (1, "1"), (1, "1"), (1, "1"), (1, "0"), (1, "1"), (1, "0,99")]


def test_address_rules(spark):
    addresses = ["toàn quốc", "Tầng 3, tòa B", "Ngõ nhỏ, 12 đường lớn", "Ngõ nhỏ, đường lớn", "Phường 3", "Số 5 và số 7 đường Lớn",
                 "12 duong lon", "", "Tuyển dụng TOÀN QUỐC"]
    df = place_rules.with_address_detail(posts(spark, [dict(address=a) for a in addresses]))
    assert counts(place_rules.rule_nationwide(df), "nationwide") == [1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert counts(place_rules.rule_address_detail(df), "address_detail") == [1, 0, 0, 1, 1, 0, 0, 1, 1]
    assert counts(place_rules.rule_multi_address(df), "multi_address") == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert counts(place_rules.rule_address_missing(df), "address_missing") == [1, 0, 0, 0, 1, 0, 1, 1, 1]
    province = place_rules.rule_nationwide(posts(spark, [dict(province="Toàn Quốc")]))
    assert province.first().nationwide_msg == place_rules.MSG_PROVINCE_NATIONWIDE


def test_district_province(spark, dims):
    cases = [
        {},
        dict(address="Số 5, Quận Ba Đình, HCM"),
        dict(address="Số 5, Quận Cầu Giấy, Hà Nội"),
        dict(district="Quận Ba Đình, Quận Cầu Giấy"),
        dict(district=""),
        dict(address="Số 5 phố Lớn, quận Cầu Giấy"),
        dict(address="Số 5 Cầu Giấy"),
        dict(address="Số 5 Ba Đình Hà Nội"),
        dict(province="Nowhere", address="Số 5, Ba Đình"),
    ]
    got = counts(place_rules.rule_district_province(posts(spark, cases), dims), "district_province", "district_fixed")
    ba = "Quận Ba Đình"
    assert got == [(0, ba), (1, ba), (1, "Quận Cầu Giấy"), (2, "Quận Ba Đình"), (1, ""),
                   (1, "Quận Cầu Giấy"), (1, ba), (0, ba), (1, ba)]


def test_company_rules(spark):
    kinds = ["Part‑time", "Bán thời gian", "Việc làm từ xa", "Học việc", "Toàn thời gian"]
    assert counts(company_rules.rule_employment_type(posts(spark, [dict(employment=k) for k in kinds])), "employment_type") == [1, 1, 1, 1, 0]
    names = ["Công ty TNHH Sao", "Sao Group", "Tuyển dụng việc làm Sao", "", None]
    df = posts(spark, [dict(company=n) for n in names])
    assert counts(company_rules.rule_company_form(df), "company_form") == [0, 1, 1, 1, 1]
    assert counts(company_rules.rule_company_banned_words(df), "company_banned_words") == [0, 0, 2, 1, 1]


def test_pay_rules(spark, dims):
    cases = [
        {},
        dict(benefits="<p>Lương: 50k / giờ</p>"),
        dict(money_str="Thỏa thuận", benefits="15tr"),
        dict(money_str="500 - 1000 USD", benefits="Nghỉ lễ"),
        dict(benefits="15tr, thưởng 3tr"),
        dict(benefits="8-12 triệu"),
        dict(benefits="9 triệu"),
        dict(money_str="15 triệu", benefits="15tr"),
        dict(description="Nơi làm việc: Ba Đình hoặc Cầu Giấy"),
    ]
    df = pay_rules.with_amounts(pay_rules.with_section_text(posts(spark, cases)))
    assert counts(pay_rules.rule_hourly_wage(df), "hourly_wage") == [0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert counts(pay_rules.rule_negotiable_but_paid(df), "negotiable_but_paid") == [0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert counts(pay_rules.rule_salary_absent(df), "salary_absent") == [0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert counts(pay_rules.rule_many_salaries(df), "many_salaries") == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert counts(pay_rules.rule_salary_conflict(df), "salary_conflict") == [0, 1, 1, 0, 1, 1, 1, 0, 0]
    assert counts(pay_rules.rule_many_workplaces(df, dims), "many_workplaces") == [0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_title_rules(spark, dims):
    titles = ["Thợ 0912345678", "Thợ 09123 45678", "Thợ 0912 345 678", "Thợ 0912-345-678", "Thợ 091-234-5678", "Thợ giỏi!", "Chi nhánh Thợ",
              "Thợ tại Ba Đình, Hà Nội", "Lan chuyên toán", "Thợ lương 10 triệu/tháng", "Thợ"]
    df = posts(spark, [dict(title=t) for t in titles]).withColumn("title_fixed", F.col("title"))
    assert counts(title_rules.rule_title_phone(df), "title_phone", "title_fixed")[0] == (1, "Thợ ")
    assert counts(title_rules.rule_title_phone(df), "title_phone") == [1] * 5 + [0] * 6
    assert counts(title_rules.rule_title_special(df), "title_special", "title_fixed")[5] == (1, "Thợ giỏi")
    assert counts(title_rules.rule_title_branch(df), "title_branch", "title_fixed")[6] == (1, "Thợ")
    place = counts(title_rules.rule_title_place(df, dims), "title_place", "title_fixed")
    assert place[7] == (2, "Thợ tại") and place[8] == (0, "Lan chuyên toán")
    assert counts(title_rules.rule_title_salary(df), "title_salary", "title_fixed")[9] == (2, "Thợ")
    index = counts(title_rules.rule_title_index(df, dims), "title_index")
    # the last but one holds a slash as well as pay
    assert index[5:] == [1, 1, 2, 0, 2, 0]


def test_content_rules(spark, dims):
    cases = [dict(description="a" * 95 + "!!!!!", requirements="", benefits=""), dict(description="a" * 96 + "!!!!", requirements="", benefits=""),
             dict(description="", requirements="", benefits=""), dict(description="<p></p>", requirements="", benefits="")]
    df = pay_rules.with_section_text(posts(spark, cases))
    got = counts(content_rules.rule_special_ratio(df), "special_ratio", "description_fixed")
    assert got == [(1, "a" * 95), (0, "a" * 96 + "!!!!"), (2, ""), (2, "")]
    cases = [dict(title="kế_toán", description="sổ thuế"), dict(title="kế_toán", description="kế_toán"), dict(title="thợ", description="")]
    df = pay_rules.with_section_text(posts(spark, cases))
    assert counts(content_rules.rule_topic_mismatch(df, dims), "topic_mismatch") == [0, 1, 1]
    mismatch = content_rules.rule_title_body_mismatch(df, dims, "title", "description_text")
    assert counts(mismatch, "title_body_mismatch") == [1, 0, 1]


def test_poor_text_equals_all_six_checks_everywhere(spark, folder):
    from sangloc.functions.metrics import hard_to_read, too_short, adjacent_coherence, type_token_ratio
    from sangloc.operators.quality import corpus_perplexity, fit_corpus, perplexity_bucket, perplexity_cut, unknown_word_ratio

    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", content_rules.poor_text_form(F.col("text")).alias("text"))
    words = content_rules.corpus_words(F.col("text"))
    corpus = fit_corpus(df, "doc_id", words)
    cut = perplexity_cut(corpus.sketch)
    full = (
        df.join(unknown_word_ratio(df, "doc_id", words, corpus.vocabulary), "doc_id", "left")
        .join(corpus_perplexity(df, "doc_id", words, corpus.model), "doc_id", "left")
        .withColumn("votes", sum((F.coalesce(c, F.lit(False)).cast("int") for c in (
            hard_to_read(F.col("text")), type_token_ratio(words) < 0.3, adjacent_coherence(F.col("text")) < 0.2,
            F.col("unknown_ratio") > 0.05, perplexity_bucket(F.col("perplexity")) > cut)), F.lit(0)))
        .select("doc_id", (too_short(F.col("text")) | (F.col("votes") >= 4)).alias("poor"))
    )
    want = {r.doc_id: r.poor for r in full.collect()}
    for given in (corpus, None):
        got = content_rules.poor_text(df, "doc_id", corpus=given)
        assert {r.doc_id: r.is_poor for r in got.collect()} == want


def test_five_sample_shapes(spark, dims):
    """Postings with the faults of the five sample records: all are returned."""
    base = dict(province="Toàn Quốc", district="Quận Cầu Giấy, Quận Ba Đình", company="Số 1 Đường ABC", address="Chỉ ghi địa chỉ",
                description="Lương 50k/giờ, làm theo giờ")
    cases = [dict(base, city_codes="1", employment="Theo giờ"), dict(base, city_codes="2", employment="Theo giờ"),
             dict(base, city_codes="2", employment="Bán thời gian"), dict(base, city_codes="1", employment="Việc làm từ xa"),
             dict(base, city_codes="2", employment="Part-time")]
    df = first_stage(posts(spark, cases), dims)
    want = {"province_code": [0] * 5, "nationwide": [1] * 5, "employment_type": [0, 0, 1, 1, 1], "hourly_wage": [1] * 5,
            "company_banned_words": [0] * 5, "company_form": [1] * 5}
    rows = df.orderBy("post_id").collect()
    for name, values in want.items():
        assert [r[f"{name}_count"] for r in rows] == values, name
    assert all(r.district_province_count >= 1 and r.returned for r in rows)


def test_moderation_job(spark, dims):
    body = "Làm kế toán tổng hợp. Kế toán tổng hợp làm sổ sách. " * 8
    cases = [dict(description=body), dict(description=body, title="Kế toán tổng hợp !!!"), dict(employment="Học việc"), {}]
    got = {r.post_id: r for r in moderate(posts(spark, cases), dims).collect()}
    assert {i: r.status for i, r in got.items()}[2] == 0 and got[3].status == 4
    assert got[1].title_special_count == 1 and got[1].title_fixed == "Kế toán tổng hợp "
    for r in got.values():
        assert r.status in (0, 1, 2, 4) and set(r.messages) == {f"Điều kiện {i}" for i in range(1, 13)}
    assert got[2].messages["Điều kiện 3"] == company_rules.MSG_FULL_TIME_ONLY and got[2].messages["Điều kiện 9"] == ""


def test_envelope_files(spark, tmp_path):
    for i, posting in enumerate([{"new_id": "7", "new_title": "Thợ", "usc_logo": None}, None]):
        body = {"data": {"result": True, "message": "", "data": posting, "error": None}, "tu_khoa": ["a", "b"]}
        (tmp_path / f"p{i}.json").write_text(json.dumps(body, indent=2), encoding="utf-8")
    df = postings.rule_columns(postings.read_postings(spark, str(tmp_path)))
    good, missing = postings.quarantine(df, F.col("has_posting"))
    assert [(r.post_id, r.title, r.usc_logo, r.tu_khoa) for r in good.collect()] == [("7", "Thợ", None, ["a", "b"])]
    assert [(r.file_name.split("/")[-1], r.num_error, r.status, r.message) for r in missing.select(
        F.col("file_name"), "num_error", "status", "message").collect()] == [("p1.json", -1, 0, "công ty không tồn tại")]


def test_rewrite_parsing_and_merging(spark):
    answers = {
        0: "**Tiêu đề:** Thợ giỏi!\n\nMô tả công việc:** dài\nMô tả: ngắn",
        1: "không có gì",
        2: "Quyền lợi: cũ\nyêu cầu: thường\nQuyền lợi: mới\n---\nghi chú",
        3: "Yêu cầu ứng viên: chăm\n\nCảm ơn",
    }
    df = spark.createDataFrame(list(answers.items()), "post_id long, text string")
    rows = [tuple(r) for r in rewrite.parse_rewrite(df, ["post_id"]).orderBy("post_id", "pos").collect()]
    assert rows == [
        (0, 1, "Tiêu đề", "Thợ giỏi", None), (0, 2, "Mô tả công việc", "dài", None), (0, 3, "Mô tả", "ngắn", None),
        (1, 0, None, None, rewrite.NO_HEADING),
        (2, 1, "Quyền lợi", "mới", None), (2, 2, "yêu cầu", "thường", None),
        (3, 1, "Yêu cầu ứng viên", "chăm", None),
    ]
    merged = rewrite.merge_rewrite(posts(spark, [{}] * 4), rewrite.parse_rewrite(df, ["post_id"])).orderBy("post_id").collect()
    assert [r.description for r in merged] == ["<p>ngắn</p>"] + [GOOD["description"]] * 3
    assert [r.requirements for r in merged] == [GOOD["requirements"]] * 3 + ["<p>chăm</p>"]
    assert merged[2].benefits == "<p>mới</p>"


def test_rules_are_registered():
    assert {name for name, profile in RULES if profile == "index"} == {"salary_conflict", "title_index", "district_province_index"}
    assert len(RULES) == 25
