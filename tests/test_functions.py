"""Column functions on small fixtures and against brute force."""

import unicodedata
from decimal import Decimal
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sangloc.functions import address, metrics, money, text


def column(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.y for r in df.withColumn("y", fn(F.col("x"))).orderBy("i").collect()]


class TextNodes(HTMLParser):
    """Text nodes outside scripts and styles, as the standard parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open_node, self.skip = [], False, 0

    def handle_starttag(self, tag, attrs):
        self.open_node = False
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.open_node = False
        self.skip -= tag in ("script", "style")

    def handle_comment(self, data):
        self.open_node = False

    handle_decl = handle_comment

    def handle_data(self, data):
        if self.skip:
            return
        if self.open_node:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
        self.open_node = True


def parsed(html):
    p = TextNodes()
    p.feed(html)
    p.close()
    return "\n".join(p.nodes)


def test_html_to_text_equals_the_standard_parser_on_all_pages(spark, folder):
    pages = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/pages.parquet")
    for r in pages.select("html", text.html_to_text(F.col("html")).alias("t")).collect():
        assert r.t == parsed(r.html)


def test_html_to_text_cases(spark):
    cases = {
        "a<!-- x -->b": "a\nb",
        '<p>a</p><script>var t="</p>";</script>b': "a\nb",
        "a &amp b &copy; &agrave;&#7845;&#x1EA5; &nosuch; 1&2": "a & b © àấấ &nosuch; 1&2",
        "<p>&nbsp;x</p>": "\xa0x",
        "&amp;quot;": "&quot;",
        "plain": "plain",
        "": "",
    }
    assert column(spark, list(cases), text.html_to_text) == list(cases.values())
    assert column(spark, [None], text.html_to_text) == [None]


def test_accents_and_composition(spark):
    words = ["Đường Nguyễn Huệ", "Ĩ Ị", "abc"]
    assert column(spark, words, text.fold_accents) == ["Duong Nguyen Hue", "I I", "abc"]
    apart = [unicodedata.normalize("NFD", w) for w in words]
    assert column(spark, apart, text.compose_unicode) == words


def test_strip_functions(spark):
    assert column(spark, ["Tuyển TOÀN  QUỐC gấp", "a  b"], lambda c: text.strip_phrase(c, "toàn  quốc")) == [
        "Tuyển gấp", "a  b",
    ]
    once = column(spark, ["Giỏi!!! C++ (lương) <b>, ngõ 5/3; x_y"], text.strip_special)
    assert once == ["Giỏi C lương <b>, ngõ 5/3; x_y"]
    assert column(spark, once, text.strip_special) == once
    assert column(spark, ["a\nb"], text.wrap_html) == ["<p>a<br />b</p>"]
    assert column(spark, [" A, b! "], text.standardize_text) == ["a  b"]
    assert column(spark, [" a   b\n"], text.tokens) == [["a", "b"]]


@pytest.mark.parametrize("sample, kinds", [("a" * 95 + "!#$%^", 1), ("a" * 96 + "!#$%", 0), ("!" * 5 + "#" * 5, 2), ("", 0)])
def test_specials_dropped_until_the_ratio_holds(spark, sample, kinds):
    # 5/100 reaches the limit, 4/100 does not; a text of symbols only loses them all
    assert column(spark, [sample], text.special_kinds_to_drop) == [kinds]
    left = sample
    for ch in text.SPECIAL_CHARS[:kinds]:
        left = left.replace(ch, "")
    assert column(spark, [sample], lambda c: text.drop_special_kinds(c, text.special_kinds_to_drop(c))) == [left]


def test_addresses(spark):
    cases = {
        "Số 5, Phường 3, Quận 12, TP. Hà Nội": "số 5,p 3,q 12,t hà nội",
        "12 Lê Lợi – q1 - tphcm": "12 lê lợi,q 1,t hcm",
        "Tx. Sơn Tây , Thành phố Hà Nội": "x sơn tây,t hà nội",
    }
    assert column(spark, list(cases), address.normalize_address) == list(cases.values())
    df = spark.createDataFrame(
        [
            (1, "số 5,q 1,t hà nội,việt nam", "Hà Nội", "Quận 1"),
            (2, "số 5,hoàn kiếm,hà nội", "Hà Nội", "Quận Hoàn Kiếm"),
            (3, "số 5 hà nội", "Hà Nội", ""),
            (4, "số 5,q 1", "", ""),
        ],
        "i int, a string, p string, d string",
    )
    out = address.strip_place_suffix(F.col("a"), F.col("p"), F.col("d"))
    assert [r.x for r in df.select("i", out.alias("x")).orderBy("i").collect()] == ["số 5", "số 5", "số 5 ", "số 5,q 1"]


def test_amounts(spark):
    m = 1_000_000
    cases = {
        "lương 7-10 triệu": [("range", "vnd", 7 * m, 10 * m)],
        "7tr đến 10tr": [("range", "vnd", 7 * m, 10 * m)],
        "7.000.000đ - 10.000.000đ": [("range", "vnd", 7 * m, 10 * m)],
        "500-1000usd": [("range", "usd", 500, 1000)],
        "1.500$": [("single", "usd", 1500, 1500)],
        "7,5tr và 15tr": [("single", "vnd", 7.5 * m, 7.5 * m), ("single", "vnd", 15 * m, 15 * m)],
        "7tr5": [("single", "vnd", 7.5 * m, 7.5 * m)],
        "50k/h": [("single", "vnd/hour", 50_000, 50_000)],
        "200k/ngày": [("single", "vnd/day", 200_000, 200_000)],
        "25-30k/h": [("range", "vnd/hour", 25_000, 30_000)],
        "25k - 30k/giờ": [("range", "vnd/hour", 25_000, 30_000)],
        "200 đến 250k/ngày, thưởng 1tr": [("range", "vnd/day", 200_000, 250_000), ("single", "vnd", m, m)],
        "cao 1.65m, tuổi 18-22, gọi 0912345678": [],
    }
    found = column(spark, list(cases), lambda c: money.amounts(money.money_text(c)))
    for (sample, want), got in zip(cases.items(), found):
        assert [(a.kind, a.unit, a.low, a.high) for a in got] == [(k, u, Decimal(lo), Decimal(hi)) for k, u, lo, hi in want], sample


def test_noise_words_and_hourly(spark):
    assert column(spark, ["trung thực 15tr thêm 2 triệu tr/tháng năm"], money.drop_noise_words) == [
        "thực 15tr 2 triệu tr/tháng"
    ]
    assert column(spark, ["50k / giờ", "25K/h", "5 triệu"], money.is_hourly) == [True, True, False]


def brute_cosine(a, b):
    dot = sum(a.count(t) * b.count(t) for t in set(a))
    return dot / (sum(a.count(t) ** 2 for t in set(a)) * sum(b.count(t) ** 2 for t in set(b))) ** 0.5


def test_cosines(spark):
    a, b = ["x", "y", "x"], ["x", "z", "z", "z", "x", "y"]
    df = spark.createDataFrame([(a, b), (a, []), (["q"], b)], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(metrics.term_cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(brute_cosine(a, b))
    assert got[1:] == [None, 0.0]
    w = metrics.LONE_IDF
    tfidf = df.select(metrics.pair_tfidf_cosine(F.col("a"), F.col("b"))).first()[0]
    assert tfidf == pytest.approx((4 + 1) / (5 ** 0.5 * (4 + 1 + 9 * w * w) ** 0.5))
    vec = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert vec.select(metrics.embedding_cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5 ** 0.5)


def test_quality_limits(spark):
    w29, w30 = " ".join(["abcdefgh"] * 29), " ".join(["abcdefgh"] * 30)
    assert column(spark, [w29, w30, "x " * 99 + "x"], metrics.too_short) == [True, False, True]
    assert column(spark, ["a b. a b", "một", ""], metrics.adjacent_coherence) == [pytest.approx(1.0), 0.0, 0.0]
    assert column(spark, [["a", "a", "b", "b"], []], metrics.type_token_ratio, "x array<string>") == [0.5, None]
    empty, plain = column(spark, ["", "Một hai. Ba bốn"], metrics.readability)
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(plain) == (2.0, 2.75, 0.0, 88.75)
