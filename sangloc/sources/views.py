"""Posting-shaped views over the plain tables (documents, nation, region, benchmark ...).

The text tables hold no pay, address or company, so those columns follow from the keys.
`description` is the whole text of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangloc.functions.text import bare_tokens
from sangloc.operators.rules import Dictionaries
from sangloc.sources.lexicons import phrase_table
from sangloc.sources.sinks import dealt_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to process.

    A handful of file splits cannot feed all cores, so rows are dealt out first; with as
    many splits as cores, as on a cluster, the scan is used as it is.
    """
    return dealt_out(table(spark, folder, name))


# The words of a text that the short columns are made of; the rest is not cut into words.
LAST_WORD = 92


def _words(first: int, last: int) -> str:
    return f"array_join(slice(split(d.text, '[\\\\s\\\\p{{{{Z}}}}]+', {LAST_WORD + 1}), {first}, {last - first + 1}), ' ')"


POSTING_COLUMNS = """
  d.doc_id AS post_id, d.source,
  {TITLE} AS title,
  d.text AS description,
  {REQ} AS requirements,
  concat('<p>', {BEN}, '</p><p>', CASE d.doc_id % 6
    WHEN 0 THEN 'Lương 7-10 triệu' WHEN 1 THEN 'Lương: 50k/giờ'
    WHEN 2 THEN 'Lương 15tr, thưởng 3tr' WHEN 3 THEN 'Lương 500-1000usd'
    WHEN 4 THEN 'Lương 7.000.000đ - 10.000.000đ' ELSE 'Nghỉ lễ' END, '</p>') AS benefits,
  CASE d.doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '0,5' WHEN 2 THEN '64'
    ELSE CAST(1 + d.doc_id % 63 AS STRING) END AS city_codes,
  CASE WHEN d.doc_id % 13 = 0 THEN 'Toàn Quốc' ELSE n.n_name END AS province,
  CASE WHEN d.doc_id % 17 = 0 THEN 'Quận 1, Quận 2'
    WHEN d.doc_id % 19 = 0 THEN '' ELSE concat('Quận ', CAST(1 + d.doc_id % 12 AS STRING)) END AS district,
  CASE d.doc_id % 9 WHEN 0 THEN 'toàn quốc' WHEN 1 THEN 'Ngõ nhỏ, đường lớn'
    WHEN 2 THEN '' WHEN 3 THEN '12 duong lon'
    WHEN 4 THEN concat('Số 5 và số 7 đường lớn, Quận ', CAST(1 + d.doc_id % 12 AS STRING), ', ', n.n_name)
    WHEN 5 THEN concat('Tầng 3, tòa B, q', CAST(1 + d.doc_id % 12 AS STRING), ' - ', n.n_name)
    WHEN 6 THEN concat('12 đường lớn, Quận ', CAST(1 + (d.doc_id + 1) % 12 AS STRING), ', ', n.n_name)
    ELSE concat('Số ', CAST(d.doc_id AS STRING), ' đường lớn, Quận ', CAST(1 + d.doc_id % 12 AS STRING), ', ', n.n_name) END AS address,
  CASE d.doc_id % 5 WHEN 0 THEN 'Công ty TNHH Sao Mai' WHEN 1 THEN 'Công ty Sao Mai'
    WHEN 2 THEN 'Tuyển dụng Sao Mai' WHEN 3 THEN 'Tập đoàn CP Sao Mai Group' ELSE 'Công ty cổ phần Sao Mai' END AS company,
  CASE d.doc_id % 7 WHEN 0 THEN 'Part-time theo giờ' WHEN 1 THEN 'Việc làm từ xa' ELSE 'Toàn thời gian cố định' END AS employment,
  CASE d.doc_id % 4 WHEN 0 THEN 'Thỏa thuận' WHEN 1 THEN '7 - 10 triệu' WHEN 2 THEN '15 triệu' ELSE '500 - 1000 USD' END AS money_str,
  n.n_name, n.n_regionkey
"""


BUSY_TITLE = """concat(title, CASE post_id % 8
        WHEN 0 THEN concat(' tại Quận ', CAST(1 + post_id % 12 AS STRING), ', ', n_name)
        WHEN 1 THEN ' LH 0912 345 678' WHEN 2 THEN ' Chi nhánh 2' WHEN 3 THEN ' lương cứng 10 triệu/tháng'
        WHEN 4 THEN ' part-time 25k/h' WHEN 5 THEN concat(' Thưởng nóng ', lower(n_name))
        WHEN 6 THEN ' 0912345678 !!!' ELSE '' END)"""

BUSY_BENEFITS = """concat(benefits, CASE post_id % 5
        WHEN 0 THEN concat('<p>Nơi làm việc: Quận ', CAST(1 + post_id % 12 AS STRING), ' hoặc Quận ',
                           CAST(1 + (post_id * 7) % 12 AS STRING), ', ', n_name, '.</p>')
        WHEN 1 THEN concat('<p>Quận 1, quận 2, ', n_name, '</p>') ELSE '' END)"""

INDEX_PROVINCE = """CASE post_id % 7
        WHEN 0 THEN concat(lower(province), ', NATION_', CAST((post_id + 3) % 25 AS STRING))
        WHEN 1 THEN concat('nowhere,t ', lower(province)) WHEN 2 THEN '' WHEN 3 THEN 'nowhere'
        WHEN 4 THEN concat('NATION_', CAST((post_id + 1) % 25 AS STRING), ' , ', province) ELSE province END"""

INDEX_DISTRICT = """CASE post_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('q', CAST(1 + post_id % 12 AS STRING))
        ELSE district END"""

SUPPLIER_ADDRESSES = """SELECT s.s_suppkey, n.n_name AS province,
             concat('Quận ', CAST(1 + s.s_suppkey % 12 AS STRING)) AS district,
             CASE s.s_suppkey % 8
               WHEN 0 THEN concat(s.s_name, ', Phường 5, Quận ', CAST(1 + s.s_suppkey % 12 AS STRING), ', ', n.n_name)
               WHEN 1 THEN concat(s.s_name, ' đường lớn, q', CAST(1 + s.s_suppkey % 12 AS STRING), ' – TP. ', n.n_name)
               WHEN 2 THEN concat(s.s_name, ', Q.', CAST(1 + (s.s_suppkey + 3) % 12 AS STRING), ', tp ', n.n_name, ', Việt Nam')
               WHEN 3 THEN concat('Khu ', r.r_name, ' quận ', CAST(1 + (s.s_suppkey + 5) % 12 AS STRING))
               WHEN 4 THEN concat('Số ', CAST(s.s_suppkey AS STRING), ' phố ', n.n_name)
               WHEN 5 THEN concat('Tầng 2, tòa nhà ', s.s_name, ', Thành phố ', r.r_name)
               WHEN 6 THEN concat(s.s_name, ', Quận ', CAST(1 + s.s_suppkey % 12 AS STRING), ', Tỉnh NATION_',
                                  CAST((n.n_nationkey + 1) % 25 AS STRING))
               ELSE '' END AS address
           FROM {s} s JOIN {n} n ON n.n_nationkey = s.s_nationkey JOIN {r} r ON r.r_regionkey = n.n_regionkey"""

ANSWER_TEXT = """CASE conv_id % 5
             WHEN 0 THEN concat('**Tiêu đề:** ', role, ' ', CAST(conv_id AS STRING), '\n\nMô tả công việc:** ', text)
             WHEN 1 THEN concat('Mô tả: ', text, '\nYÊU CẦU: ', role, '\nYêu cầu: chăm chỉ (', role, ')\n---\nghi chú')
             WHEN 2 THEN concat('Mở đầu. Yêu cầu ứng viên** ', role, ' !\n**Quyền lợi**\n', text, '\n\nCảm ơn')
             WHEN 3 THEN concat('Quyền lợi: cũ\nMô tả công việc: ', text, '\nMô tả: ', role, '\nQuyền lợi: mới')
             ELSE text END AS text"""


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    columns = POSTING_COLUMNS.format(TITLE=_words(1, 12), REQ=_words(13, 52), BEN=_words(53, LAST_WORD))
    return spark.sql(
        f"SELECT {columns} FROM {{d}} d JOIN {{n}} n ON n.n_nationkey = d.doc_id % 25",
        d=text_table(spark, folder, "documents"),
        n=table(spark, folder, "nation"),
    )


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder).drop("n_name", "n_regionkey")


def busy_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings whose titles and benefits also hold places, phones, branch and pay words."""
    return (
        _postings(spark, folder)
        .withColumns({"title": F.expr(BUSY_TITLE), "benefits": F.expr(BUSY_BENEFITS)})
        .drop("n_name", "n_regionkey")
    )


def sections(posts: DataFrame) -> DataFrame:
    """(post_id, section, text): the three sections in long form."""
    return posts.unpivot(["post_id"], ["description", "requirements", "benefits"], "section", "text")


def dictionaries(spark: SparkSession, folder: str) -> Dictionaries:
    """Small dictionary tables derived from the plain ones."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    benchmark = table(spark, folder, "benchmark")
    districts = nation.select(
        F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"), F.col("n_name").alias("province")
    ).select(F.concat(F.lit("Quận "), F.col("i").cast("string")).alias("district"), "province")
    full, short = F.lower("n_name"), F.concat(F.lit("t "), F.lower("n_name"))
    aliases = nation.select(
        F.explode(F.array(full, short)).alias("alias"),
        F.col("n_name").alias("province"),
        (F.col("n_nationkey") + 1).alias("province_id"),
    )
    workplace = spark.createDataFrame([("nơi làm việc",), ("địa điểm làm việc",), ("địa chỉ làm việc",)], "name string")
    places = (
        phrase_table(districts, "district", "district")
        .unionByName(phrase_table(nation, "n_name", "province"))
        .unionByName(phrase_table(region, "r_name", "province"))
        .unionByName(phrase_table(workplace, "name", "workplace"))
    )
    # small and read by several rules each
    return Dictionaries(
        province_alias=aliases.cache(),
        district_province=districts.cache(),
        places=places.cache(),
        stopwords=short_words(benchmark).cache(),
        topics=word_pairs(benchmark).cache(),
    )


def short_words(benchmark: DataFrame) -> DataFrame:
    """Stop words: the benchmark's words of at most three letters."""
    return (
        benchmark.select(F.explode(bare_tokens(F.col("text"))).alias("word"))
        .where(F.length("word").between(1, 3))
        .dropDuplicates()
    )


def benchmark_phrases(benchmark: DataFrame) -> DataFrame:
    """Phrase lexicon: word pairs and triples of the benchmark texts."""
    words = benchmark.select(bare_tokens(F.col("text")).alias("w"))
    runs = [
        words.select(F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"), "w")
        .select(F.array_join(F.slice("w", F.col("i"), F.lit(n)), " ").alias("words"))
        for n in (2, 3)
    ]
    return runs[0].unionByName(runs[1]).dropDuplicates().withColumn("kind", F.lit("phrase"))


def word_pairs(benchmark: DataFrame) -> DataFrame:
    """Topic table: a benchmark word of six letters or more and the word after it."""
    words = benchmark.select(bare_tokens(F.col("text")).alias("w"))
    n = F.size("w") - 1
    pairs = F.arrays_zip(F.slice("w", 1, n).alias("term"), F.slice("w", 2, n).alias("related_term"))
    return (
        words.select(F.inline(pairs)).where((F.length("term") >= 6) & (F.length("related_term") >= 1)).dropDuplicates()
    )


def supplier_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """(s_suppkey, address, province, district): suppliers with addresses of every shape."""
    return spark.sql(
        SUPPLIER_ADDRESSES,
        s=table(spark, folder, "supplier"),
        n=table(spark, folder, "nation"),
        r=table(spark, folder, "region"),
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, text): conversation turns dressed as rewritten postings."""
    return text_table(spark, folder, "conversations").selectExpr(
        "conv_id",
        "turn",
        ANSWER_TEXT,
    )
