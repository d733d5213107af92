"""Texts are passed over as a whole: no step makes words of a text that a pattern can decide, and the results are the plain ones."""

import random
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from sangloc.functions import money, text
from sangloc.operators import pay_rules
from tests.test_functions import column

PARTS = (
    "tr m triệu tr/ tr/tháng (tr) tr. trong trường, cm2 mẹ 10 7.000.000đ – -> ~ $ k / h giờ 50k/giờ 123456789012 -- (a b) Bé. É "
    "x_y nơi làm việc) & < < \x01 &amp; <p> </p> <script>x</script> <!--c-->     \u0085 . ,"
).split(" ")
ENDS = ("", " ", "  ", "\n", " ")


def odd_texts(n=400):
    pick = random.Random(3).choice
    return ["", " ", "--", " a ", *["".join(pick(PARTS) + pick(ENDS) for _ in range(i % 12)) for i in range(n)]]


def words_of(t):
    # Java's white space and the Unicode separators
    return [w for w in re.split(r"[ \t\n\x0b\f\r  ]+", t) if w]


def plain_bare(w):
    alnum = [i for i, c in enumerate(w) if c.isalnum()]
    return w[alnum[0] : alnum[-1] + 1] if alnum else ""


def plain_squashed(t):
    t = "".join(words_of(t.replace("$", "usd").lower()))
    return re.sub("->|[–~]", "-", t)


def plain_money(t):
    def kept(w):
        core = re.sub("[().,:]", " ", w).strip(" ")
        return not ("tr" in w or "m" in w) or re.search("[0-9]", w) or core in ("m", *money.MONEY_WORDS)

    return re.sub("[0-9]{9,}", " ", plain_squashed(" ".join(w for w in words_of(t.lower()) if kept(w))))


def test_whole_text_forms_are_the_plain_ones(spark):
    texts = [*odd_texts(), None]
    assert column(spark, texts, text.bare_tokens) == [*[[plain_bare(w) for w in words_of(t.lower())] for t in texts[:-1]], None]
    assert column(spark, texts, money.squash_money_text) == [*map(plain_squashed, texts[:-1]), None]
    assert column(spark, texts, money.money_text) == [*map(plain_money, texts[:-1]), None]
    hourly = [re.search("[0-9]{2}k/(h|giờ)", plain_squashed(t)) is not None for t in texts[:-1]]
    assert column(spark, texts, money.is_hourly) == [*hourly, None]
    assert any(hourly)


def planned(spark, c):
    df = spark.createDataFrame([("a",)], "x string").select(c.alias("y"))
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_not_made_one_by_one(spark):
    x = F.col("x")
    assert "split(" not in planned(spark, money.money_text(x))
    assert "regexp_replace(" not in planned(spark, money.is_hourly(x))
    bare = planned(spark, text.bare_tokens(x))
    assert bare.count("split(") == 1 and "regexp_replace(" not in bare


def test_texts_without_a_workplace_phrase_are_not_cut(spark):
    places = spark.createDataFrame(
        [("nơi làm việc", "workplace"), ("chỗ làm", "workplace"), ("quận 1", "district"), ("quận 2", "district")], "words string, kind string"
    )
    texts = ["Quận 1, quận 2.", "(Nơi  làm, việc): quận 1 và quận 2", "việc làm, nơi quận 1, quận 2", "Chỗ làm.Quận 1 quận 2", "chỗ làm quận 1"]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], "post_id int, description_text string, requirements_text string, benefits_text string")
    asked = pay_rules.rule_many_workplaces(df, SimpleNamespace(places=places))
    assert [r.many_workplaces_count for r in asked.orderBy("post_id").collect()] == [0, 1, 0, 1, 0]
    assert "Contains" in asked._jdf.queryExecution().optimizedPlan().toString()
    none = pay_rules.rule_many_workplaces(df, SimpleNamespace(places=places.where("kind = 'district'")))
    assert {r.many_workplaces_count for r in none.collect()} == {0}
