"""Rules R4 and R5: hourly wage, workplaces, declared pay against pay in the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.functions.money import NEGOTIABLE, amounts, is_hourly, money_text, of_kind, squash_money_text
from sangloc.functions.text import bare_tokens, html_to_text
from sangloc.operators.joins import rows_if_small
from sangloc.operators.lexicon import count_kind, location_mentions
from sangloc.operators.rules import Dictionaries, rule, step, text_or_empty, with_violation

SECTIONS = ("description", "requirements", "benefits")
TEXTS = tuple(f"{s}_text" for s in SECTIONS)
PAYS = tuple(f"{s}_pay" for s in SECTIONS)

# Workplace phrases up to which a text is first searched for their words.
MAX_WORKPLACE_PHRASES = 32

# Messages of the pay rules.
MSG_HOURLY = "Lương không được tính theo giờ"
MSG_MANY_PLACES = "Có nhiều địa chỉ trong nội dung"
MSG_NEGOTIABLE_PAID = "Thỏa thuận nhưng vẫn nhắc đến lương"
MSG_NO_PAY = "Không có lương trong nội dung"
MSG_MANY_PAYS = "Có nhiều lương trong nội dung"
MSG_PAY_CONFLICT = "Lương trong nội dung khác mức lương"


@step(SECTIONS, TEXTS)
def with_section_text(df: DataFrame) -> DataFrame:
    """Add `<section>_text`: the three sections without HTML, once for all rules."""
    return df.withColumns({f"{s}_text": html_to_text(text_or_empty(s)) for s in SECTIONS})


@step((*TEXTS, "money_str"), (*PAYS, "declared_pay"))
def with_amounts(df: DataFrame) -> DataFrame:
    """Add `<section>_pay` and `declared_pay`: amounts of the sections and of `money_str`."""
    texts = [money_text(F.col(f"{s}_text")) for s in SECTIONS] + [squash_money_text(text_or_empty("money_str"))]
    df = df.withColumn("_found", F.transform(F.array(*texts), amounts))
    names = [f"{s}_pay" for s in SECTIONS] + ["declared_pay"]
    return df.withColumns({name: F.col("_found")[i] for i, name in enumerate(names)}).drop("_found")


def _content() -> list[Column]:
    return [F.col(f"{s}_pay") for s in SECTIONS]


def _n_amounts() -> Column:
    return reduce(lambda a, b: a + b, [F.size(c) for c in _content()])


def _has(found: Column, kind: str) -> Column:
    return F.exists(found, lambda a: a["kind"] == kind)


def _any_has(kind: str) -> Column:
    return reduce(lambda a, b: a | b, [_has(c, kind) for c in _content()])


@rule("hourly_wage", reads=("description_text", "benefits_text", "money_str"))
def rule_hourly_wage(df: DataFrame) -> DataFrame:
    hit = (
        is_hourly(F.col("description_text")) | is_hourly(F.col("benefits_text")) | is_hourly(text_or_empty("money_str"))
    )
    return with_violation(df, "hourly_wage", hit, MSG_HOURLY)


def _holds_words(text: Column, phrases: list[str]) -> Column:
    """Whether a lower-case text holds every word of one of the phrases, wherever they stand."""
    every = [reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in p.split(" ")]) for p in phrases]
    return reduce(lambda a, b: a | b, every, F.lit(False))


@rule("many_workplaces", reads=TEXTS)
def rule_many_workplaces(df: DataFrame, dims: Dictionaries, key: str = "post_id") -> DataFrame:
    """A workplace phrase and more than one district or province in the sections.

    Texts that lack a word of every workplace phrase cannot hold one, and are not cut into words.
    """
    text = F.concat_ws(" ", *[F.col(f"{s}_text") for s in SECTIONS])
    df = df.withColumn("_joined", F.lower(F.replace(text, F.lit("."), F.lit(" "))))
    words = bare_tokens(F.col("_joined"))
    phrases = rows_if_small(dims.places.where(F.col("kind") == "workplace").select("words").dropna(), MAX_WORKPLACE_PHRASES)
    if phrases is not None:
        words = F.when(_holds_words(F.col("_joined"), [r.words for r in phrases]), words).otherwise(F.array().cast("array<string>"))
    df = location_mentions(df, key, words, dims.places, "_places").drop("_joined")
    places = F.col("_places")
    hit = (count_kind(places, "workplace") > 0) & (
        (count_kind(places, "district") > 1) | (count_kind(places, "province") > 1)
    )
    return with_violation(df, "many_workplaces", hit, MSG_MANY_PLACES).drop("_places")


@rule("negotiable_but_paid", reads=("money_str", *PAYS))
def rule_negotiable_but_paid(df: DataFrame) -> DataFrame:
    hit = (F.trim(text_or_empty("money_str")) == NEGOTIABLE) & (_n_amounts() > 0)
    return with_violation(df, "negotiable_but_paid", hit, MSG_NEGOTIABLE_PAID)


@rule("salary_absent", reads=("money_str", "declared_pay", *PAYS))
def rule_salary_absent(df: DataFrame) -> DataFrame:
    money = F.lower(text_or_empty("money_str"))
    hit = _has(F.col("declared_pay"), "range") & (_n_amounts() == 0) & ~F.contains(money, F.lit("tr"))
    return with_violation(df, "salary_absent", hit, MSG_NO_PAY)


@rule("many_salaries", reads=PAYS)
def rule_many_salaries(df: DataFrame) -> DataFrame:
    return with_violation(df, "many_salaries", _n_amounts() > 1, MSG_MANY_PAYS)


@rule("salary_conflict", "index", reads=("money_str", "declared_pay", *PAYS))
def rule_salary_conflict(df: DataFrame) -> DataFrame:
    """Sections whose range (or single amount) is not the declared one, or another shape."""
    declared = F.col("declared_pay")

    def differing(kind: str) -> Column:
        wanted = of_kind(declared, kind)[0]

        def differs(found: Column) -> Column:
            same = of_kind(found, kind)
            return ((F.size(same) > 0) & ~F.exists(same, lambda a: a == wanted)).cast("int")

        return reduce(lambda a, b: a + b, [differs(c) for c in _content()])

    count = (
        F.when(
            _has(declared, "range"),
            F.when(_any_has("range"), differing("range")).otherwise(_any_has("single").cast("int")),
        )
        .when(F.trim(text_or_empty("money_str")) == NEGOTIABLE, (_n_amounts() > 0).cast("int"))
        .when(_any_has("range"), F.lit(1))
        .when(_has(declared, "single"), differing("single"))
        .otherwise(_any_has("single").cast("int"))
    )
    return with_violation(df, "salary_conflict", count, MSG_PAY_CONFLICT)
