"""The moderation job: normalise, first-stage rules, second-stage rules, verdict."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangloc.operators import (  # noqa: F401  (registers the rules)
    company_rules,
    content_rules,
    pay_rules,
    place_rules,
    title_rules,
)
from sangloc.functions.text import strip_phrase, strip_special
from sangloc.operators.content_rules import (
    MIN_VOTES,
    MSG_POOR,
    corpus_votes,
    corpus_words,
    needs_corpus,
    poor_text_form,
    with_row_checks,
)
from sangloc.operators.pay_rules import SECTIONS, TEXTS
from sangloc.operators.quality import Corpus, fit_and_score
from sangloc.operators.rules import Dictionaries, Node, applied, ordered, rule_of, text_or_empty
from sangloc.operators.verdict import (
    FIRST_STAGE,
    LABELS_OF_PROFILE,
    SECOND_STAGE,
    is_returned,
    label_count,
    short_circuit,
    verdict,
)
from sangloc.sources.sinks import removed, staged


def rules_of(labels: Iterable[int], profile: str) -> list[Node]:
    """The rules of these labels; R13 is not one of them, as its corpus checks come later."""
    names = [r for label in labels for r in LABELS_OF_PROFILE[profile][label] if r != "poor_text"]
    return [rule_of(name, profile) for name in names]


def first_stage(df: DataFrame, dims: Dictionaries, key: str = "post_id", profile: str = "posting") -> DataFrame:
    """R1 to R8 and the steps they need, ordered by the columns they read and make.

    Row expressions and joins to small dictionaries: no shuffle of postings.
    """
    nodes = ordered(rules_of(FIRST_STAGE, profile), df.columns)
    df = applied(df, nodes, dims, key, keep=TEXTS)
    # The second stage reads the texts, whatever rules the profile has.
    df = df if set(TEXTS) <= set(df.columns) else pay_rules.with_section_text(df)
    return df.withColumn("returned", is_returned(profile))


def second_stage(df: DataFrame, dims: Dictionaries, key: str = "post_id", profile: str = "posting") -> DataFrame:
    """R9 to R11, and the row checks of R13, on what the first stage let through.

    For a returned posting the texts are emptied before the costly expressions see them,
    so they cost nothing there, and no second scan of the postings is needed.
    """
    returned = F.col("returned")
    kept_text = {f"{s}_text": F.when(returned, "").otherwise(F.col(f"{s}_text")) for s in SECTIONS}
    df = df.withColumns(kept_text)
    title = strip_phrase(text_or_empty("title"), place_rules.NATIONWIDE_PHRASE)
    df = df.withColumn("title_fixed", F.when(returned, "").otherwise(title))
    description = strip_phrase(F.col("description_text"), place_rules.NATIONWIDE_PHRASE)
    df = df.withColumn("description_text", description)
    nodes = ordered(rules_of(SECOND_STAGE, profile), df.columns)
    df = applied(df, nodes, dims, key)
    quiet = {f"{n.name}_count": F.when(returned, 0).otherwise(F.col(f"{n.name}_count")).cast("int") for n in nodes if not n.is_step}
    df = df.withColumns(quiet)
    forms = {f"_form_{s}": poor_text_form(F.col(f"{s}_fixed")) for s in SECTIONS}
    return with_row_checks(df.withColumns(forms), list(forms), "_checks").drop(*forms)


def section_texts(df: DataFrame, key: str) -> DataFrame:
    """(key, section, text): the repaired sections in the form R13 reads."""
    return df.select(key, *[poor_text_form(F.col(f"{s}_fixed")).alias(s) for s in SECTIONS]).unpivot(
        [key], list(SECTIONS), "section", "text"
    )


def with_poor_text(
    df: DataFrame,
    corpus: Corpus,
    key: str = "post_id",
    scored: DataFrame | None = None,
) -> DataFrame:
    """R13 as rule `poor_text`, counted once, with a flag per section.

    Postings whose sections the row checks decide are not shuffled: only the others join
    their corpus votes.
    """
    found = {s: F.col("_checks")[i] for i, s in enumerate(SECTIONS)}
    undecided = ~F.col("returned") & F.exists("_checks", needs_corpus)

    def costly(rows: DataFrame) -> DataFrame:
        votes = corpus_votes(section_texts(rows, key), [key, "section"], "text", corpus, scored=scored)
        by_post = votes.groupBy(key).pivot("section", list(SECTIONS)).agg(F.first("corpus_votes"))
        by_post = by_post.select(key, *[F.col(s).alias(f"_{s}") for s in SECTIONS])
        total = {s: found[s]["votes"] + F.coalesce(f"_{s}", F.lit(0)) for s in SECTIONS}
        flags = {f"{s}_poor": found[s]["is_short"] | (total[s] >= MIN_VOTES) for s in SECTIONS}
        return rows.join(by_post, key, "left").withColumns(flags).drop(*[f"_{s}" for s in SECTIONS])

    short = {f"{s}_poor": ~F.col("returned") & found[s]["is_short"] for s in SECTIONS}
    df = short_circuit(df, ~undecided, costly, **short)
    message = F.concat_ws("\n", *[F.when(F.col(f"{s}_poor"), F.lit(MSG_POOR[s])) for s in SECTIONS])
    count = F.greatest(*[F.col(f"{s}_poor").cast("int") for s in SECTIONS])
    return df.withColumns({"poor_text_count": count, "poor_text_msg": message}).drop("_checks")


def repair(df: DataFrame, profile: str = "posting") -> DataFrame:
    """The repaired texts as they are given back.

    The nationwide phrase goes from title and description, and from the address if R2 finds no fault.  A section is
    R10's repair where that rule asks for one; of a posting that is not returned, sections that R13 does not find
    poor lose their special characters.  `description_asked` is the description before that.
    """
    wide = place_rules.NATIONWIDE_PHRASE
    fixed, returned = F.col("special_ratio_count") == 1, F.col("returned")
    plain = {s: F.col(s) for s in SECTIONS} | {"description": strip_phrase(F.col("description"), wide)}
    df = df.withColumns({f"{s}_fixed": F.when(fixed, F.col(f"{s}_fixed")).otherwise(plain[s]) for s in SECTIONS})
    clean = {
        f"{s}_fixed": F.when(returned | F.col(f"{s}_poor"), F.col(f"{s}_fixed")).otherwise(strip_special(F.col(f"{s}_fixed")))
        for s in SECTIONS
    }
    title = F.when(returned, strip_phrase(F.col("title"), wide)).otherwise(F.col("title_fixed"))
    address = F.when(label_count(2, profile) == 0, strip_phrase(F.col("address"), wide)).otherwise(F.col("address"))
    return df.withColumns({"description_asked": F.col("description_fixed"), "title_fixed": title, "address_fixed": address, **clean})


def rule_posts(posts: DataFrame, dims: Dictionaries, key: str = "post_id", profile: str = "posting") -> DataFrame:
    """All rules but the corpus checks of R13, as a staged table."""
    return staged(second_stage(first_stage(posts, dims, key, profile), dims, key, profile).drop(*TEXTS), "ruled")


def corpus_texts(ruled: DataFrame, key: str) -> DataFrame:
    """(key, section, text): what a corpus is made of, the sections of postings that are not returned."""
    return section_texts(ruled.where(~F.col("returned")), key)


def judge(
    ruled: DataFrame, corpus: Corpus | None = None, key: str = "post_id", profile: str = "posting"
) -> DataFrame:
    """The corpus checks, repairs and the verdict, as a staged table; without a corpus the postings are their own."""
    scored = None
    fitted = corpus
    if fitted is None:
        fitted, scored = fit_and_score(corpus_texts(ruled, key), [key, "section"], corpus_words(F.col("text")))
    moderated = staged(verdict(repair(with_poor_text(ruled, fitted, key, scored), profile), profile), "moderated")
    if corpus is None:
        fitted.remove()
        removed(scored)
    return moderated


def moderate(
    posts: DataFrame,
    dims: Dictionaries,
    key: str = "post_id",
    corpus: Corpus | None = None,
    profile: str = "posting",
) -> DataFrame:
    """Postings in; postings with rule columns, repaired texts, count, messages and verdict out.

    `profile` is `posting`, or `index` for postings as they stand in the index: those have place fields of their own
    (`place_province`, which may list several, and `place_district`), and their titles are not repaired.  The result is a staged table (`removed` takes it away); what it was made from is removed here.
    """
    ruled = rule_posts(posts, dims, key, profile)
    moderated = judge(ruled, corpus, key, profile)
    removed(ruled)
    return moderated
