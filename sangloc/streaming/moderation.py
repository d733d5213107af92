"""Moderation as a stream: the same rules over every arriving batch of postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sangloc.operators.content_rules import corpus_words
from sangloc.operators.corpus_state import CorpusState
from sangloc.operators.quality import Corpus
from sangloc.operators.rules import Dictionaries
from sangloc.plans.moderation import corpus_texts, judge, rule_posts
from sangloc.sources.sinks import dealt_out, removed

# A state is compacted after so many batches.
COMPACT_EVERY = 16


def moderate_stream(
    posts: DataFrame,
    dims: Dictionaries,
    out: str,
    checkpoint: str,
    corpus: Corpus | CorpusState,
    shape: Callable[[DataFrame], DataFrame],
    key: str = "post_id",
    profile: str = "posting",
) -> StreamingQuery:
    """Moderate every micro-batch and write it below `out`.

    `corpus` is a fixed one, or a state: then a batch is judged against all batches before it (the first one
    against itself) and adds its own texts.  A batch goes to a folder of its own and overwrites it, so a batch that is repeated
    after a failure leaves the same rows and the same state.  A batch of few files is dealt out to all cores.  `shape` picks the
    columns to write.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ruled = rule_posts(dealt_out(batch, per_core=2), dims, key, profile)
        is_state = isinstance(corpus, CorpusState)
        fitted = corpus.corpus(batch_id) if is_state else corpus
        moderated = judge(ruled, fitted, key, profile)
        shape(moderated).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if is_state:
            corpus.add(batch_id, corpus_texts(ruled, key), [key, "section"], corpus_words(F.col("text")))
            if fitted is not None:
                fitted.remove()
            if (batch_id + 1) % COMPACT_EVERY == 0:
                corpus.compact(batch_id - 1)
        removed(moderated, ruled)

    return (
        posts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
