"""Dense vectors of texts: signed feature hashing, and a plug-in for a model that is set up once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sangloc.functions.metrics import run_lengths

#: A model: a list of texts to as many vectors.
Embedder = Callable[[list[str]], list[list[float]]]

DIMENSIONS = 256
#: Texts that a model gets at a time.
TEXTS_AT_ONCE = 256


def hashed_vector(words: Column, dimensions: int = DIMENSIONS) -> Column:
    """Token counts hashed to a vector of fixed length, each token with a sign of its own, so that collisions cancel on average.

    Place and sign come from a token's MD5, which any other engine gives too.  An empty array gives the zero
    vector, a null one null.
    """

    def slot(word: Column) -> Column:
        """Twice the place, and one more for a negative sign."""
        digest = F.md5(word)
        place = F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % dimensions
        return place * 2 + F.conv(F.substring(digest, 8, 1), 16, 10).cast("int") % 2

    # Every slot once more than it is hit, so that the runs are all slots in order.
    slots = F.concat(F.sequence(F.lit(0), F.lit(2 * dimensions - 1)), F.transform(words, slot))

    def signed(counts: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(dimensions - 1))
        return F.transform(places, lambda i: (F.get(counts, 2 * i)["n"] - F.get(counts, 2 * i + 1)["n"]).cast("double"))

    return F.when(words.isNotNull(), F.transform(F.array(run_lengths(slots)), signed)[0])


def embedded(text: Column, load: Callable[[], Embedder]) -> Column:
    """Vectors of texts by a model; `load` runs once in each task, a null text gives a null vector."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            known = texts[texts.notna()]
            for start in range(0, len(known), TEXTS_AT_ONCE):
                part = known.iloc[start : start + TEXTS_AT_ONCE]
                for at, vector in zip(part.index, model(part.tolist())):
                    out.at[at] = [float(x) for x in vector]
            yield out

    return vectors(text)
