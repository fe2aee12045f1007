"""Fragments as a stream, grouped into units of about ``target`` words by source as they come.

The buffer of a source (its open unit) is the state; a unit leaves with the fragment that fills it. Within a trigger fragments are taken in
the order of their ids; across triggers as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNIT = "source string, unit string, n_words int, text string"


def grouped_units(fragments: DataFrame, target: int = 60) -> DataFrame:
    """(source, unit, n_words, text) of a stream (source, id, text); a null source is a source, empty texts are passed over.

    A rest that doesn't fill a unit stays in the buffer: ``blocks.group_documents`` settles it over what is at rest."""

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, words, texts = state.get if state.exists else (None, 0, [])
        texts, out = list(texts), []
        rows = pd.concat(list(batches))
        for i, text in rows.sort_values("id", kind="stable")[["id", "text"]].itertuples(index=False):
            if not text:
                continue
            if not texts:
                first = str(i)
            texts.append(text)
            words += len(text.split())
            if words >= target:
                out.append((key[0], f"{first}+{len(texts)}", words, "\n".join(texts)))
                first, words, texts = None, 0, []
        state.update((first, words, texts))
        yield pd.DataFrame(out, columns=["source", "unit", "n_words", "text"])

    return fragments.groupBy("source").applyInPandasWithState(fill, UNIT, "first string, words int, texts array<string>", "append", GroupStateTimeout.NoTimeout)
