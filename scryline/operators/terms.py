"""Many terms in many texts (IDs J22, J23, O16, O18, P08, F37): one pass over a text for all terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Characters of terms that are broadcast at a time; more terms are gone through in blocks, each a pass over the texts.
BLOCK_CHARS = 16_000_000


class Matcher:
    """Terms as an automaton: the time for a text doesn't depend on how many terms there are."""

    def __init__(self, terms: list[str]):
        self.terms, self._automaton = terms, None

    def __getstate__(self):
        return {"terms": self.terms, "_automaton": None}

    def __call__(self, text: str) -> list[str]:
        """The different terms that the text holds, in order."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t in self.terms:
                if t:
                    self._automaton.add_word(t, t)
            self._automaton.make_automaton()
        found = {t for _, t in self._automaton.iter(text)} if len(self._automaton) else set()
        return sorted(found | ({""} if "" in self.terms else set()))


def _held(shared):
    @F.pandas_udf("array<string>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[] if t is None else shared.value(t) for t in texts])

    return held


def held_terms(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """rows with `terms`: the different terms (term) that the text, lower-cased, holds, in order; a null text holds none. An empty term is in every text."""
    wanted = terms.select("term").where("term is not null").distinct()
    blocks = max(1, -(-(wanted.agg(F.sum(F.length("term"))).first()[0] or 0) // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        shared = rows.sparkSession.sparkContext.broadcast(Matcher(sorted(r[0] for r in some.collect())))  # BLOCK_CHARS, give or take

        found = _held(shared)(F.lower(text))
        out = rows.withColumn("terms", found) if out is None else out.withColumn("terms", F.concat("terms", found))
    return out if blocks == 1 else out.withColumn("terms", F.array_sort("terms"))
