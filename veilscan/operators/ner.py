"""Hook for a statistical named-entity model: text to PERSON, LOCATION and DATE_TIME spans.

No model ships with the engine. A caller hands in a factory; the model is built once per
Python worker and fed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT, Settings
from veilscan.operators.spans import SCORE

# text -> (label, start, end, score)
Tagger = Callable[[str], Iterable[tuple[str, int, int, float]]]


def with_ner_spans(docs: DataFrame, factory: Callable[[], Tagger], settings: Settings = DEFAULT,
                   text_col: str = "text") -> DataFrame:
    """The documents plus ``ner_spans``: candidates of a tagger, in the shape of ``spans``."""

    @F.pandas_udf("array<struct<label:string,start:int,end:int,score:double>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = factory()
        for texts in batches:
            yield texts.map(lambda t: [
                {"label": label, "start": start, "end": end, "score": score}
                for label, start, end, score in (tagger(t) if t and t.strip() else ())])

    kinds = F.create_map(*[F.lit(x) for pair in fv.NER_LABELS.items() for x in pair])
    wanted = [e for e in settings.entities if e in fv.NER_TYPES]
    text = F.col(text_col)

    def shape(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.try_element_at(kinds, s["label"]).alias("entity_type"),
            s["score"].cast(SCORE).alias("score"), F.lit(False).alias("weak_card"),
            F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"))

    least = F.lit(settings.min_score).cast(SCORE)
    shaped = F.filter(F.transform(F.col("_tagged"), shape),
                      lambda s: s["entity_type"].isin(*wanted) & (s["score"] >= least))
    return docs.withColumn("_tagged", tag(text)).withColumn("ner_spans", shaped).drop("_tagged")
