"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy (see ``subword``).

Texts are lower-cased; learned from at most ``per_label`` labelled documents a class.  Edge cases are those of
``subword.classify``.
"""

from pyspark.sql import DataFrame

from strandlake.llm.batches import table
from strandlake.llm.subword import Settings, classify

SETTINGS = Settings("toxic", lower=True)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), SETTINGS, 0.5)
