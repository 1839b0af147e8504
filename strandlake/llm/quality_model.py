"""Quality classifier: supervised embeddings of hashed words and character n-grams (see ``subword``).

Letter case is kept, as shouting is part of what the labels mark.  The sample has more of class 1, and
with the low threshold of 0.3 that leans towards keeping.  Edge cases are those of ``subword.classify``.
"""

from pyspark.sql import DataFrame

from strandlake.llm.batches import table
from strandlake.llm.subword import Settings, classify

SETTINGS = Settings("quality", lower=False, shortest=2, longest=4, per_label=(1500, 2500), epochs=4)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), SETTINGS, 0.3)
