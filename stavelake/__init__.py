"""Page-layout analytics for score corpora, expressed as Spark DataFrame operators."""

KEYS = ("score_id", "page_index")
