"""Stream-static retrieval: arriving questions get their top-k demonstrations per micro-batch.

The pool is static: its tokens are written once when the query starts. Each micro-batch is written to its own
``epoch_id=<n>`` folder in overwrite mode, so a replayed batch after a failure
rewrites the same output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotloom.functions import text as T
from shotloom.operators import retrieve as R
from shotloom.operators.common import stored


def start_stream_retrieval(questions: DataFrame, pool: DataFrame, k: int, sink_path: str,
                           checkpoint_location: str, id_col: str = "item_id", text_col: str = "text",
                           pool_id: str = "doc_id", pool_text: str = "text",
                           available_now: bool = True) -> StreamingQuery:
    """Start the query; ``questions`` is a streaming DataFrame with (id, text)."""
    # the pool is read and tokenised once, not for each micro-batch
    p = stored(pool.select(F.col(pool_id).alias("idx"), T.tokens(pool_text).alias("toks")), "stream-pool")

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        t = batch.select(F.col(id_col).alias("idx"), T.tokens(text_col).alias("toks"))
        out = R.jaccard(t, p, k)
        out.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch_id={epoch_id}")

    w = questions.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
