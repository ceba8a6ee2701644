"""Follow a folder of manifests and ingest the files each one lists.

The file source remembers which manifests were done, so every run picks up
the new ones and stops. A batch that is run again after a failure changes nothing twice: the catalog upsert is idempotent,
and the batch goes by a name made of the stream's progress folder and its number, which the table's log remembers together with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from statloom.plans.ingest import ingest
from statloom.schemas import MANIFEST_TYPES


def follow_manifests(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    table_path: str,
    catalog_path: str,
    progress_path: str,
    delimiter: str = "\t",
    with_pvalue: bool = True,
    manifests_per_batch: int = 100,
) -> StreamingQuery:
    """Start an ingest of all manifests not seen before; `columns` is their common header."""
    schema = ", ".join(f"`{c}` {MANIFEST_TYPES.get(c, 'string')}" for c in columns)
    arriving = (
        spark.readStream.schema(schema)
        .option("sep", delimiter)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", manifests_per_batch)
        .csv(folder)
    )

    def store(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            name = f"{progress_path.rstrip('/')}#{number}"
            ingest(batch, table_path, catalog_path, with_pvalue=with_pvalue, dedup=True, batch=name)

    writer = arriving.writeStream.foreachBatch(store).trigger(availableNow=True)
    return writer.option("checkpointLocation", progress_path).start()
