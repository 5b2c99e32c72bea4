"""M1: continuous encounter inserts.

New-encounter commands arriving as JSON lines are read by the rules of the
batch commands (:func:`ehrflow.sources.commands.tagged`), then validated and
enriched by the same DataFrame operations as the batch insert
(:func:`ehrflow.operators.writes.encounter_outcomes`), joined to the patient
and user tables as they are when the micro-batch runs. Accepted and rejected
commands go to one parquet sink with an ``estado`` column; a rejected one
keeps its line (``linea``) as it came. Progress lives in
the checkpoint folder, so a restarted query resumes where it stopped and a
lost executor only retries its task; encounter keys are content hashes, so a
replayed file produces the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ehrflow.functions.scalars import now_utc
from ehrflow.operators.writes import REASON_MISSING, encounter_outcomes
from ehrflow.sources.commands import MISSING, NEW_ENCOUNTER, tagged

OUTPUT_COLUMNS = ["documento_id", "seq", "estado", "motivo", "atencion_id", "fecha_hora_atencion",
                  "tipo_atencion", "motivo_consulta", "enfermedad_actual", "impresion_diagnostica",
                  "conducta_plan_manejo", "alergias_conocidas", "responsable_registro", "linea"]


def encounter_results(commands: DataFrame, patients: DataFrame, users: DataFrame, as_of_utc) -> DataFrame:
    """Every command (rows of :func:`tagged`) with its outcome, in the sink's
    columns. A line that cannot be read, or has a value of a wrong type or
    length, is rejected for that; then come the checks of the request, of
    which the required fields are one. Of a line refused when it was read the
    key and the number are kept beside the line."""
    read = F.col("motivo").isNull() | (F.col("motivo") == MISSING)
    checked = encounter_outcomes(patients, commands.filter(read).withColumnRenamed("motivo", "_read"), users, as_of_utc)
    late = F.when(F.col("estado") == "aceptado", F.col("_read")).isNotNull()          # nothing missing but ``seq``
    checked = checked.withColumns({"motivo": F.when(late, REASON_MISSING).otherwise(F.col("motivo")), "estado": F.when(late, "rechazado").otherwise(F.col("estado"))})
    refused = commands.filter(~read).select("documento_id", "seq", "motivo", "linea", F.lit("rechazado").alias("estado"))
    out = checked.unionByName(refused, allowMissingColumns=True)
    accepted = F.col("estado") == "aceptado"
    made = ("atencion_id", "fecha_hora_atencion", "responsable_registro")
    return out.withColumns({"linea": F.when(~accepted, F.col("linea")), **{c: F.when(accepted, F.col(c)) for c in made}}).select(*OUTPUT_COLUMNS)


def encounter_stream(spark: SparkSession, in_dir: str, tables: Callable[[], tuple[DataFrame, DataFrame]],
                     out_dir: str, checkpoint: str, as_of_utc=None, available_now: bool = True,
                     max_files_per_trigger: int = 1000, dedup_within: str | None = None) -> StreamingQuery:
    """Start the stream from ``in_dir`` to parquet at ``out_dir`` (one folder
    ``lote=<number>`` for each micro-batch, overwritten if it is run again).

    ``tables`` returns the patient and the user table; it is called for each
    micro-batch, so patients and clinicians registered since the start count
    (a DataFrame read once would keep the files it found then).

    ``as_of_utc=None`` stamps each micro-batch with its own time (the
    reference stamps "now"); a fixed value makes replays reproducible.
    ``available_now`` processes what is there and stops; otherwise it polls
    every 10 seconds.

    Every command makes a new encounter, as in the reference. With
    ``dedup_within`` (for example ``"1 hour"``) a command repeated with the
    same content (all fields but ``seq``; a refused line: the line) within that time of its first
    arrival is dropped; the de-duplication state is bounded by a watermark
    on the arrival time.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(in_dir)
    src = tagged(lines.select(F.col("value").alias("linea")), "encounter")
    if dedup_within:
        content = [c for c in NEW_ENCOUNTER.fieldNames() if c != "seq"]
        src = (src.withColumn("_arrival", F.current_timestamp())
               .withColumn("_refused", F.when(F.col("motivo").isNotNull(), F.col("linea")))
               .withWatermark("_arrival", dedup_within)
               .dropDuplicatesWithinWatermark([*content, "_refused"])
               .drop("_arrival", "_refused"))

    def write(commands: DataFrame, batch_id: int) -> None:
        patients, users = tables()
        stamp = as_of_utc if as_of_utc is not None else now_utc()
        encounter_results(commands, patients, users, stamp).write.mode("overwrite").parquet(f"{out_dir}/lote={batch_id}")

    w = src.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
