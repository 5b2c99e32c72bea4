"""C7 as a stream: requests tested against the logins of their user while both
arrive.

Logins and requests are two streams. A request meets the logins of its user
that are still valid at its time in a stream-stream interval join, and the
latest of them decides. Both streams have a watermark: events may come up to
``delay`` late, in any order of the two streams (a login that arrives after
its request still counts), and state leaves once it cannot match any more, a
login ``ttl`` after its time and a request at its own. A request's outcome is
final when the watermark has passed it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ehrflow.functions.scalars import ntz_lit

_EPOCH = dt.datetime(1970, 1, 1)


def authorised_stream(requests: DataFrame, logins: DataFrame, ttl_minutes: int = 30, delay: str = "10 minutes", key: str = "solicitud_id",
                      user: str = "usuario", ts: str = "ts", login_ts: str = "login_ts") -> DataFrame:
    """The stream of requests with ``login_ts`` (the latest valid login, NULL
    if none) and ``autorizado``, by the rule of
    :func:`ehrflow.operators.access.authorised_requests`:
    whole seconds, the end of the ttl included. Requests are told apart by
    ``key``, user and time."""
    wall = {f.name: f.dataType for f in [*requests.schema.fields, *logins.schema.fields]}
    ttl = F.expr(f"INTERVAL {ttl_minutes} MINUTES")
    req = requests.select(key, user, _instant(ts, wall[ts]).alias(ts)).withWatermark(ts, delay)
    lg = logins.select(F.col(user).alias("_user"), _instant(login_ts, wall[login_ts]).alias("_login")).withWatermark("_login", delay)
    # the bounds in full precision are what lets the state expire; the rule in whole seconds lies within them
    valid = ((F.col(user) == F.col("_user")) & (F.col("_login") <= F.col(ts)) & (F.col(ts) <= F.col("_login") + ttl + F.expr("INTERVAL 1 SECOND"))
             & (F.unix_seconds(F.col(ts)) <= F.unix_seconds(F.col("_login") + ttl)))
    met = req.join(lg, valid, "leftOuter")
    out = met.groupBy(key, user, ts).agg(F.max("_login").alias(login_ts))
    return out.select(key, user, _as_stored(ts, wall[ts]).alias(ts), _as_stored(login_ts, wall[login_ts]).alias(login_ts), F.col(login_ts).isNotNull().alias("autorizado"))


def _instant(c: str, dtype: T.DataType) -> Column:
    """Watermarks need an instant: a zone-less time is taken as UTC, whatever
    the session's zone."""
    if not isinstance(dtype, T.TimestampNTZType):
        return F.col(c)
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", ntz_lit(_EPOCH), F.col(c)))


def _as_stored(c: str, dtype: T.DataType) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(c)), ntz_lit(_EPOCH)) if isinstance(dtype, T.TimestampNTZType) else F.col(c)


def write_authorised(stream: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the outcomes to Parquet at ``out_dir``; progress and state live
    in ``checkpoint``, so a restarted query goes on where it stopped."""
    w = stream.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
