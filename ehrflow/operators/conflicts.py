"""Conflicts inside a batch of inserts: rows that share a document or an
e-mail, taken in order, an accepted row blocking every later one.

The rows are the edges of a bipartite graph (documents and e-mails). What one
component accepts does not depend on the others, so each component is replayed
in order by one task, whatever the length of its chains. Before that, a few
rounds over all rows take the easy ones: a row that is first in both its groups
is accepted, those sharing a key with it are rejected; a batch without chains
is done then. A component with more rows than ``max_component`` goes on in
rounds, and is looked at again when it has fallen apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.session import drop_path, shared_table

ROUNDS = 3
MAX_COMPONENT = 100_000


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v: long): the smallest
    node reachable. Large stars and small stars in turn: every node's larger
    neighbours, then its smaller ones, are tied to the smallest neighbour,
    until each node is tied to its component's smallest; a logarithm of the
    longest path in steps. Minima are partial aggregates and are written before
    they are joined, so a node with very many edges is split."""
    spark, step = edges.sparkSession, 0
    edges = shared_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges{step}")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{folder}/large{step}")
        large = shared_table(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"{folder}/tied{step}")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = shared_table(down.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/small{step}")
        tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        step += 1
        after = shared_table(tied.filter("u <> v").distinct(), f"{folder}/edges{step}")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in ("edges", "large", "tied", "small"):
            drop_path(spark, f"{folder}/{old}{step - 1}")
        edges = after
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def _by_component(undecided: DataFrame, folder: str, max_component: int) -> tuple[DataFrame, DataFrame]:
    """The rows that the components of up to ``max_component`` rows accept,
    and the rows of the larger ones, still undecided. Nodes are hashes; two
    that collide only make one component of two."""
    node = lambda kind, key: F.xxhash64(F.lit(kind), F.col(key))
    found = shared_table(connected(undecided.select(node("d", "documento_id").alias("u"), node("e", "_ek").alias("v")), folder), f"{folder}/components")
    tagged = undecided.withColumn("node", node("d", "documento_id")).join(found, "node", "left")
    tagged = shared_table(tagged.withColumn("component", F.coalesce("component", "node")).drop("node"), f"{folder}/tagged")
    large = shared_table(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_component).select("component"), f"{folder}/large")
    keys = tagged.join(large, "component", "left_anti").select("component", "documento_id", "_ek", "_ord.*")

    def replay(rows):
        documents, mails, taken = set(), set(), []
        for rid, document, mail in rows.sort_values(["n", "s", "h", "r"])[["r", "documento_id", "_ek"]].itertuples(index=False):
            if document not in documents and mail not in mails:
                documents.add(document)
                mails.add(mail)
                taken.append(rid)
        return rows.__class__({"_rid": taken})

    taken = keys.groupBy("component").applyInPandas(replay, "_rid long")
    return (undecided.join(taken, "_rid", "left_semi"),
            tagged.join(large, "component", "left_semi").select(*undecided.columns))


def _round(undecided: DataFrame, no_mail: Column, folder: str, first: bool) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and what is undecided after them."""
    dmin = undecided.groupBy("documento_id").agg(F.min("_ord").alias("_dmin"))
    emin = undecided.filter(~no_mail).groupBy("_ek").agg(F.min("_ord").alias("_emin"))
    if first:                                                                  # groups are largest now
        dmin, emin = shared_table(dmin, f"{folder}/documents"), shared_table(emin, f"{folder}/emails")
    first_without = undecided.filter(no_mail).agg(F.min("_ord").alias("_emin"))                   # one row
    ranked = undecided.filter(~no_mail).join(emin, "_ek").unionByName(undecided.filter(no_mail).crossJoin(F.broadcast(first_without)))
    ranked = ranked.join(dmin, "documento_id").select(*undecided.columns, ((F.col("_ord") == F.col("_dmin")) & (F.col("_ord") == F.col("_emin"))).alias("_won"))
    state = shared_table(ranked, f"{folder}/state")
    won = state.filter("_won").drop("_won")
    left = (state.filter(~F.col("_won")).drop("_won").join(won.select("documento_id"), "documento_id", "left_anti")
            .join(won.select("_ek"), "_ek", "left_anti").select(*undecided.columns))
    return won, left


def accepted_rows(undecided: DataFrame, no_mail: Column, folder: str, rounds: int = ROUNDS, max_component: int = MAX_COMPONENT) -> DataFrame:
    """The rows of ``undecided`` (_rid, documento_id, _ek, _ord) that are
    accepted. ``no_mail`` is true of rows without an e-mail, which are one
    group."""
    spark, done, schema = undecided.sparkSession, 0, undecided.schema
    while True:
        won, undecided = _round(undecided, no_mail, f"{folder}/round{done}", first=not done)
        won.write.mode("overwrite").parquet(f"{folder}/accepted/round={done}")
        done += 1
        if undecided.isEmpty():
            break
        if done % rounds == 0:
            undecided = shared_table(undecided, f"{folder}/left{done}")
            won, undecided = _by_component(undecided, f"{folder}/graph{done}", max_component)
            won.write.mode("overwrite").parquet(f"{folder}/accepted/round={done}c")
            if undecided.isEmpty():
                break
    return spark.read.schema(schema).parquet(f"{folder}/accepted")
