"""Note graphs as records with links: resolution, edges, one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_links(notes: DataFrame) -> DataFrame:
    """sample_id, record_id, link_pos, target_id. notes: sample_id, record_id, pos, links (strings; whole numbers in range are positions)."""
    link = notes.select("sample_id", "record_id", F.posexplode("links").alias("link_pos", "link"))
    place = notes.select("sample_id", F.col("pos").cast("string").alias("link"), F.col("record_id").alias("at"))
    return link.join(place, ["sample_id", "link"], "left").select("sample_id", "record_id", "link_pos", F.coalesce("at", "link").alias("target_id"))


def edges(resolved: DataFrame) -> DataFrame:
    """Edges of the note graph; targets that don't exist are allowed."""
    return resolved.select("sample_id", F.concat("record_id", F.lit("->"), "target_id").alias("edge_id"), F.col("record_id").alias("source_id"), "target_id", F.lit("amem_link").alias("type"), "link_pos")


def nodes(notes: DataFrame) -> DataFrame:
    return notes.select("sample_id", F.col("record_id").alias("node_id"), F.lit("amem_note").alias("type"), "text", F.lit("amem_notes").alias("layer"), F.struct("context", "keywords").alias("properties"), "pos")


def layers(notes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One layer for each sample with its node and edge ids in order."""
    ids = notes.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record_id"))), lambda x: x["record_id"]).alias("node_ids"))
    placed = edge_rows.join(notes.select("sample_id", F.col("record_id").alias("source_id"), "pos"), ["sample_id", "source_id"])
    links = placed.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_pos", "edge_id"))), lambda x: x["edge_id"]).alias("edge_ids"))
    return ids.join(links, "sample_id", "left").select("sample_id", F.lit("amem_notes").alias("name"), "node_ids", F.coalesce("edge_ids", F.array().cast("array<string>")).alias("edge_ids"))


def expand(items: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """Items and their neighbours: sample_id, question_id, record_id, rank, source_id.

    items: sample_id, question_id, record_id, rank. Links to missing records and to selected items are dropped; of several sources of a neighbour the
    first counts; neighbours follow in the order of their sources and links. One hop."""
    # An item and its links come from one row, so the plan that ranked the items stands here once.
    out = links.groupBy("sample_id", "record_id").agg(F.array_sort(F.collect_list(F.struct("link_pos", "target_id"))).alias("_links"))
    own = F.struct(F.lit(0).alias("hop"), F.lit(-1).alias("link_pos"), F.col("record_id").alias("at"))
    near = F.transform(F.coalesce("_links", F.array().cast(out.schema["_links"].dataType)), lambda x: F.struct(F.lit(1).alias("hop"), x["link_pos"].cast("int").alias("link_pos"), x["target_id"].alias("at")))
    rows = items.select("sample_id", "question_id", "record_id", "rank").join(out, ["sample_id", "record_id"], "left")
    rows = rows.select("sample_id", "question_id", F.col("record_id").alias("source_id"), "rank", F.explode(F.concat(F.array(own), near)).alias("x"))
    rows = rows.select("sample_id", "question_id", "source_id", "rank", "x.hop", "x.link_pos", F.col("x.at").alias("record_id"))
    held = records.select("sample_id", "record_id").withColumn("_held", F.lit(True))
    rows = rows.join(held, ["sample_id", "record_id"], "left").where((F.col("hop") == 0) | F.col("_held"))
    # Of a record's rows in a question the selected item comes first, then the first of its sources.
    order = ["hop", "rank", "link_pos"]
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "record_id").orderBy(*order))).where((F.col("hop") == 0) | (F.col("_n") == 1))
    whole = Window.partitionBy("question_id")
    base, items_before = F.max(F.when(F.col("hop") == 0, F.col("rank"))).over(whole), F.count(F.when(F.col("hop") == 0, True)).over(whole)
    place = F.row_number().over(whole.orderBy(*order))
    after = F.col("hop") == 1
    return once.withColumns({"_r": place, "_base": base, "_items": items_before}).select(
        "sample_id", "question_id", "record_id", F.when(after, F.col("_base") + F.col("_r") - F.col("_items")).otherwise(F.col("rank")).cast("int").alias("rank"), F.when(after, F.col("source_id")).alias("source_id"),
    )


def expand_capped(items: DataFrame, links: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """After each item the first k + 1 of its links, repeats allowed: sample_id, question_id, record_id, place, hop."""
    near = items.join(links.where(F.col("link_pos") <= k), ["sample_id", "record_id"]).select("sample_id", "question_id", "rank", F.lit(1).alias("hop"), "link_pos", F.col("target_id").alias("record_id")).join(records.select("sample_id", "record_id"), ["sample_id", "record_id"], "left_semi")
    every = items.select("sample_id", "question_id", "rank", F.lit(0).alias("hop"), F.lit(-1).alias("link_pos"), "record_id").unionByName(near)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "hop", "link_pos")))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """sample_id, node_id, out_degree, in_degree of the simple graph: parallel edges collapse, unknown ends become nodes."""
    simple = edge_rows.select("sample_id", "source_id", "target_id").distinct()
    ends = simple.select("sample_id", F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(simple.select("sample_id", F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("sample_id", "node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
