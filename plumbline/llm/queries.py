"""The llm queries, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import groups, leaks, packing, splits, survivors, tone
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups that must stay with a group of smaller key."""
    _, _, linked = splits.split_related(table(spark, d, "observations"))
    return linked.where("group_key <> block").select(F.col("block").alias("block_group_id"), F.col("group_key").alias("group_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The label of every observation."""
    rows, _, _ = splits.split_related(table(spark, d, "observations"))
    return rows.select("obs_no", "orbit_label", "block", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """How closely the shares are met in every orbit."""
    rows, _, _ = splits.split_related(table(spark, d, "observations"))
    return splits.split_shares(rows)


def p1_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Whether every orbit's shares are met to within a block, and no block is divided."""
    rows, _, _ = splits.split_related(table(spark, d, "observations"))
    return splits.split_quotas(rows)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The row that supplies each field of each station with several rows."""
    won = survivors.elect(survivors.long_rows(table(spark, d, "stations")), "precedence")
    return won.select("station_key", "field_name", "solution_no")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record for each such station, by summed votes."""
    return survivors.survivors(survivors.elect(survivors.long_rows(table(spark, d, "stations"))))


def _groups(spark: SparkSession, d: str, every: bool) -> DataFrame:
    matches, values, stations = (table(spark, d, t) for t in ("station_matches", "station_values", "stations"))
    keys = groups.all_station_keys((stations, "station_id"), (values, "station_id"), (matches, "station_a"), (matches, "station_b")) if every else None
    return groups.consolidate(groups.station_links(matches, values), keys)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every station that is not the smallest of its group, with the smallest."""
    return _groups(spark, d, False).where("group_key <> station_key")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every station, those that nothing links included."""
    return _groups(spark, d, True)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every piece of every document."""
    return packing.pack(packing.measure(table(spark, d, "documents")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Fill of the containers and shares of the sources."""
    return packing.fill_report(p6_containers(spark, d))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How closely the containers follow the shares of the sources, window by window."""
    return packing.mixture(p6_containers(spark, d))


def p6_promises(spark: SparkSession, d: str) -> DataFrame:
    """That every text is placed once and whole, within the capacity and tightly."""
    measured = cut(packing.measure(table(spark, d, "documents")))
    return packing.promises(measured, cut(packing.pack(measured)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return leaks.leaks_by_item(leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language, by kind."""
    return tone.tone_cases(tone.tone_scores(table(spark, d, "documents")))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every document."""
    return tone.tone_scores(table(spark, d, "documents"))


def p8_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of such documents by source."""
    return tone.tone_rates(tone.tone_scores(table(spark, d, "documents")))


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    """The kinds found in the labelled snippets, with the parameters of p8_found."""
    own = table(spark, d, "tone_labels").select(F.col("label_id").alias("doc_id"), F.lit("labels").alias("source"), F.col("snippet").alias("text"))
    return tone.tone_cases(tone.tone_scores(own)).withColumnRenamed("doc_id", "label_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, and whether all rates of it are shares of them."""
    r = tone.tone_rates(tone.tone_scores(table(spark, d, "documents")))
    sound = F.lit(True)
    for n in tone.NAMES:
        sound = sound & (F.col(f"n_{n}") <= F.col("n_documents")) & (F.abs(F.col(f"{n}_rate") - F.col(f"n_{n}") / F.col("n_documents")) < 1e-6) & (F.col(f"mean_{n}_score") >= 0)
    return r.select("source", "n_documents", sound.alias("sound"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_shares, p1_quotas, p2_found, p2_survivors, p3_found, p3_groups, p6_containers, p6_report, p6_mixture, p6_promises, p7_found, p7_items, p8_found, p8_scores, p8_source_rates, p8_labels, p8_sources,
    )
}
