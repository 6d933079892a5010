"""Overlap of masks with labelled atlases, and its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNASSIGNED = "Unassigned"


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def label_mask(mask: DataFrame, atlas: DataFrame) -> DataFrame:
    """Each mask voxel with its label, 0 outside the atlas."""
    return mask.select("vid").join(atlas.select("vid", "label"), "vid", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def overlap_totals(mask: DataFrame, atlas: DataFrame) -> DataFrame:
    """total_voxels, outside_voxels and assigned_voxels of a mask."""
    total, outside = F.count(F.lit(1)), F.count_if(F.col("label") == 0)
    return label_mask(mask, atlas).agg(total.alias("total_voxels"), outside.alias("outside_voxels"), (total - outside).alias("assigned_voxels"))


def parcel_overlap(mask: DataFrame, atlas: DataFrame) -> DataFrame:
    """label, parcel_size, voxels, fraction_of_parcel, fraction_of_lesion of every parcel that the mask touches.

    The lesion's denominator counts its voxels outside the atlas too; an empty mask gives no rows.
    """
    sizes = atlas.where("label <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("parcel_size"))
    hits = label_mask(mask, atlas).groupBy("label").agg(F.count(F.lit(1)).alias("voxels"))
    total = hits.agg(F.sum("voxels").alias("total"))
    out = hits.where("label <> 0").join(sizes, "label").crossJoin(F.broadcast(total))  # one row
    return out.select(
        "label", "parcel_size", "voxels",
        ratio(F.col("voxels"), F.col("parcel_size")).alias("fraction_of_parcel"),
        ratio(F.col("voxels"), F.col("total")).alias("fraction_of_lesion"),
    )


def name_parcels(parcels: DataFrame, names: DataFrame) -> DataFrame:
    """Adds parcel and network names, ``Parcel <n>`` and Unassigned where the dictionary has none."""
    out = parcels.join(names.select("label", "parcel", "network"), "label", "left")
    return out.withColumn("parcel", F.coalesce("parcel", F.concat(F.lit("Parcel "), "label"))).withColumn("network", F.coalesce("network", F.lit(UNASSIGNED)))


def network_rollup(parcels: DataFrame, names: DataFrame) -> DataFrame:
    """network, voxels, fraction (of the lesion) and the sorted labels of each network."""
    return name_parcels(parcels, names).groupBy("network").agg(
        F.sum("voxels").alias("voxels"), F.sum("fraction_of_lesion").alias("fraction"), F.sort_array(F.collect_set("label")).alias("parcels")
    )


def hierarchy(parcels: DataFrame, names: DataFrame) -> DataFrame:
    """Voxels by network and parcel with totals, as a rollup."""
    return name_parcels(parcels, names).rollup("network", "label").agg(F.sum("voxels").alias("voxels"))


def label_sizes(atlas: DataFrame, names: DataFrame, by: str = "parcel") -> DataFrame:
    """Voxels of each named label or network; labels without a name are left out."""
    return atlas.join(names, "label").groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("voxels"))


def order_parcels(parcels: DataFrame) -> DataFrame:
    return parcels.orderBy(F.desc("voxels"), "label")


def order_networks(summary: DataFrame) -> DataFrame:
    """Most voxels first, ties by name in locale order."""
    return summary.orderBy(F.desc("voxels"), F.collate("network", "UNICODE"))


def unassigned_last(summary: DataFrame, *then: Column) -> DataFrame:
    return summary.orderBy(F.col("network") == UNASSIGNED, *then)


def direct_overlap(mask: DataFrame, atlas: DataFrame, names: DataFrame, least: float = 1) -> DataFrame:
    """The report table: networks with voxels, fraction, size of the network and the share of it that is hit."""
    from .elementwise import min_voxels

    summary = min_voxels(network_rollup(parcel_overlap(mask, atlas), names), least)
    sizes = label_sizes(atlas, names, "network").select(F.col("name").alias("network"), F.col("voxels").alias("network_size"))
    return summary.join(sizes, "network", "left").withColumn("fraction_of_network", F.col("voxels") / F.col("network_size"))


def overlap_csv(table: DataFrame) -> DataFrame:
    """One column ``line``: the export with its header, four decimals, empty cells for unknown sizes, Unassigned last."""
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit(""))
    whole = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    size = F.when(F.col("network_size").isNull(), F.lit("")).otherwise(number("fraction_of_network"))
    parcels = F.array_join(F.transform("parcels", lambda p: p.cast("string")), ";")
    line = F.concat_ws(",", "network", whole("voxels"), number("fraction"), whole("network_size"), size, parcels)
    rows = table.select((F.col("network") == UNASSIGNED).cast("int").alias("last"), (-F.col("voxels")).alias("rank"), "network", line.alias("line"))
    header = table.sparkSession.createDataFrame([(-1, 0, "", "network,voxels,fraction,network_size,fraction_of_network,parcels")], "last int, rank long, network string, line string")
    return header.unionByName(rows).orderBy("last", "rank", "network").select("line")


def percent_table(table: DataFrame, column: str = "fraction") -> DataFrame:
    """Adds ``pct``, the fraction in percent with one decimal."""
    return table.withColumn("pct", F.format_string("%.1f", F.col(column) * 100))
