"""One value per row out of packed fields, with its place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.packed import CATEGORIES, KEYWORDS, REFERENCES, Layout, split_packed
from citeloom.functions.text import pick

FIELDS: dict[str, Layout] = {"Keywords": KEYWORDS, "WoS Categories": CATEGORIES, "citing": REFERENCES}


def unpack_fields(df: DataFrame, id_column: str = "record_id", fields: Mapping[str, Layout] = FIELDS) -> DataFrame:
    """(id, field_name, pos INT, value): every value of every field, pos counted from 1.

    One scan and no shuffle: the fields are split into arrays in the row and exploded together.
    Null, empty and `[]` fields give no row; repeated rows and repeated values come out as often as
    they stand; a null id stays null; an empty table gives an empty result. Other columns of `df`
    are not read.
    """
    work = pick(df, {"id": id_column} | {f"f{i}": name for i, name in enumerate(fields)})
    for i, layout in enumerate(fields.values()):
        work = split_packed(work, f"f{i}", f"v{i}", layout)
    packed = F.array(*(F.struct(F.lit(name).alias("field_name"), F.col(f"v{i}").alias("vals")) for i, name in enumerate(fields)))
    return (
        work.select("id", F.explode(packed).alias("f"))
        .select("id", F.col("f.field_name").alias("field_name"), F.posexplode("f.vals").alias("pos", "value"))
        .select(F.col("id").alias(id_column), "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "value")
    )
