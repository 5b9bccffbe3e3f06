"""A lexicon as a table: bucketed and sorted by form, with what its view needs in the table's properties.

Lookups by form then shuffle the words asked for and never the lexicon.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.lookups import Lexicon
from morphlake.schema import AUGMENTED
from morphlake.storage import shared_folder


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_lexicon(rows: DataFrame, mark_order: DataFrame, first_local_id: int | None = None, template: DataFrame | None = None, name: str | None = None, buckets: int | None = None) -> str:
    """Write rows as a table and return its name.

    The properties have the largest id, the first local id (by default the next thousand above the largest), the order of
    tags and the adjectives' template; the latter two are fixed small tables.  buckets: by default as many as shuffles have partitions.
    """
    spark = rows.sparkSession
    name = name or f"lexicon_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_form = rows.select(*AUGMENTED).repartition(buckets, "bmynd").sortWithinPartitions("bmynd")
    by_form.write.bucketBy(buckets, "bmynd").sortBy("bmynd").option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    largest = spark.table(name).agg(F.max("bin_id")).first()[0] or 0
    order = [[r.ofl, r.mark] for r in mark_order.orderBy("ofl", "pos").select("ofl", "mark").collect()]
    endings = [[r.ending, r.mark] for r in template.orderBy("seq").select("ending", "mark").collect()] if template is not None else []
    properties = {"largest_id": largest, "first_local_id": first_local_id if first_local_id is not None else (largest + 1999) // 1000 * 1000, "mark_order": order, "template": endings}
    given = ", ".join(f"{_quoted(f'lexicon.{k}')} = {_quoted(json.dumps(v))}" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({given})")
    return name


def read_lexicon(spark: SparkSession, name: str, parts: DataFrame | None = None) -> Lexicon:
    """The lexicon of a table that write_lexicon made."""
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    value = lambda k: json.loads(found[f"lexicon.{k}"])
    places: dict[str, int] = {}
    order = []
    for ofl, mark in value("mark_order"):
        order.append((ofl, mark, places.get(ofl, 0)))
        places[ofl] = places.get(ofl, 0) + 1
    template = [(ending, mark, k) for k, (ending, mark) in enumerate(value("template"))]
    return Lexicon(
        spark.table(name),
        int(value("first_local_id")),
        spark.createDataFrame(order, "ofl string, mark string, pos int"),
        spark.createDataFrame(template, "ending string, mark string, seq int") if template else None,
        parts,
    )
