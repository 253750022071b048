"""From a CSV to its stored, cleaned and profiled table.

One path: find line breaks inside quotes, read the text with its row order, infer
types, validate; if the file is valid, clean it (drop all-null rows, fill medians and
'Unknown'), keep the cleaned table, and from the kept table its profile, filter
options and first-appearance encoders. Everything after the validation reads the
columnar table, not the CSV.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as C
from ..operators import features as FT
from ..operators import profile as P
from ..operators._long import col
from ..sources import csv as CSV
from ..sources import store as ST
from ..types import PROFILE, classify

#: Column of the kept table with the row's number in the file.
ROW = "_row"


@dataclass
class Ingested:
    """``valid``, ``message`` and ``checks`` of S3; for a valid file also the kept
    ``table`` (with ``ROW``), its ``card`` (C4), ``profile`` (S5) and ``encoders``."""

    valid: bool
    message: str
    checks: DataFrame
    table: DataFrame | None = None
    card: DataFrame | None = None
    profile: dict[str, DataFrame] | None = None
    encoders: DataFrame | None = None


def ingest(spark: SparkSession, path: str, store: str, dataset_id: str, multi_line: bool | None = None) -> Ingested:
    """Ingest a CSV (a file or a folder of them) as ``dataset_id`` of ``store``.

    An invalid file leaves the store as it is. A dataset that is there is replaced.
    """
    checks, raw = CSV.checked_csv(spark, path, multi_line, ROW)
    verdict = CSV.verdict(checks).first()
    if not verdict["valid"]:
        return Ingested(False, verdict["message"], checks)
    names = [c for c in raw.columns if c != ROW]
    cls = classify(raw.select(*[col(c) for c in names]), PROFILE)
    rows = C.drop_all_null(raw, names)
    cleaned = C.unknown_fill(C.median_fill(rows, list(cls.numeric)), list(cls.categorical))
    ST.save_frame(cleaned, store, "tables", dataset_id)
    table = ST.read_frame(spark, store, "tables", dataset_id)
    data = table.drop(ROW)
    ST.save_encoders(FT.first_appearance_codes(table, ROW, list(cls.categorical)), store, dataset_id)
    return Ingested(True, verdict["message"], checks, table, P.table_card(data),
                    ST.cached_profile(spark, data, store, dataset_id, refresh=True), ST.load_encoders(spark, store, dataset_id))
