"""Putting an operator's decisions into effect on the documents themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import BROADCAST_ROWS, fresh_name, write_out

def keep_without(documents: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose key is not in ``rejected`` (a null key is matched by a null). The ids are counted first:
    up to BROADCAST_ROWS of them are broadcast, more are shuffled."""
    name = fresh_name(documents.columns, "rejected")
    ids = write_out(rejected.select(F.col(key).alias(name)).distinct(), "rejected")
    hint = "broadcast" if ids.count() <= BROADCAST_ROWS else "shuffle_merge"
    return documents.join(ids.hint(hint), documents[key].eqNullSafe(ids[name]), "left_anti")
