"""Table schemas of the linkage engine."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])
CANDIDATES = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("candidate_entity_ids", T.StringType())])
RESULTS = TRUTH
