"""The queries and SQL of the training-data operators."""

from __future__ import annotations

from . import op1_jaccard, op2_quality, op3_pii, op4_language, op5_media, op6_records, op7_mixing, op8_knn, op9_packing, op10_toxicity

QUERIES = {
    "op1_jaccard_join": op1_jaccard.query,
    "op2_quality": op2_quality.query,
    "op3_pii": op3_pii.query,
    "op4_language_id": op4_language.query,
    "op5_media": op5_media.query,
    "media_page_items": op5_media.pages_query,
    "media_pages_resolved": op5_media.resolved_pages_query,
    "op6_binary_records": op6_records.query,
    "op7_mixing": op7_mixing.query,
    "op8_voronoi_knn": op8_knn.query,
    "op9_best_fit_packing": op9_packing.query,
    "op10_toxicity": op10_toxicity.query,
}
ORACLES = {
    "op7_mixing": op7_mixing.SQL,
    "op8_voronoi_knn": op8_knn.SQL,
}
