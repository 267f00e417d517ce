"""The training-data queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, near_duplicates, packing, pii_pseudonyms, pivot_search, quality, sql, url_filter, warc_bundle


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_warc_bundles": warc_bundle.query,
        "op3_url_filter": url_filter.query,
        "op4_mixture_packing": packing.query,
        "op5_quality_classifier": quality.query,
        "op6_decontaminate": decontaminate.query,
        "op7_near_duplicates": near_duplicates.query,
        "op8_pivot_topk": pivot_search.query,
        "op9_pii_pseudonyms": pii_pseudonyms.query,
        "op10_html_extract": html_extract.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_bundles": sql.WARC, "op6_decontaminate": sql.LEAKS, "op7_near_duplicates": sql.NEAR, "op3_url_filter": url_filter.SQL, "op8_pivot_topk": pivot_search.SQL}
