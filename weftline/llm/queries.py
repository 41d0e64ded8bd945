"""Registered queries of this subpackage."""

from __future__ import annotations

from weftline.llm.decontaminate import op10_benchmark_decontamination
from weftline.llm.hmm import op2_hmm_language_model
from weftline.llm.license_scan import op1_license_scan
from weftline.llm.line_dedup import op5_line_dedup
from weftline.llm.packing import op4_best_fit_packing
from weftline.llm.quality import op9_quality_rules
from weftline.llm.simhash import op7_simhash_near_duplicates
from weftline.llm.suffix_dedup import op8_suffix_dedup
from weftline.llm.toxicity import op3_toxicity_segments
from weftline.llm.warc import op6_warc_chunks

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_hmm_language_model, op3_toxicity_segments, op4_best_fit_packing, op5_line_dedup, op6_warc_chunks, op7_simhash_near_duplicates, op8_suffix_dedup, op9_quality_rules, op10_benchmark_decontamination)}
ORACLES: dict[str, str] = {
    "op6_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             q AS (SELECT page_id, strlen(html) AS n, sha256(html) AS d FROM p),
             r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
            CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM r""",
}
