"""Queries of the text operators and their SQL."""

from __future__ import annotations

from geoquill.llm import centroids, decontam, jaccard, langid, linededup, lmscore, maintext, media, mixing, resample, secrets, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_url_filter": urlfilter.op2_url_filter,
        "op3_language_id": langid.op3_language_id,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_media_column": media.op5_media_column,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_lm_score": lmscore.op7_lm_score,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_decontaminate": decontam.op10_decontaminate,
        "op11_resample": resample.op11_resample,
        "op12_html_extract": maintext.op12_html_extract,
        "op13_centroid_clusters": centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.OP4_SQL, "op6_jaccard_join": jaccard.OP6_SQL, "op8_line_dedup": linededup.OP8_SQL, "op11_resample": resample.OP11_SQL, "op13_centroid_clusters": centroids.OP13_SQL}
