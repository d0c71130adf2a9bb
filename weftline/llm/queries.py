"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from weftline.llm import best_fit, chat_format, clustering, fingerprint, jaccard_join, language_id, license_scan, media, mixing, packing, quality, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_media": media.op2_media,
    "op3_quality": quality.op3_quality,
    "op4_language_id": language_id.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_hamerly": clustering.op11_hamerly,
    "op12_best_fit": best_fit.op12_best_fit,
}
ORACLES: dict[str, str] = {
    "op5_mixing": mixing.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op9_fingerprint": fingerprint.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op11_hamerly": clustering.OP11_SQL,
}
