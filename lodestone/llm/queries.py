"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, fill_middle, fingerprint, language, line_dedup, manifest, near_dedup, pii, secret_scan, toxicity, url_filter

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_language_id": language.op5_language_id,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pii": pii.op10_pii,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_fill_middle": fill_middle.op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_chat_format": chat.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_minhash_near_dedup": near_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op11_secret_scan": secret_scan.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
