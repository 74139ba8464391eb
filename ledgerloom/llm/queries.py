"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import decontaminate, fingerprint, html_text, language, licenses, line_dedup, manifest, minhash, packing, periodic, pii, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_minhash": minhash.op2_minhash,
    "op3_language": language.op3_language,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op5_planted_lines": line_dedup.op5_planted_lines,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_licenses": licenses.op7_licenses,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_packing": packing.op10_packing,
    "op11_manifest": manifest.op11_manifest,
    "op12_periodic": periodic.op12_periodic,
    "op13_pii": pii.op13_pii,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_minhash": minhash.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_manifest": manifest.ORACLE,
}
