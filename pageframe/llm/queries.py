"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, fmindex, minhash, packing, quality, secrets, suffix, toxicity, warc

QUERIES = {
    "op1_substring": fmindex.op1_substring,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_minhash": minhash.op4_minhash,
    "op5_ann": ann.op5_ann,
    "op6_quality": quality.op6_quality,
    "op7_suffix_array": suffix.op7_suffix_array,
    "op8_packing": packing.op8_packing,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_secrets": secrets.op10_secrets,
}
ORACLES = {"op1_substring": fmindex.ORACLE_SQL, "op2_warc": warc.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL}
