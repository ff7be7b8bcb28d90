"""The registered queries of the corpus operators, and SQL where SQL can say it."""

from __future__ import annotations

from . import alignment, decontam, host_rules, langid, licenses, line_dedup, ngram_join, packing, pii, sharding, token_counts, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_host_rules": host_rules.op2_host_rules,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_licenses": licenses.op4_licenses,
    "op5_langid": langid.op5_langid,
    "op6_packing": packing.op6_packing,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontam": decontam.op9_decontam,
    "op10_pii": pii.op10_pii,
    "op11_sharding": sharding.op11_sharding,
    "op12_whitening": whitening.op12_whitening,
    "op13_alignment": alignment.op13_alignment,
}

#: A query without an entry can't be said in SQL; its test holds it against brute force.
ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op2_host_rules": host_rules.ORACLE,
    "op4_licenses": licenses.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_decontam": decontam.ORACLE,
    "op10_pii": pii.ORACLE,
    "op11_sharding": sharding.ORACLE,
}
