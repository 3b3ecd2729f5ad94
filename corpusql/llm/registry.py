"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusql.llm.decontaminate import OP2_SQL, op2_decontamination
from corpusql.llm.fingerprints import op1_fingerprints
from corpusql.llm.licenses import op9_licenses
from corpusql.llm.minhash import op7_minhash
from corpusql.llm.packing import op5_packing, pack_conversations
from corpusql.llm.secrets import op6_secrets
from corpusql.llm.sharding import op10_sharding
from corpusql.llm.substrings import op3_substrings
from corpusql.llm.toxicity import op8_toxicity
from corpusql.llm.warc import op4_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_decontamination": op2_decontamination,
    "op3_substrings": op3_substrings,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_sharding": op10_sharding,
    "pack_conversations": pack_conversations,
}

ORACLE_SQL = {
    "op2_decontamination": OP2_SQL,
}
