"""The operators of this package as queries on the test tables, and SQL for those that have it."""

from almanac.llm.chat import OP3_SQL, op3_chat_formatting
from almanac.llm.decontaminate import op4_benchmark_decontamination
from almanac.llm.licenses import op6_license_scans
from almanac.llm.mixing import OP12_SQL, op12_source_mix
from almanac.llm.near_copies import OP1_SQL, op1_minhash_near_dedup
from almanac.llm.packing import op2_packing
from almanac.llm.phrases import OP13_SQL, op13_phrase_collocations
from almanac.llm.quality import OP9_SQL, op9_quality_rules
from almanac.llm.repeats import op10_suffix_array_dedup
from almanac.llm.secrets import op5_secret_scans
from almanac.llm.token_files import op8_token_ids
from almanac.llm.urls import op7_url_filters
from almanac.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_packing, op3_chat_formatting, op4_benchmark_decontamination, op5_secret_scans,
        op6_license_scans, op7_url_filters, op8_token_ids, op9_quality_rules,
        op10_suffix_array_dedup, op11_embedding_whitening, op12_source_mix,
        op13_phrase_collocations,
    )
}
ORACLES = {
    "op1_minhash_near_dedup": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op9_quality_rules": OP9_SQL,
    "op12_source_mix": OP12_SQL, "op13_phrase_collocations": OP13_SQL,
}
