"""The registered queries of this subpackage, and their SQL where there is one."""

from quillspark.llm import decontamination, exact_dedup, hard_negatives, license_scan, line_dedup, mixing, quality_crf, sharding, signature_join, simhash, token_output, url_filters, vector_codes
from quillspark.llm.shared import carry_modules


def _carried(query):
    def run(spark, sf_dir):
        carry_modules(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_sharding": sharding.query,
    "op2_line_dedup": line_dedup.query,
    "op3_simhash": simhash.query,
    "op4_quality": quality_crf.query,
    "op5_token_output": token_output.query,
    "op6_decontamination": decontamination.query,
    "op7_url_filters": url_filters.query,
    "op8_mixing": mixing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_license_scan": license_scan.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_vector_codes": vector_codes.query,
    "op13_signature_join": signature_join.query,
}
QUERIES = {name: _carried(query) for name, query in QUERIES.items()}
ORACLE_SQL = {
    "op1_sharding": sharding.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_signature_join": signature_join.ORACLE,
}
