"""The queries of this package, and SQL for those that SQL can express."""

from foliant.llm import bag_minhash, bucket_histogram, exact_dedup, main_text, packing, piece_codec, pii, positional_index, secret_scan, substring_dedup, toxicity, vector_codes, warc

MODULES = {
    "op1_warc_normaliser": warc,
    "op2_toxicity": toxicity,
    "op3_exact_dedup": exact_dedup,
    "op4_contextual_pii": pii,
    "op5_best_fit_packing": packing,
    "op6_secret_scan": secret_scan,
    "op7_substring_dedup": substring_dedup,
    "op8_positional_decontamination": positional_index,
    "op9_main_text": main_text,
    "op10_bag_minhash": bag_minhash,
    "op11_offset_pieces": piece_codec,
    "op12_vector_codes": vector_codes,
    "op13_bucket_histogram": bucket_histogram,
}

QUERIES = {name: module.query for name, module in MODULES.items()}
ORACLES = {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
