"""The queries of this subpackage and their SQL."""

from . import alignment, decontaminate, hard_negatives, line_dedup, mixing, personal_data, quality_model, quality_rules, quotes, secrets, sharding, simhash, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        mixing.op2_source_mix,
        sharding.op3_best_fit_shards,
        token_counts.op4_token_counts,
        secrets.op5_secret_scan,
        quality_rules.op6_quality_rules,
        decontaminate.op7_decontaminate,
        quality_model.op8_weak_label_quality,
        line_dedup.op9_fuzzy_lines,
        quotes.op10_quotation_links,
        personal_data.op11_personal_data,
        hard_negatives.op12_hard_negatives,
        alignment.op13_tokenizer_alignment,
    )
}
SQL = {**mixing.SQL, **decontaminate.SQL, **quotes.SQL, **hard_negatives.SQL}
