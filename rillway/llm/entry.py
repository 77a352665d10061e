"""Queries and oracle SQL of this subpackage."""

from . import bpe, chat, decontaminate, license, pages, quality, secrets, simhash, sphere, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_classifier,
        license.op2_license_scans,
        pages.op3_html_extraction,
        sphere.op4_embedding_near_dedup,
        simhash.op5_simhash_near_dedup,
        chat.op6_chat_formatting,
        bpe.op7_bpe_encoding,
        secrets.op8_secret_scans,
        decontaminate.op9_benchmark_decontamination,
        toxicity.op10_toxicity,
    )
}
SQL = {**sphere.SQL, **chat.SQL}
