"""Registered queries of the text operators, and the SQL for the same rows where SQL can state them."""

from __future__ import annotations

import corpus_pipeline
from geoquarry.llm import decontamination, fill_in_middle, html_text, media, merkle, near_dedup, oracles, pieces, pii, secrets, sharding, token_files, toxicity, word_bpe

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_html_min_cut": html_text.op2_html_min_cut,
    "op3_toxicity_nearest_examples": toxicity.op3_toxicity_nearest_examples,
    "op4_stratified_interleaving": sharding.op4_stratified_interleaving,
    "op5_sentencepiece_n_best": pieces.op5_sentencepiece_n_best,
    "op6_avi_motion_jpeg": media.op6_avi_motion_jpeg,
    "op7_information_theoretic_pii": pii.op7_information_theoretic_pii,
    "op8_spaced_seed_decontamination": decontamination.op8_spaced_seed_decontamination,
    "op9_secret_automaton": secrets.op9_secret_automaton,
    "op10_token_id_files": token_files.op10_token_id_files,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_octopus_manifest": merkle.op12_octopus_manifest,
    "op13_speculative_bpe": word_bpe.op13_speculative_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op7_information_theoretic_pii": oracles.pii_sql(),
    "op9_secret_automaton": oracles.secrets_sql(),
    "op1_minhash_near_dedup": near_dedup.ORACLE,
    "op8_spaced_seed_decontamination": decontamination.ORACLE,
    "op4_stratified_interleaving": sharding.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_octopus_manifest": merkle.ORACLE,
}
