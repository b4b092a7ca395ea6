"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from . import best_fit_packing, bpe_fragments, cost_packing, kneser_ney, licenses, minhash, mixing, ogg, phrases, pii, preferences, voronoi_knn, whitening

QUERIES = {
    "op1_voronoi_knn": voronoi_knn.op1_voronoi_knn,
    "op2_ogg_media": ogg.op2_ogg_media,
    "op3_kneser_ney_quality": kneser_ney.op3_kneser_ney_quality,
    "op4_contextual_pii": pii.op4_contextual_pii,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_license_rules": licenses.op6_license_rules,
    "op7_source_mix": mixing.op7_source_mix,
    "op8_best_fit_packing": best_fit_packing.op8_best_fit_packing,
    "op9_preference_pairs": preferences.op9_preference_pairs,
    "op10_cost_balanced_packing": cost_packing.op10_cost_balanced_packing,
    "op11_pivot_collocations": phrases.op11_pivot_collocations,
    "op12_forced_boundary_bpe": bpe_fragments.op12_forced_boundary_bpe,
    "op13_residue_whitening": whitening.op13_residue_whitening,
}

ORACLES: dict[str, str] = {
    "op1_voronoi_knn": voronoi_knn.OP1_SQL,
    "op5_minhash_near_dedup": minhash.OP5_SQL,
    "op6_license_rules": licenses.OP6_SQL,
    "op7_source_mix": mixing.OP7_SQL,
    "op9_preference_pairs": preferences.OP9_SQL,
    "op11_pivot_collocations": phrases.OP11_SQL,
}
