"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import align, bpe, embeddings, flac, langid, licenses, merkle, minhash, mixing, neighbours, oracles, secrets, sharding, toxicity

QUERIES = {
    "op1_license_automaton": licenses.op1_license_automaton,
    "op2_pstable_near_vectors": embeddings.op2_pstable_near_vectors,
    "op3_flac_media": flac.op3_flac_media,
    "op4_linked_secrets": secrets.op4_linked_secrets,
    "op5_pivotal_mix": mixing.op5_pivotal_mix,
    "op6_crf_language": langid.op6_crf_language,
    "op7_forced_boundary_bpe": bpe.op7_forced_boundary_bpe,
    "op8_chain_toxicity": toxicity.op8_chain_toxicity,
    "op9_bayes_minhash": minhash.op9_bayes_minhash,
    "op10_kd_tree_shards": sharding.op10_kd_tree_shards,
    "op11_nn_descent": neighbours.op11_nn_descent,
    "op12_identity_alignment": align.op12_identity_alignment,
    "op13_butterfly_manifest": merkle.op13_butterfly_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pstable_near_vectors": oracles.NEAR_VECTORS,
    "op4_linked_secrets": oracles.linked_secrets(secrets.BASE, secrets.WEAK, secrets.ROLES, secrets.SCOPE),
    "op9_bayes_minhash": oracles.NEAR_DOCUMENTS,
    "op11_nn_descent": neighbours.op11_nn_descent,
    "op12_identity_alignment": align.op12_identity_alignment,
    "op13_butterfly_manifest": oracles.manifest(merkle.FANOUT),
}
