"""The operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import classlm, decontaminate, linededup, packing, pii, quality, secrets, sharding, simhash, toxicity
from .common import shipped

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_secret_scan": secrets.op2,
    "op3_benchmark_decontamination": shipped(decontaminate.op3),
    "op4_class_ngrams": shipped(classlm.op4),
    "op5_toxicity": shipped(toxicity.op5),
    "op6_best_fit_packing": shipped(packing.op6),
    "op7_sharding": shipped(sharding.op7),
    "op8_line_dedup": linededup.op8,
    "op9_simhash_near_dedup": shipped(simhash.op9),
    "op10_pii": shipped(pii.op10),
}
ORACLE_SQL = {"op3_benchmark_decontamination": decontaminate.OP3_SQL, "op8_line_dedup": linededup.OP8_SQL}
