"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, langid, lattice, licenses, packing, prefixtrie, reshard, secrets, simhash, substrings, tokencount, topk, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_decontamination": decontaminate.query,
        "op3_language": langid.query,
        "op4_lattice": lattice.query,
        "op5_packing": packing.query,
        "op6_secrets": secrets.query,
        "op7_token_counts": tokencount.query,
        "op8_topk": topk.query,
        "op9_reshard": reshard.query,
        "op10_licenses": licenses.query,
        "op11_prefix_trie": prefixtrie.query,
        "op12_whitening": whitening.query,
        "op13_substrings": substrings.query,
        "packed_conversations": packing.conversations_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": topk.SQL, "op11_prefix_trie": prefixtrie.SQL, "op13_substrings": substrings.SQL}
