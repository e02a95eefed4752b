"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, extraction, jaccard, language, licenses, media, mixing, negatives, packing, topk, toxicity, trie, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license": licenses.op1_license,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_mixing": mixing.op3_mixing,
        "op4_chat": chat.op4_chat,
        "op5_media": media.op5_media,
        "op6_packing": packing.op6_packing,
        "op7_warc": warc.op7_warc,
        "op8_topk": topk.op8_topk,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_language": language.op10_language,
        "op11_negatives": negatives.op11_negatives,
        "op12_extraction": extraction.op12_extraction,
        "op13_trie": trie.op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": chat.OP4_SQL, "op7_warc": warc.OP7_SQL, "op8_topk": topk.OP8_SQL, "op9_jaccard": jaccard.OP9_SQL, "op11_negatives": negatives.OP11_SQL, "op12_extraction": extraction.OP12_SQL, "op13_trie": trie.OP13_SQL}
