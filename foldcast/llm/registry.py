"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldcast.llm.exact_dedup import OP8_SQL, op8_chunk_recipes
from foldcast.llm.licenses import OP2_SQL, op2_licence_scan
from foldcast.llm.mixing import OP5_SQL, op5_pfair_mixing
from foldcast.llm.near_dedup import op9_bbit_minhash
from foldcast.llm.negatives import OP12_SQL, op12_cover_tree_negatives
from foldcast.llm.packing import op10_best_fit_packing
from foldcast.llm.pieces import op13_agenda_pieces
from foldcast.llm.quality import op3_co_training
from foldcast.llm.repair import op11_glr_repair
from foldcast.llm.sharding import OP1_SQL, op1_extendible_sharding
from foldcast.llm.token_files import op4_token_files
from foldcast.llm.topk import OP7_SQL, op7_nra_top_k
from foldcast.llm.warc import op6_warc_index


QUERIES = (
    op1_extendible_sharding, op2_licence_scan, op3_co_training, op4_token_files, op5_pfair_mixing, op6_warc_index, op7_nra_top_k,
    op8_chunk_recipes, op9_bbit_minhash, op10_best_fit_packing, op11_glr_repair, op12_cover_tree_negatives, op13_agenda_pieces,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_extendible_sharding": OP1_SQL,
        "op2_licence_scan": OP2_SQL,
        "op5_pfair_mixing": OP5_SQL,
        "op7_nra_top_k": OP7_SQL,
        "op8_chunk_recipes": OP8_SQL,
        "op12_cover_tree_negatives": OP12_SQL,
    }
