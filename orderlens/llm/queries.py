"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .block_max import OP13_SQL, op13_block_max
from .byte_bpe import op10_byte_bpe
from .chat import OP3_SQL, op3_chat
from .chosen_path import op9_chosen_path
from .licenses import op12_license_scan
from .line_dedup import op2_line_dedup
from .packing import op8_packing
from .pii import op1_pii
from .piecewise_hash import op5_piecewise_hash
from .repetition import op6_repetition
from .secret_scan import op7_secret_scan
from .substring_dedup import op4_substring_dedup
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pii,
        op2_line_dedup,
        op3_chat,
        op4_substring_dedup,
        op5_piecewise_hash,
        op6_repetition,
        op7_secret_scan,
        op8_packing,
        op9_chosen_path,
        op10_byte_bpe,
        op11_whitening,
        op12_license_scan,
        op13_block_max,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op13_block_max": OP13_SQL}
