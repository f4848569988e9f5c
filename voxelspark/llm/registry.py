"""Queries of this package and their DuckDB oracles."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat
from .langid import op2_langid
from .licenses import OP8_SQL, op8_licenses
from .media import op9_media
from .minhash import op6_minhash
from .mixing import OP10_SQL, op10_mixing
from .packing import op4_packing
from .quality import op5_quality
from .repair import OP12_SQL, op12_repair
from .spotsigs import op11_spotsigs
from .suffix_dedup import op3_suffix_dedup
from .urls import op1_urls

QUERIES = {
    "op1_urls": op1_urls,
    "op2_langid": op2_langid,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
    "op11_spotsigs": op11_spotsigs,
    "op12_repair": op12_repair,
}
ORACLES = {
    "op7_chat": OP7_SQL,
    "op8_licenses": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op12_repair": OP12_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
