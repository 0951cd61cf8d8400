"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import op10_chat_format
from .collocations import op13_collocations
from .conversation_repair import op12_conversation_repair
from .decontaminate import op1_decontaminate
from .embedding_dedup import op2_embedding_dedup
from .licenses import op8_license_scan
from .line_dedup import op9_line_dedup
from .near_dedup import op4_near_dedup
from .oracle import ORACLE_SQL
from .packing import op5_pack
from .quality import op6_quality
from .secrets import op3_secret_scan
from .url_filter import op7_url_filter
from .warc import op11_warc

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_pack": op5_pack,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_warc": op11_warc,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}
