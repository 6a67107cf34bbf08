"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .chat import OP2_SQL, op2_chat
from .collocations import op11_collocations
from .decontaminate import op6_decontaminate
from .license_scan import op1_license_scan
from .packing import op8_packing
from .quality_classifier import op10_quality
from .quality_rules import op7_repetition
from .repeats import op13_repeats
from .simhash import op5_simhash
from .toxicity import op3_toxicity
from .url_filter import op9_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op9_url_filter": op9_url_filter,
    "op4_warc": op4_warc,
    "op2_chat": op2_chat,
    "op1_license_scan": op1_license_scan,
    "op8_packing": op8_packing,
    "op3_toxicity": op3_toxicity,
    "op10_quality": op10_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_repetition": op7_repetition,
    "op5_simhash": op5_simhash,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_repeats": op13_repeats,
}
ORACLES: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op4_warc": OP4_SQL,
}
