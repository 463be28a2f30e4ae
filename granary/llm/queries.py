"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hosts, phrases, secrets
from .bpe import op1_bpe
from .decontaminate import op4_decontaminate
from .extraction import op6_extraction
from .hosts import op3_hosts
from .lattice import op5_lattice
from .minhash import op7_minhash
from .periodic import op12_periodic
from .phrases import op11_collocations
from .secrets import op2_secrets
from .substrings import op9_substrings
from .suffixes import op10_suffixes
from .token_files import op13_token_files
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_hosts": op3_hosts,
    "op4_decontaminate": op4_decontaminate,
    "op5_lattice": op5_lattice,
    "op6_extraction": op6_extraction,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_substrings": op9_substrings,
    "op10_suffixes": op10_suffixes,
    "op11_collocations": op11_collocations,
    "op12_periodic": op12_periodic,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secrets": secrets.ORACLE,
    "op3_hosts": hosts.ORACLE,
    "op11_collocations": phrases.ORACLE,
}
