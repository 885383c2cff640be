"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_format
from .decontamination import OP6_SQL, op6_decontamination
from .jaccard import OP1_SQL, op1_ngram_jaccard
from .licenses import LICENSE_BASE_SQL, license_base_places, op9_license_scan
from .mixing import OP3_SQL, op3_mixing
from .negatives import OP12_SQL, op12_hard_negatives
from .neighbours import LINKS_SQL, OP4_SQL, embedding_links, op4_embedding_dedup
from .periods import OP13_SQL, op13_periodic_runs
from .recompression import OP8_SQL, op8_substring_dedup
from .secrets import OP2_SQL, op2_secret_scan
from .sharding import SHARD_LOADS_SQL, op10_sharding, shard_loads
from .toxicity import op7_toxicity
from .urls import OP11_SQL, op11_url_filter

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_secret_scan": op2_secret_scan,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_sharding": op10_sharding,
    "op11_url_filter": op11_url_filter,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
    # op4 on a table with links; what SQL can say about operators whose query has other columns, too.
    "embedding_links": embedding_links,
    "license_base_places": license_base_places,
    "shard_loads": shard_loads,
}
#: op7 fits a model, op9 matches with edits and op10 draws hashes that DuckDB lacks; tests/llm holds them against plain versions.
ORACLE_SQL = {
    "op1_ngram_jaccard": OP1_SQL,
    "op2_secret_scan": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_url_filter": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
    "embedding_links": LINKS_SQL,
    "license_base_places": LICENSE_BASE_SQL,
    "shard_loads": SHARD_LOADS_SQL,
}
