"""Corpus operators: thirteen steps of a training-data pipeline. Nothing else in the library imports this subpackage."""

from fieldglass.llm import oracles
from fieldglass.llm.conversations import op12_conversation_repair
from fieldglass.llm.decontamination import op11_decontamination
from fieldglass.llm.embedding_dedup import op8_embedding_near_dedup
from fieldglass.llm.mixing import op7_mixing_sources
from fieldglass.llm.near_dedup import op2_minhash_near_dedup
from fieldglass.llm.neighbours import op3_nearest_neighbours
from fieldglass.llm.packing import op5_best_fit_packing
from fieldglass.llm.quality import op10_quality_classifier
from fieldglass.llm.sharding import op1_sharding
from fieldglass.llm.spelling import op13_spelling_variants
from fieldglass.llm.suffix_dedup import op4_suffix_array_dedup
from fieldglass.llm.token_files import op6_token_files
from fieldglass.llm.warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_minhash_near_dedup,
        op3_nearest_neighbours,
        op4_suffix_array_dedup,
        op5_best_fit_packing,
        op6_token_files,
        op7_mixing_sources,
        op8_embedding_near_dedup,
        op9_warc,
        op10_quality_classifier,
        op11_decontamination,
        op12_conversation_repair,
        op13_spelling_variants,
    )
}
#: DuckDB statements, where SQL can express the query at an acceptable cost.
ORACLES: dict[str, str] = {
    "op9_warc": oracles.WARC,
    "op11_decontamination": oracles.DECONTAMINATION,
    "op12_conversation_repair": oracles.CONVERSATIONS,
    "op13_spelling_variants": oracles.SPELLING,
}
