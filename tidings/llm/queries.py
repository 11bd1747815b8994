"""The queries of this package and their SQL equivalents."""

from __future__ import annotations

from tidings.llm import bitplanes, codes, licences
from tidings.llm.bitplanes import op12_popcount_clusters
from tidings.llm.codes import op13_bounded_codes
from tidings.llm.decontaminate import op7_suffix_decontamination
from tidings.llm.hmm import op10_hidden_markov
from tidings.llm.language import op2_recurrent_language
from tidings.llm.licences import op3_licence_scan
from tidings.llm.pieces import op6_sentencepiece
from tidings.llm.shards import op4_virtual_slots
from tidings.llm.simhash import op1_simhash_balls
from tidings.llm.substrings import op9_countmin_substrings
from tidings.llm.suffixes import op8_bucket_suffixes
from tidings.llm.tables import in_short_batches
from tidings.llm.toxicity import op11_nearest_toxicity
from tidings.llm.vectors import op5_subspace_vectors

PLANS = (
    op1_simhash_balls,
    op2_recurrent_language,
    op3_licence_scan,
    op4_virtual_slots,
    op5_subspace_vectors,
    op6_sentencepiece,
    op7_suffix_decontamination,
    op8_bucket_suffixes,
    op9_countmin_substrings,
    op10_hidden_markov,
    op11_nearest_toxicity,
    op12_popcount_clusters,
    op13_bounded_codes,
)
QUERIES = {plan.__name__: in_short_batches(plan) for plan in PLANS}
ORACLES: dict[str, str] = {"op3_licence_scan": licences.ORACLE, "op12_popcount_clusters": bitplanes.oracle(), "op13_bounded_codes": codes.oracle()}
