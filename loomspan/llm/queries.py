"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from loomspan.llm.chat import OP4_SQL, op4_chat_format
from loomspan.llm.collocations import OP13_SQL, op13_collocations
from loomspan.llm.decontaminate import op7_decontaminate
from loomspan.llm.licenses import OP12_SQL, op12_license_scan
from loomspan.llm.lm import op9_lm_score
from loomspan.llm.periodic import op11_periodic_runs
from loomspan.llm.pii import op3_pii_surrogates
from loomspan.llm.quality import op8_quality_rules
from loomspan.llm.sentencepiece_scan import op5_sentencepiece
from loomspan.llm.simhash import op6_simhash
from loomspan.llm.substring import op10_substring_dedup
from loomspan.llm.token_file import op2_token_file
from loomspan.llm.toxicity import op1_toxicity

_ALL = (
    op1_toxicity, op2_token_file, op3_pii_surrogates, op4_chat_format, op5_sentencepiece, op6_simhash, op7_decontaminate, op8_quality_rules, op9_lm_score,
    op10_substring_dedup, op11_periodic_runs, op12_license_scan, op13_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {"op4_chat_format": OP4_SQL, "op12_license_scan": OP12_SQL, "op13_collocations": OP13_SQL}
