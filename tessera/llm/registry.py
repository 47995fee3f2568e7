"""The queries of this subpackage, and SQL for those that SQL can express."""

from tessera.llm import jaccard, warc
from tessera.llm.decontam import op10_decontamination
from tessera.llm.jaccard import op2_jaccard
from tessera.llm.langid import op7_langid
from tessera.llm.lines import op9_lines
from tessera.llm.media import op1_gif
from tessera.llm.packing import op6_packing
from tessera.llm.pii import op5_pii
from tessera.llm.substrings import op8_substrings
from tessera.llm.toxicity import op4_toxicity
from tessera.llm.warc import op3_warc

QUERIES = {"op1_gif": op1_gif, "op2_jaccard": op2_jaccard, "op3_warc": op3_warc, "op4_toxicity": op4_toxicity, "op5_pii": op5_pii, "op6_packing": op6_packing, "op7_langid": op7_langid, "op8_substrings": op8_substrings, "op9_lines": op9_lines, "op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {"op2_jaccard": jaccard.SQL, "op3_warc": warc.SQL}
