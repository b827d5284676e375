"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import OP13_SQL, op13_divergence
from .embeddings import op10_embeddings
from .jaccard import op9_jaccard
from .langid import op2_langid
from .linededup import OP8_SQL, op8_linededup
from .packing import op1_pack
from .personal import op11_personal
from .phrases import OP12_SQL, op12_phrases
from .quality import op3_quality
from .sentencepieces import op6_sentencepieces
from .toxicity import op4_toxicity
from .urlfilter import OP5_SQL, op5_urlfilter
from .warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_urlfilter": op5_urlfilter,
    "op6_sentencepieces": op6_sentencepieces,
    "op7_warc": op7_warc,
    "op8_linededup": op8_linededup,
    "op9_jaccard": op9_jaccard,
    "op10_embeddings": op10_embeddings,
    "op11_personal": op11_personal,
    "op12_phrases": op12_phrases,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = {
    "op5_urlfilter": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op8_linededup": OP8_SQL,
    "op12_phrases": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
