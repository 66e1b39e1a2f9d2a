"""All queries of the training-data operators; importing a module registers its own."""

from tidewatch.llm import (query_ann, query_bpe, query_chat, query_filters, query_html, query_idfile, query_langid, query_packing,  # noqa: F401
                           query_prefixtrie, query_quality, query_simhash, query_topk, query_toxicity)  # noqa: F401
from tidewatch.llm.base import ORACLES, QUERIES  # noqa: F401
