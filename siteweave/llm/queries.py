"""The queries of this subpackage, by the name under which they are registered."""

from __future__ import annotations

from siteweave.llm import repetition
from siteweave.llm.alignment import op12_token_alignment
from siteweave.llm.byte_bpe import op9_byte_bpe
from siteweave.llm.edit_fingerprints import op6_edit_fingerprints
from siteweave.llm.html_text import op8_html_text
from siteweave.llm.mixing import op4_mix_sources
from siteweave.llm.ngram_join import op3_ngram_join
from siteweave.llm.repetition import op13_quality_rules
from siteweave.llm.secret_scan import op7_secrets
from siteweave.llm.sharding import op10_shards
from siteweave.llm.token_files import op1_token_files
from siteweave.llm.toxicity import op5_toxicity
from siteweave.llm.vector_topk import op2_vector_topk
from siteweave.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_vector_topk,
        op3_ngram_join,
        op4_mix_sources,
        op5_toxicity,
        op6_edit_fingerprints,
        op7_secrets,
        op8_html_text,
        op9_byte_bpe,
        op10_shards,
        op11_whitening,
        op12_token_alignment,
        op13_quality_rules,
    )
}

ORACLE_SQL = {
    "op2_vector_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_quality_rules": repetition.ORACLE,
}
