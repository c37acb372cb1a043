"""The subpackage's queries against their SQL, and every contract's columns."""

import pytest

from tessera.llm.queries import ORACLES, QUERIES
from tests import oracle

COLUMNS = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_decontamination": ["doc_id", "item_id", "start", "end", "edits"],
    "op5_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_ann": ["query_id", "rank", "vec_id", "score"],
    "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op10_ngram_join": ["doc_id", "n_shingles", "component_id"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, oracle.DATA)
    assert df.columns == COLUMNS[name]
    if name in ORACLES:
        oracle.check(df, ORACLES[name], oracle.connect())
    elif name not in ("op4_decontamination", "op8_ann"):
        docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").count()
        assert df.select("doc_id").distinct().count() == docs


def test_entry_registers_all_eleven():
    import __spark_entry__

    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())
