"""The registered queries: columns, rows, and SQL where there is some."""

import os

import pytest

import __spark_entry__
from paperloom.llm import entries

from ..oracle_check import difference

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
COLUMNS = {
    1: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    2: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    3: {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    4: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    5: {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    6: {"doc_id": "bigint"},
    7: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    8: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    9: {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    10: {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("n", COLUMNS)
def test_columns_and_rows(spark, n):
    (name,) = [x for x in entries.queries() if x.startswith(f"op{n}_")]
    df = entries.queries()[name](spark, SMALL)
    assert COLUMNS[n].items() <= dict(df.dtypes).items()
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert df.count() >= documents if n == 9 else df.count() == documents


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_sql(spark, name):
    mine, theirs, more, less = difference(spark, entries.queries()[name], entries.oracle_sql()[name], MEDIUM)
    assert (mine, more, less) == (theirs, [], [])


def test_registered():
    assert {"pipeline", *entries.queries()} <= set(__spark_entry__.queries())
