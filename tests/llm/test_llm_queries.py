import sys
from pathlib import Path

import pytest

pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from voxtree.llm.queries import QUERIES  # noqa: E402
from voxtree.llm.tokens import TOKENIZER  # noqa: E402


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    import compare

    if name[:2] in ("p7", "p8") and not Path(TOKENIZER).exists():
        pytest.skip("no tokenizer files here")
    rows, wrong = compare.differences(spark, data, name, compare.connect(data))
    assert not wrong and rows > 0


def test_pieces_have_their_bytes(spark, data):
    images = {r.result_id: bytes(r.signal_image) for r in spark.read.parquet(f"{data}/trace_result.parquet").where("signal_image is not null").collect()}
    pieces = QUERIES["p1_pieces"](spark, data).collect()
    assert pieces and all(bytes(p.data) == images[p.result_id][p.first_byte : p.first_byte + p.n_bytes] for p in pieces)
