"""What a worker keeps between tasks goes when another operator's tasks come."""

from functools import partial

import pyarrow as pa

from quill.llm import encoding, packing, pii
from quill.llm.common import released


def test_a_worker_keeps_what_one_operator_needs():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["write to a.b@c.de"]})
    sent = pii._sent()

    def encode(arrow):
        enc = encoding.encoder(packing.vocabulary_path(), "byte", 2)
        for b in arrow:
            enc.encode_column(b.column(1))
            yield b

    find = released(partial(pii._find, sent), "pii")
    first = [b.to_pydict() for b in find(iter([batch]))]
    field = next(iter(pii._FIELDS.values()))
    assert [b.to_pydict() for b in find(iter([batch]))] == first and next(iter(pii._FIELDS.values())) is field
    list(released(encode, "encoding")(iter([batch])))
    assert not pii._FIELDS and len(encoding._KNOWN) == 1
    list(released(lambda arrow: arrow)(iter([batch])))
    assert not encoding._KNOWN
    assert [b.to_pydict() for b in find(iter([batch]))] == first
