"""Assembly of upload sessions against plain concatenation."""

import hashlib
import random

from tempolyra.operators import queues


def test_assembled_content(spark):
    """Chunks sent twice, out of order, missing, empty, null; a session without any and one without a name."""
    rng = random.Random(4)
    sessions, chunks, want = [], [], {}
    for t in range(30):
        size, unit = rng.randint(1, 900), 100
        sessions.append((t, size, unit))
        whole = bytes(rng.randrange(256) for _ in range(size))
        parts = [whole[k : k + unit] for k in range(0, size, unit)]
        sent = [(t, k, len(p), p) for k, p in enumerate(parts)]
        if t % 5 == 1:
            sent.append((t, 0, 10, b"\x00" * 10))  # a shorter one of the same chunk
        if t % 5 == 2:
            gone = sent.pop(rng.randrange(len(sent)))
            whole = b"".join(p for _, k, _, p in sent)
            assert gone
        if t % 5 == 3:
            sent[0] = (t, 0, len(parts[0]), None)
            whole = b"".join(parts[1:])
        if t % 5 == 4:
            sent.append((t, 0, len(parts[0]), parts[0] + b"later"))  # of one size, the first in order
        rng.shuffle(sent)
        chunks += sent
        want[t] = (hashlib.sha256(whole).hexdigest(), t % 5 != 2 and (t % 5 != 1 or len(parts[0]) > 10))
    sessions.append((90, 250, 100))
    want[90] = hashlib.sha256(b"").hexdigest(), False
    chunks.append((None, 0, 3, b"abc"))
    want[None] = hashlib.sha256(b"abc").hexdigest(), False
    s = spark.createDataFrame(sessions, "ticket_id long, size_bytes long, chunk_bytes long")
    c = spark.createDataFrame(chunks, "ticket_id long, chunk_index long, size_bytes long, content binary").repartition(7)
    got = {r.ticket_id: (r.sha256, r.complete) for r in queues.assemble_sessions(s, c).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[t][1] == want[t][1] for t in got if t is not None and t % 5 != 1)
    assert queues.assemble_sessions(s, c.drop("content")).columns == ["ticket_id", "chunks", "total_bytes", "complete"]
    assert queues.content_digests(c.limit(0)).count() == 0
