"""Groups of candidate lines: many small ones are verified at once, with the links and counts of all pairs."""

import numpy as np
import pyarrow as pa

from supplyplan.llm import grouping, line_dedup
from supplyplan.llm.textcodes import prefix, run_hash


def test_small_groups_are_verified_together():
    r = np.random.default_rng(5)
    payload = [bytes(r.integers(97, 99, 6).tolist()) for _ in range(60)]
    buckets = [sorted({int(b) for b in r.integers(0, 150, 6)}) for _ in payload]
    rows = sorted((b, 0, 0, rep) for rep, own in enumerate(buckets) for b in own)
    table = pa.table({
        "bucket": pa.array([x[0] for x in rows], pa.int64()), "lo": pa.array([0] * len(rows), pa.int32()), "hi": pa.array([0] * len(rows), pa.int32()),
        "block": pa.array([0] * len(rows), pa.int32()), "rep": pa.array([x[3] for x in rows], pa.int64()),
        "n": pa.array([6] * len(rows), pa.int32()), "payload": pa.array([payload[x[3]] for x in rows], pa.binary()),
        "buckets": pa.array([buckets[x[3]] for x in rows], pa.list_(pa.int64()))})
    calls = []

    def verify(lines, left, right):
        calls.append(len(left))
        return line_dedup._verify_block(lines, left, right, 1)

    wanted = np.zeros(len(payload), int)
    linked = [(a, b) for a in range(60) for b in range(a) if set(buckets[a]) & set(buckets[b])
              and line_dedup.edit_distance(payload[a], payload[b], 1) <= 1]
    np.add.at(wanted, np.array(linked).ravel(), 1)
    assert len(linked) > 20
    for size in (7, 1000):
        calls.clear()
        found = list(grouping._whole_groups(iter(table.to_batches(max_chunksize=size)), verify, lambda x, y: abs(x - y) <= 1))
        counts, to = np.zeros(len(payload), int), {k: {k} for k in range(60)}
        for batch in found:
            np.add.at(counts, batch["rep"].to_numpy(), batch["n_links"].to_numpy())
            for a, b in zip(batch["rep"].to_pylist(), batch["to"].to_pylist()):
                joined = to[a] | to[b]
                to.update(dict.fromkeys(joined, joined))
        assert counts.tolist() == wanted.tolist()
        whole = {k: {k} for k in range(60)}
        for a, b in linked:
            joined = whole[a] | whole[b]
            whole.update(dict.fromkeys(joined, joined))
        assert to == whole
    assert len(calls) <= 2  # of some 150 groups in one batch


def test_bytes_are_of_the_wanted_line():
    """Of other texts under one doc_id only the line that the hash names counts."""
    lines = [b"a first line", b"b", b""]
    reps = [int(run_hash(prefix(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)])).view(np.int64)[0]) for x in lines]
    wanted = [{"rep": reps[0], "line": 0}, {"rep": reps[1], "line": 1}]
    batch = pa.RecordBatch.from_pylist([{"text": t, "wanted": wanted} for t in ("a first line\nb", "another line\nb\nc", None)], pa.schema(
        {"text": pa.string(), "wanted": pa.list_(pa.struct({"rep": pa.int64(), "line": pa.int32()}))}))
    got = next(line_dedup._line_bytes(iter([batch]))).to_pylist()
    assert got == [{"rep": reps[0], "bytes": lines[0]}, {"rep": reps[1], "bytes": lines[1]}, {"rep": reps[1], "bytes": lines[1]}]
