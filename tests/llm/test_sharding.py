import zlib
from collections import defaultdict

import numpy as np

from labframe.llm import sharding

from .conftest import corpus


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop_and_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, np.int64).astype(np.uint64)
    for n in (1, 2, 40, 41):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    old, new = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(new[old != new]) == {40} and 60 < (old != new).sum() < 200


def test_shards_slots_and_checksums(docs, none, twice):
    for df, n in ((docs, len(corpus())), (twice, 2 * len(corpus()) + 1)):
        rows, slots = sharding.sharded(df, 5).collect(), defaultdict(list)
        texts = dict(corpus()) | {None: dict(corpus())[20]}
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
            assert r.grown_shard in (r.shard, 5)
            slots[r.shard].append(r.slot)
        assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sharding.sharded(none, 5).count() == 0


def test_written_shards(docs, tmp_path, spark):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(corpus())
